import collections

import public_tokenizers
from brute import similar, targets, WORD

import __spark_entry__ as entry
import corpus_pipeline


def test_stages_take_effect_and_keep_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{tmp_path}/{k}")
        seen[name] = docs, spark.read.parquet(path)
        docs = seen[name][1]
    for before, after in list(seen.values())[:-1]:
        assert after.columns == before.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    start, good = seen["quality"]
    kept = {r.doc_id for r in good.collect()}
    assert all((i in kept) == (q == 1) for i, q in labels.items())

    before, after = seen["near_duplicates"]
    groups = similar([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, g in groups.items() if g[1] == i)

    before, after = seen["mixture"]
    size = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in before.collect()}
    per = collections.Counter()
    for s, n in size.values():
        per[s] += n
    want, taken = targets(dict(per), (5, 2, 1), 1.5, 2.0), collections.Counter()
    for r in after.collect():
        taken[r.source] += size[r.doc_id][1]
    biggest = max(n for _, n in size.values())
    assert all(abs(taken[s] - want[s]) <= biggest for s in per)

    before, after = seen["packed"]
    copies = collections.Counter(r.doc_id for r in before.collect())
    pieces = collections.Counter(r.doc_id for r in after.collect() if r.piece == 0)
    assert pieces == copies


def test_run_gives_the_last_stage(spark, sf_dir):
    out = entry.queries()["pipeline"](spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    per = collections.Counter()
    for r in out.collect():
        per[r.sequence_id] += r.length
    assert max(per.values()) <= 2048
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_empty_documents_pass_through_all_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        docs = out
