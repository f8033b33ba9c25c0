import pytest

from taxolink.llm import mixing, set_join, sides

IDS = {"close": list(range(-40000, 40000, 3)), "far": [k * 10**9 + 7 for k in range(-50, 50)], "one": [0], "none": []}


@pytest.mark.parametrize("name", IDS)
@pytest.mark.parametrize("bound", [1 << 21, -1])
def test_rows_with_ids(spark, tmp_path, monkeypatch, name, bound):
    monkeypatch.setattr(sides, "BROADCAST_ROWS", bound)
    wanted = set(IDS[name])
    asked = sorted({x + d for x in wanted for d in (-1, 0, 1)} | {0, 1, -1, 32768, -32768, 2**62, -2**62})
    spark.createDataFrame([(i,) for i in wanted], "kept long").write.parquet(f"{tmp_path}/ids")
    rows = spark.createDataFrame([(i, "t", "x") for i in asked] + [(None, "n", "x")] * 2,
                                 "doc_id long, text string, _side_id string")
    ids = spark.read.parquet(f"{tmp_path}/ids")
    out = sides.rows_with_ids(rows, "doc_id", ids)
    assert out.columns == rows.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(wanted & set(asked))
    with_nulls = [r.doc_id for r in sides.rows_with_ids(rows, "doc_id", ids, nulls=True).collect()]
    assert with_nulls.count(None) == 2 and len(with_nulls) == len(wanted & set(asked)) + 2


def _exchanged(df) -> list[str]:
    """The shuffles of a plan, but for those of the ids that are sent to the rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if " Exchange " in line and "hashpartitioning(_side_id" not in line]


def test_neither_stage_shuffles_texts(spark, tmp_path):
    spark.createDataFrame([(i, f"s{i % 3}", " ".join(f"w{(i * 7 + k) % 90}" for k in range(i % 40))) for i in range(600)],
                          "doc_id long, source string, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert not _exchanged(mixing.mixed_documents(docs))
    assert not _exchanged(set_join.one_of_each(docs, n=5, num=80, den=100))


@pytest.mark.parametrize("bin_rows", [1, 3, 512])
def test_the_smallest_hashes_of_a_length_are_taken(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(mixing, "BIN_ROWS", bin_rows)
    monkeypatch.setattr(mixing, "FEW_DOCS", 0)
    docs = [(i % 190, "ab"[i % 2], " ".join(["w"] * (1 + i % 5))) for i in range(400)]   # some rows twice
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    hashed = {(r.doc_id, r.source, r.size): r.order for r in mixing._measured(df, 17).collect()}
    per = {}
    for r in mixing.mix(df, share=1.3).collect():
        per.setdefault((r.source, r.size), []).append((hashed[r.doc_id, r.source, r.size], r.copies))
    some = 0
    for rows in per.values():
        counts = [c for _, c in sorted(rows, key=lambda x: (x[0], -x[1]))]
        assert counts == sorted(counts, reverse=True) and max(counts) - min(counts) <= 1
        some += max(counts) > min(counts)
    assert some and sum(map(len, per.values())) == 400
