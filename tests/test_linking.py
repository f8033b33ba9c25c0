"""Text beam, trained head, window tables, epoch permutations, member sets: against brute force."""

import datetime as dt
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import SMOKE_DIR, rows
from taxolink.operators import head_training as HT
from taxolink.operators import labels as L
from taxolink.operators import splits as SP
from taxolink.operators import textbeam as TB
from taxolink.operators import windows as WN
from taxolink.plans import linking as LK
from taxolink.session import scratch_path, scratch_root, written_plans

# ---------------------------------------------------------------- text beam


def brute_beam(records, rec, cls, parent_of, triples):
    down = {}
    for c, p in parent_of:
        down.setdefault(p, set()).add(c)
    out = set()
    for r in records:
        score = {c: round(sum(w * cls.get(c, {}).get(t, 0.0) for t, w in rec.get(r, {}).items()), 9) for c, _ in parent_of}
        for k in triples:
            level, depth = [-1], 0
            while level:
                chosen = set()
                for node in level:
                    best = sorted(down.get(node, ()), key=lambda c: (-score[c], c))[:k[min(depth, 2)]]
                    chosen |= set(best)
                out |= {(r, *k, c, score[c]) for c in chosen}
                level, depth = sorted(chosen), depth + 1
    return out


def vectors(spark, name, table):
    return spark.createDataFrame([(i, t, w) for i, v in table.items() for t, w in v.items()], f"{name} long, term_id long, weight double")


def random_vectors(rng, ids, terms, most):
    out = {}
    for i in ids:
        some = {rng.choice(terms): rng.random() ** 3 for _ in range(rng.randint(0, most))}
        norm = sum(w * w for w in some.values()) ** 0.5
        out[i] = {t: w / norm for t, w in some.items()}
    return out


@pytest.mark.parametrize("seed,terms", [(1, list(range(12))), (2, list(range(400))), (3, [0] * 40 + list(range(30)))])
def test_text_beam_equals_scoring_every_pair(spark, seed, terms):
    rng = random.Random(seed)
    tree = [(c, -1 if c < 7 else (c - 7) // 3) for c in range(60)] + [(50, 3), (51, 2)]  # two nodes with two parents
    rec, cls = random_vectors(rng, range(100, 160), terms, 25), random_vectors(rng, range(60), terms, 15)
    cls[5] = dict(cls[6])  # equal scores
    triples = [(1, 1, 1), (3, 2, 1), (9, 4, 2)]
    nodes = spark.createDataFrame(tree, "child long, parent long")
    out = TB.text_beam(spark.createDataFrame([(i,) for i in range(100, 162)], "row_id long"), vectors(spark, "row_id", rec),
                       vectors(spark, "class_idx", cls), nodes.filter("parent = -1").select(F.col("child").alias("node")),
                       nodes.filter("parent <> -1"), triples)
    assert set(rows(out, "row_id", "k0", "k1", "k2", "class_idx", "p")) == brute_beam(range(100, 162), rec, cls, tree, triples)


def test_text_beam_prunes_and_forms_no_table_of_all_pairs(spark):
    """A term of every text is weak: only candidates of the strong terms are completed."""
    rec = {r: {0: 0.1, r: 0.99} for r in range(1, 41)}
    cls = {c: {0: 0.1, c: 0.99} for c in range(1, 41)}
    down = spark.createDataFrame([(-1, c) for c in cls], "parent long, child long")
    index = TB.inverted_index(vectors(spark, "class_idx", cls), down)
    frontier = spark.createDataFrame([(r, -1) for r in rec], "row_id long, parent long")
    got = TB.frontier_scores(frontier, vectors(spark, "row_id", rec), vectors(spark, "class_idx", cls), index, 1)
    assert [(r, c) for r, c in rows(got, "row_id", "child")] == [(r, r) for r in rec]
    with written_plans() as plans:
        TB.text_beam(frontier.select("row_id"), vectors(spark, "row_id", rec), vectors(spark, "class_idx", cls),
                     down.select(F.col("child").alias("node")), down.filter("false"), [(1, 1, 1)])
    assert plans and not any("CartesianProduct" in p or "NestedLoop" in p for _, p in plans)


def test_text_beam_edges(spark):
    none = spark.createDataFrame([], "row_id long, term_id long, weight double")
    down = spark.createDataFrame([(1, 2), (2, 1)], "parent long, child long")
    root = spark.createDataFrame([(1,)], "node long")
    rec = spark.createDataFrame([(5,)], "row_id long")
    cls = none.withColumnRenamed("row_id", "class_idx")
    with pytest.raises(ValueError, match="cycle"):
        TB.text_beam(rec, none, cls, root, down, [(1, 1, 1)])
    assert rows(TB.text_beam(rec, none, cls, root, down.filter("false"), [(2, 1, 1)])) == [(5, 2, 1, 1, 1, 0.0)]
    for some, of in ((rec.filter("false"), root), (rec, root.filter("false"))):
        assert TB.text_beam(some, none, cls, of, down.filter("false"), [(1, 1, 1)]).collect() == []


def beam_case(spark, seed, terms, most=25):
    """Records, one without words and one without id, a tree with two nodes of two parents, and what brute force finds."""
    rng = random.Random(seed)
    tree = [(c, -1 if c < 7 else (c - 7) // 3) for c in range(60)] + [(50, 3), (51, 2), (9, 3)]
    rec, cls = random_vectors(rng, range(100, 160), terms, most), random_vectors(rng, range(60), terms, 15)
    triples = [(1, 1, 1), (3, 2, 1), (9, 4, 2)]
    nodes = spark.createDataFrame(tree, "child long, parent long")
    ids = [*range(100, 161), None]
    call = (spark.createDataFrame([(i,) for i in ids], "row_id long"), vectors(spark, "row_id", rec), vectors(spark, "class_idx", cls),
            nodes.filter("parent = -1").select(F.col("child").alias("node")), nodes.filter("parent <> -1"), triples)
    return call, brute_beam(ids, rec, cls, tree, triples)


@pytest.mark.parametrize("name,bound", [("TREE", 100), ("WIDE", 10), ("_CELLS", 50)])
def test_text_beam_by_joins_and_in_small_groups(spark, monkeypatch, name, bound):
    """A hierarchy beyond the bounds is searched by joins, one within them in groups of records: the same rows."""
    call, want = beam_case(spark, 4, list(range(30)))
    monkeypatch.setattr(TB, name, bound)
    with written_plans() as plans:
        out = TB.text_beam(*call)
    assert ("beam-probe" in [n for n, _ in plans]) == (name != "_CELLS")
    got = [tuple(r[c] for c in ("row_id", "k0", "k1", "k2", "class_idx", "p")) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)


def test_text_beam_moves_the_vector_of_a_record_once(spark):
    """A small hierarchy is walked in the record's row: one table of nodes, no table per level, no row per record and parent."""
    call, want = beam_case(spark, 5, list(range(400)))
    with written_plans() as plans:
        assert set(tuple(r) for r in TB.text_beam(*call).collect()) == want
    assert [n for n, _ in plans] == ["beam-down", "beam-index", "beam-visited"]
    assert "Window" not in plans[-1][1] and "MapInArrow" in plans[-1][1]


def test_text_beam_query_moves_only_terms_of_items(spark, tmp_path):
    """Words that no item has are in no vector that is written, yet count in its norm."""
    words = [f"w{i}" for i in range(40)]
    spark.createDataFrame([(i, " ".join(["key", *words])) for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "key one"), (1, "two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = LK.text_beam(spark, str(tmp_path))
    idf = {n: np.log(23 / (n + 1)) for n in (20, 21, 1)}
    cosine = idf[21] / np.sqrt(idf[21] ** 2 + 40 * idf[20] ** 2) * idf[21] / np.sqrt(idf[21] ** 2 + idf[1] ** 2)
    assert set(rows(got.filter("class_idx = 0").select("p"))) == {(round(cosine, 6),)}
    assert got.count() == 20 * (1 + 2 + 2)
    vectors = [d for d in os.listdir(scratch_root(spark).removeprefix("file:")) if d.startswith("beam-vectors")]
    newest = max((os.path.join(scratch_root(spark).removeprefix("file:"), d) for d in vectors), key=os.path.getmtime)
    assert spark.read.parquet(newest).filter("kind = 'record'").count() == 20


def test_text_beam_chunks_products(monkeypatch):
    """Scores in chunks, also of edges without entries and with more than a chunk's; repeated terms of a class add up."""
    down = pa.table({"parent": [-1, -1, -1, 3, 3], "child": [1, 2, 3, 1, 4]})
    entries = pa.table({"parent": [-1, -1, -1, 3, -1, 3], "term_id": [7, 9, 7, 9, 8, 5], "child": [1, 1, 1, 1, 3, 4],
                        "weight": [0.5, 0.25, 0.125, 0.25, 1.0, 0.75]})
    tree = TB._Tree.of(down, entries)
    assert tree.terms.tolist() == [5, 7, 8, 9] and tree.child.tolist() == [1, 2, 3, 1, 4]
    open_ = np.array([[1.0, 2.0, 3.0, 4.0], [0.0, 0.0, 0.0, 1.0]])
    row, edge = np.repeat([0, 1], 5), np.tile(np.arange(5), 2)
    want = [2.25, 0, 3, 1, 0.75, 0.25, 0, 0, 0.25, 0]
    for cells in (1, 2, 5, 100):
        monkeypatch.setattr(TB, "_CELLS", cells)
        assert TB._scores(tree, open_, row, edge).tolist() == want


def test_text_beam_ladder_of_diamonds_has_a_row_per_node():
    """Sixty levels of two nodes, each below both of the level above: 2 ** 60 ways, but two rows per level."""
    edges = [(-1, 0), (-1, 1)] + [(2 * i + a, 2 * i + 2 + b) for i in range(59) for a in (0, 1) for b in (0, 1)]
    down = pa.table({"parent": [p for p, _ in edges], "child": [c for _, c in edges]})
    none = pa.table({"parent": pa.array([], pa.int64()), "term_id": pa.array([], pa.int64()), "child": pa.array([], pa.int64()),
                     "weight": pa.array([], pa.float64())})
    row, triple, child, p = TB._walk(TB._Tree.of(down, none), np.zeros((3, 1)), np.array([[1, 1, 1], [2, 2, 2]]))
    assert len(row) == 3 * (60 + 120) and not p.any()
    assert child[(row == 1) & (triple == 1)].tolist() == list(range(120)) and child[(row == 2) & (triple == 0)].tolist() == list(range(0, 120, 2))


# ---------------------------------------------------------------- trained head


def test_head_training_equals_numpy_on_the_same_batches(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 6))
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(300)], "row_id long, features array<double>, label int")
    step = {r.row_id: r.step for r in df.select("row_id", HT.step_of(["row_id"], 3, 42).alias("step")).collect()}
    train, val = df.filter("row_id < 240"), df.filter("row_id >= 240")
    path = scratch_path(spark, "weights")
    history, log = HT.train_head(train.repartition(5), val, path, 4, 5, 3, 0.8, ["row_id"])
    head, epochs = HT.initial_head(6, 4), []
    for epoch in range(5):
        losses = 0.0
        for s in range(3):
            mine = [i for i in range(240) if step[i] == s]
            loss, gradient = head.gradient(x[mine], y[mine])
            losses += loss
            head = head.moved(-0.8 / len(mine) * gradient)
        kept = HT.load_head(spark, path, epoch)
        assert np.abs(kept.flat() - head.flat()).max() < 1e-9
        epochs.append((losses / 240, head.gradient(x[240:], y[240:])[0] / 60))
    got = [(r.train_loss, r.val_loss) for r in history.orderBy("epoch").collect()]
    assert np.allclose(got, epochs, atol=1e-9) and got[-1][0] < got[0][0]
    assert log.count() == 15 and log.agg(F.sum("n_links")).first()[0] == 5 * 240
    again, _ = HT.train_head(train, val, scratch_path(spark, "weights"), 4, 5, 3, 0.8, ["row_id"])
    assert np.allclose([(r.train_loss, r.val_loss) for r in again.orderBy("epoch").collect()], got, atol=1e-12)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    x, y, head = rng.normal(0, 1, (20, 6)), rng.integers(0, 2, 20), HT.initial_head(6, 3)
    _, gradient = head.gradient(x, y)
    for k in range(0, len(gradient), 3):
        step = np.zeros(len(gradient))
        step[k] = 1e-6
        slope = (head.moved(step).gradient(x, y)[0] - head.moved(-step).gradient(x, y)[0]) / 2e-6
        assert abs(slope - gradient[k]) < 1e-5


def test_empty_validation_and_no_training_links(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0], 1), (2, [0.1, 0.2], 0)], "row_id long, features array<double>, label int")
    history, _ = HT.train_head(df, df.filter("false"), scratch_path(spark, "weights"), 2, 1, 8, 0.1, ["row_id"])
    assert history.first().val_loss == 0.0
    with pytest.raises(ValueError):
        HT.train_head(df.filter("false"), df, scratch_path(spark, "weights"), 2, 1, 1, 0.1, ["row_id"])


# ---------------------------------------------------------------- windows


def test_ten_thousand_overlapping_windows(spark):
    rng, base = random.Random(8), dt.datetime(2000, 1, 1)
    wins = []
    for i in range(10000):
        lo = base + dt.timedelta(minutes=rng.randrange(3 * 365 * 1440))
        wins.append((i, lo, lo + dt.timedelta(minutes=rng.choice([0, 1, 90, 1440, 20000, 600000])), rng.randrange(50)))
    wins += [(20000, None, base, 0), (20001, base, None, 0), (20002, base, base + dt.timedelta(days=9000), None)]
    recs = [(i, base + dt.timedelta(minutes=rng.randrange(-1000, 4 * 365 * 1440))) for i in range(400)]
    recs += [(1000 + i, wins[i][1 + i % 2]) for i in range(200)] + [(5000, None)]  # on the open bounds
    windows = spark.createDataFrame(wins, "window_id long, lo timestamp, hi timestamp, priority int")
    records = spark.createDataFrame(recs, "row_id long, ts timestamp")
    with written_plans() as plans:
        out = WN.first_window(records, windows)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and not any("NestedLoop" in p for _, p in plans)
    want = {}
    for i, ts in recs:
        hit = [(p, w) for w, lo, hi, p in wins if None not in (ts, lo, hi, p) and lo < ts < hi]
        want[i] = min(hit)[1] if hit else None
    assert {r.row_id: r.window_id for r in out.collect()} == want
    kept = WN.window_buckets(windows)
    cut = kept.groupBy("level", "bucket").count().agg(F.max("count")).first()[0]
    assert cut < 1000  # windows behind one that covers the bucket are gone


def test_windows_before_1970_and_none(spark):
    records = spark.createDataFrame([(1, dt.datetime(1950, 5, 5, 12)), (2, dt.datetime(1990, 1, 1))], "row_id long, ts timestamp")
    windows = spark.createDataFrame([(7, dt.datetime(1949, 1, 1), dt.datetime(1951, 1, 1), 1)],
                                    "window_id long, lo timestamp, hi timestamp, priority int")
    assert rows(WN.first_window(records, windows)) == [(1, 7), (2, None)]
    assert {r.window_id for r in WN.first_window(records, windows.filter("false")).collect()} == {None}


def test_records_meet_the_windows_of_their_day_once(spark):
    """F3 of round 3: no record is multiplied by the levels, and windows that begin together are one on their first day."""
    base = dt.datetime(2001, 1, 1)
    wins = [(i, base, base + dt.timedelta(days=1 + i), 500 - i) for i in range(500)] + [(900, base, base + dt.timedelta(hours=5), -1)]
    windows = spark.createDataFrame(wins, "window_id long, lo timestamp, hi timestamp, priority int")
    recs = [(i % 70, base + dt.timedelta(hours=5 * i)) for i in range(2600)] + [(None, base + dt.timedelta(hours=1)), (-1, None)]
    records = spark.createDataFrame(recs, "row_id long, ts timestamp")
    buckets = WN.window_buckets(windows)
    levels = sorted(r.level for r in buckets.select("level").distinct().collect())
    days = spark.range(11323, 11323 + 600).toDF("day")
    assert WN.day_windows(days, buckets, levels).groupBy("day").count().agg(F.max("count")).first()[0] <= 3
    out = WN.first_window(records, windows)
    assert "explode" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, ts in recs:
        want[i] = min([want.get(i, (9999, None))] + [(p, w) for w, lo, hi, p in wins if ts and lo < ts < hi])
    assert {r.row_id: r.window_id for r in out.collect()} == {i: w for i, (_, w) in want.items()}


# ---------------------------------------------------------------- epochs, member sets


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 30, 100, 1001])
def test_permuted_is_a_permutation_that_depends_on_its_key(spark, n):
    df = spark.range(n).select("id", *[SP.permuted(F.col("id"), n, 42, F.lit(e)).alias(f"e{e}") for e in range(3)])
    got = df.collect()
    for e in range(3):
        assert sorted(r[f"e{e}"] for r in got) == list(range(n))
    if n > 20:
        assert [r.e0 for r in got] != [r.e1 for r in got] != [r.id for r in got]


def test_epoch_batches_need_one_numbering_and_no_sort_per_epoch(spark):
    df = spark.range(500).select((F.col("id") * 7).alias("row_id"))
    out = SP.epoch_batches(df, "row_id", 64, 4)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    per = rows(out.groupBy("epoch", "batch_id").count())
    assert per == sorted((e, b, 64 if b < 7 else 52) for e in range(4) for b in range(8))


def test_class_overlap_counts_members_on_bits(spark):
    rng = random.Random(2)
    members = {c: {rng.randrange(-200, 2000) for _ in range(rng.randint(1, 300))} for c in range(6)} | {9: {10 ** 15}, 10: {-64, 63, 64}}
    lab = spark.createDataFrame([(r, c) for c, m in members.items() for r in m] * 2, "row_id long, class_idx int")
    got = {(a, b): rest for a, b, *rest in rows(L.class_overlap(L.member_words(lab)))}
    want = {(a, b): [len(x), len(y), len(x & y), len(x | y), len(x - y)]
            for a, x in members.items() for b, y in members.items() if a < b and x & y}
    assert got == want


def test_queries_read_whole_tables(spark):
    import __spark_entry__ as E
    assert E.queries()["epoch_batches"](spark, SMOKE_DIR).count() == 4 * spark.read.parquet(f"{SMOKE_DIR}/orders.parquet").count()
