import random

import pytest
from brute import WORD, targets
from hypothesis import given, settings
from hypothesis import strategies as st

from taxolink.llm import mixing


def _docs(seed, n=600):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        s = "big" if r.random() < 0.4 else r.choice(["a", "b", "c", None, "ö"])
        size = 3 if r.random() < 0.3 else int(r.lognormvariate(3, 1))
        docs.append((i, s, " ".join("w" for _ in range(size)) if r.random() > 0.02 else None))
    return docs + [(n, "huge", "x " * 30000), (n + 1, "void", ""), (n + 2, "void", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_contract(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "BIN_ROWS", 4)
    docs = _docs(seed)
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3)
    rows = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    size = {i: len(WORD.findall(t or "")) for i, _, t in docs}
    per = {}
    for i, s, _ in docs:
        per[s] = per.get(s, 0) + size[i]
    want = targets(per, (5, 2, 1), 1.5, 2.0)
    taken = dict.fromkeys(per, 0)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.size, r.source_size) == (size[r.doc_id], per[r.source])
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s in per:
        if s != "huge":  # one document: whole copies only
            assert abs(taken[s] - want[s]) <= 1.0


def test_documents_come_as_often_as_taken(spark):
    docs = _docs(3, 100)
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, source string, text string, mix_copies string")
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    seen = {}
    for r in out.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {i: n for i, n in copies.items() if n}


@pytest.mark.parametrize("ids", ["null", "same", "some", "alike"])
def test_rows_without_or_with_the_same_id_come_as_often_as_planned(spark, ids):
    r = random.Random(5)
    docs = [({"null": None, "same": 7, "some": r.choice([None, 1, i]), "alike": 7}[ids], r.choice(["a", "b", None]),
             " ".join(["w"] * 3 if ids == "alike" else r.choices("uvw", k=r.randint(1, 40)))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")

    def words(rows):
        out = {}
        for source, n in rows:
            out[source] = out.get(source, 0) + n
        return out

    planned = words((x.source, x.taken) for x in mixing.mix(df).collect())
    assert words((x.source, len(x.text.split())) for x in mixing.mixed_documents(df).collect()) == planned
    assert sum(planned.values()) > 0


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a", "x y z")] * 9 + [(2, "b", "q")], "doc_id long, source string, text string")
    assert mixing.mix(df).count() == 10
    assert mixing.mix(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 6), min_size=1, max_size=6), st.integers(0, 400))
def test_fit_is_the_best_subset_sum(counts, budget):
    lengths = sorted(counts)
    take = mixing.fit_counts(lengths, [counts[x] for x in lengths], budget, dp_words=100000)
    assert all(0 <= t <= counts[x] for x, t in zip(lengths, take))
    sums = {0}
    for x in lengths:
        for _ in range(counts[x]):
            sums |= {s + x for s in sums}
    assert sum(x * t for x, t in zip(lengths, take)) == max(s for s in sums if s <= budget)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 300), st.integers(1, 200), min_size=1, max_size=30), st.floats(0, 1))
def test_fit_of_large_budgets_stays_below_and_close(counts, part):
    lengths = sorted(counts)
    total = sum(x * c for x, c in counts.items())
    budget = int(part * total)
    take = mixing.fit_counts(lengths, [counts[x] for x in lengths], budget, dp_words=500)
    used = sum(x * t for x, t in zip(lengths, take))
    assert all(0 <= t <= counts[x] for x, t in zip(lengths, take))
    assert budget - max(lengths) <= used <= budget


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 6), min_size=1, max_size=6), st.integers(0, 400))
def test_fit_from_both_sides_is_the_nearest_subset_sum(counts, budget):
    lengths = sorted(counts)
    take = mixing.fit_counts(lengths, [counts[x] for x in lengths], budget, dp_words=100000, above=True)
    assert all(0 <= t <= counts[x] for x, t in zip(lengths, take))
    sums = {0}
    for x in lengths:
        for _ in range(counts[x]):
            sums |= {s + x for s in sums}
    assert abs(sum(x * t for x, t in zip(lengths, take)) - budget) == min(abs(s - budget) for s in sums)


@pytest.mark.parametrize("lengths,target,taken", [
    ([30000], 29000, 30000), ([30000], 14000, 0), ([30000], 16000, 30000), ([30000], 59000, 60000), ([30000], 44000, 30000),
    ([20000, 30000], 29000, 30000), ([50000, 60000, 70000], 131000, 130000), ([30000], 60000, 60000)])
def test_few_very_long_documents_come_as_near_as_they_can(lengths, target, taken):
    pdf = mixing.pd.DataFrame({"source_key": "=a", "size": lengths, "n": 1, "source_size": sum(lengths), "target": float(target)})
    plan = mixing._plan(pdf)
    assert ((plan["whole"] + plan["extra"]) * plan["size"]).sum() == taken
    assert (plan["whole"] + plan["extra"]).max() <= 2
