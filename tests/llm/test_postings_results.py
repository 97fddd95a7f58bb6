"""Problems 1, 2, 5 and 7 against brute force in Python, with dirty rows."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomtext.functions.text import py_normal_form
from loomtext.llm.group_top import top_n
from loomtext.llm.postings import valid_postings
from loomtext.llm.rank_fusion import combined_order, quantile_rows
from loomtext.llm.results import latest_valid, sortable
from loomtext.llm.term_counts import TermCounts
from loomtext.llm.term_weights import most_distinctive, term_weights
from loomtext.skew import join_per_key

POSTINGS = "term string, doc_id long, tf int, positions array<int>, places long, sign int, documents string"


def postings(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], POSTINGS)


def random_postings(rng, docs=30):
    rows = []
    for d in range(docs):
        for t in rng.sample(["the", "The", "straße", "STRASSE", "п’ять", "п'ять", "café", "café", *"abcdefgh"], 6):
            rows.append((t, d, rng.choice([1, 2, 5, 0, -1, None]), rng.choice([None, [rng.randrange(9)]])))
    rows += [(None, 1, 1, None), ("x", None, 1, None), *rng.sample(rows, 20), *[("hot", 3, 2, None)] * 50]
    rng.shuffle(rows)
    return rows


def counted(rows):
    out = defaultdict(int)
    for t, d, tf, _ in {(t, d, tf, tuple(p) if p else None) for t, d, tf, p in rows if t is not None and d is not None and tf and tf > 0}:
        out[d, py_normal_form(t)] += tf
    return out


def totals(cells):
    occurrences, documents = Counter(), Counter()
    for (_, t), tf in cells.items():
        occurrences[t] += tf
        documents[t] += 1
    return {t: (occurrences[t], documents[t]) for t in documents}


def stored(store):
    return {r.term: (r.occurrences, r.documents) for r in store.counts().collect()}


def test_valid_postings(spark):
    rows = random_postings(random.Random(1))
    assert {(r.doc_id, r.term): r.tf for r in valid_postings(postings(spark, rows)).collect()} == counted(rows)


def test_counts_follow_changes(spark):
    rng = random.Random(2)
    rows = random_postings(rng)
    now = {d: [r for r in rows if r[1] == d] for d in range(30)}
    store = TermCounts(spark).apply(postings(spark, rows))
    assert stored(store) == totals(counted(rows))
    changed = {d: [("new", d, 3, None), ("the", d, 1, None)] for d in (1, 2, 40)}
    store.apply(postings(spark, [r for rs in changed.values() for r in rs]), spark.createDataFrame([(2,), (5,), (6,), (99,), (None,)], "doc_id long"))
    now = {**{d: r for d, r in now.items() if d not in (5, 6)}, **changed}
    expected = totals(counted([r for rs in now.values() for r in rs]))
    assert stored(store) == expected
    store.apply(deletes=spark.createDataFrame([(1,)], "doc_id long")).apply(postings(spark, changed[1])).apply(postings(spark, []))
    assert stored(store) == expected == stored(store.compact())
    # an upsert of invalid rows only leaves the document without terms
    store.apply(postings(spark, [("gone", 40, 0, None)]))
    assert stored(store)["new"] == (6, 2)


def test_a_store_is_opened_again(spark, tmp_path):
    rng = random.Random(5)
    path, now = f"file://{tmp_path}/store", {}
    for step in range(11):
        docs = rng.sample(range(40), 6)
        dropped = rng.sample(range(40), 3)
        rows = [(t, d, rng.choice([1, 2, 0]), None) for d in docs for t in rng.sample("abcdefghij", 3)]
        store = TermCounts(spark, path, buckets=8).apply(postings(spark, rows), spark.createDataFrame([(d,) for d in dropped], "doc_id long"))
        now = {d: r for d, r in now.items() if d not in dropped} | {d: [r for r in rows if r[1] == d] for d in docs}
        if step in (0, 5, 10):
            again, cells = TermCounts(spark, path), counted([r for rs in now.values() for r in rs])
            assert stored(again) == totals(cells)
            assert {(r.doc_id, r.term): r.tf for r in again.records().collect()} == cells
            assert again._now == store._now and again._now["holding"] == len({d for d, _ in cells})
    assert len(store._now["records"]) < 9 and len(store._now["deltas"]) <= 4 and store._now["buckets"] == 8
    assert stored(TermCounts(spark, path).compact()) == totals(cells)
    other = TermCounts(spark, path)
    other.apply(deletes=spark.createDataFrame([(1,)], "doc_id long"))
    with pytest.raises(Exception, match="exist"):  # another writer was first
        store.apply(deletes=spark.createDataFrame([(2,)], "doc_id long"))


def test_only_touched_buckets_are_read(spark):
    store = TermCounts(spark, buckets=16).apply(postings(spark, [(t, d, 1, None) for d in range(200) for t in "abc"]))
    rows, read = store._records("1", [3]), store._records("1")
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert 0 < files(rows) < files(read)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    seen = []
    store._records = lambda v, b=None: seen.append(b) or TermCounts._records(store, v, b)
    store.apply(postings(spark, [("a", d, 1, None) for d in (1000, 1001)]))
    assert seen == []  # new documents only: no records are read
    store.apply(postings(spark, [("b", 7, 1, None)]))
    assert len(seen) == 1 and len(seen[0]) == 1


def test_marks(spark):
    rows = [("all", d, 1, None) for d in range(10)] + [("two", d, 1, None) for d in (0, 1)] + [("four", d, 9, None) for d in range(4)] + [("five", d, 1, None) for d in range(5)]
    got = {r.term: r.mark for r in TermCounts(spark).apply(postings(spark, rows)).marked().collect()}
    assert got == {"all": "common", "two": "rare", "four": None, "five": "common"}
    assert TermCounts(spark).apply(postings(spark, [])).marked().count() == 0 == TermCounts(spark).counts().count()


def test_weights(spark):
    rows = random_postings(random.Random(3))
    cells = counted(rows)
    length, df = Counter(), Counter()
    for (d, t), tf in cells.items():
        length[d] += tf
        df[t] += 1
    n, average = len(length), sum(length.values()) / len(length)

    def weight(d, t):
        tf = cells[d, t]
        return math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length[d] / average))

    got = term_weights(postings(spark, rows)).collect()
    assert {(r.doc_id, r.term): r.weight for r in got} == pytest.approx({k: weight(*k) for k in cells})
    best = {r.doc_id: r.term for r in most_distinctive(postings(spark, rows)).collect()}
    assert best == {d: min((-round(weight(*k), 9), k[1]) for k in cells if k[0] == d)[1] for d in length}
    assert most_distinctive(postings(spark, [])).count() == 0
    tie = [("b", 1, 1, None), ("a", 1, 1, None), ("c", 2, 1, None)]
    assert {r.doc_id: r.term for r in most_distinctive(postings(spark, tie)).collect()} == {1: "a", 2: "c"}
    for bad in ({"k1": 0}, {"b": 2}):
        with pytest.raises(ValueError):
            term_weights(postings(spark, rows), **bad)


RESULTS = "query_id long, scorer string, doc_id long, score double, scored_at timestamp, n int, s0 double, last string, k0 int, item int, salt int"


def results(spark, rows):
    return spark.createDataFrame([(*r, 0, 0.0, "x", 1, 2, 3) for r in rows], RESULTS)


def test_latest_valid(spark):
    from datetime import datetime

    t = [None, datetime(2025, 1, 1), datetime(2025, 1, 2)]
    nan = float("nan")
    rows = [
        (1, "a", 1, 5.0, t[1]), (1, "a", 1, 3.0, t[2]), (1, "a", 1, 9.0, t[0]), (1, "a", 1, nan, t[2]), (1, "a", 2, None, t[2]), (1, "a", 3, 1.0, t[0]), (1, "a", 3, 2.0, t[0]),
        (1, "a", 4, 1.0, t[1]), (1, "a", 4, 2.0, t[1]), (1, "a", 4, 2.0, t[1]), (None, "a", 1, 1.0, t[1]), (1, None, 1, 1.0, t[1]), (1, "a", None, 1.0, t[1]),
    ]
    assert {(r.doc_id, r.score) for r in latest_valid(results(spark, rows)).collect()} == {(1, 3.0), (3, 2.0), (4, 2.0)}


def test_sortable(spark):
    values = [float("-inf"), -1e300, -2.5, -1e-300, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 7e200, float("inf")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(sortable(F.col("v"))).collect()]
    assert got == sorted(got) and len(set(got)) == len(values) - 1


@pytest.mark.parametrize("seed", [1, 2])
def test_top_n_against_sorting(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g, size in (("hot", 1500), ("same", 40), ("few", 3), ("ten", 10), ("neg", 30)):
        for i in range(size):
            s = {"same": 1.0, "neg": -rng.random() * 10 ** rng.randrange(-300, 300)}.get(g, rng.choice([rng.random(), float(rng.randrange(5)), float("inf"), -0.0]))
            rows.append((1, g, rng.randrange(-(2**62), 2**62) if rng.random() < 0.5 else i, s, None))
    rows += [(1, "hot", 1, None, None), (1, "nan", 1, float("nan"), None), *[(2, "copies", 7, 1.0, None)] * 300, (2, "copies", 7, 2.0, None)]
    best = {}
    for q, g, d, s, _ in rows:
        if s is not None and not math.isnan(s):
            best[q, g, d] = max(s, best.get((q, g, d), -math.inf))
    groups = defaultdict(list)
    for (q, g, d), s in best.items():
        groups[q, g].append((-s, d))
    expected = {(q, g, d) for (q, g), v in groups.items() for _, d in sorted(v)[:10]}
    got = top_n(results(spark, rows), ["query_id", "scorer"], "score", "doc_id", 10).collect()
    assert len(got) == len(expected) and {(r.query_id, r.scorer, r.doc_id) for r in got} == expected


def test_top_n_edges(spark):
    assert top_n(results(spark, []), ["query_id"], "score", "doc_id", 3).count() == 0
    for n in (0, -1, True, 1.0):
        with pytest.raises(ValueError):
            top_n(results(spark, []), ["query_id"], "score", "doc_id", n)


def test_one_order(spark):
    rows = []
    for d in range(12):
        good = d < 3
        for scorer, scale in (("a", 1.0), ("b", 1000.0), ("c", 0.01), ("d", 5.0)):
            rows.append((1, scorer, d, scale * (10 - d if good else 1 + d / 100), None))
    rows += [(1, "b", 11, 9e9, None), (1, "a", 20, 9.5, None), (2, "a", 5, 1.0, None), (2, "a", 4, 1.0, None), (3, "a", 1, float("nan"), None)]
    got = combined_order(results(spark, rows), top=3).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(1, 0), (1, 1), (1, 2), (2, 4), (2, 5)]
    whole = {(r.query_id, r.doc_id): r.closeness for r in combined_order(results(spark, rows)).collect()}
    assert len(whole) == 15 and all(0 <= c <= 1 for c in whole.values())
    assert whole[2, 4] == whole[2, 5] == 0.5
    assert combined_order(results(spark, []), top=3).count() == 0
    with pytest.raises(ValueError):
        combined_order(results(spark, rows), winsor=(0.9, 0.1))


def test_order_against_formula(spark):
    import numpy as np

    rng = random.Random(4)
    values = np.array([[rng.lognormvariate(0, 2) for _ in range(3)] for _ in range(40)])
    rows = [(1, "abc"[j], i, float(values[i, j]), None) for i in range(40) for j in range(3)]
    lo, hi = (np.array([sorted(values[:, j])[k] for j in range(3)]) for k in (1, 37))
    w = np.clip(values, lo, hi)
    w = w - w.mean(0)
    w /= np.linalg.norm(w, axis=0)
    best, worst = w.max(0), w.min(0)
    far, near = (np.linalg.norm(w - e, axis=1) for e in (worst, best))
    got = {r.doc_id: r.closeness for r in combined_order(results(spark, rows)).collect()}
    assert [got[i] for i in range(40)] == pytest.approx((far / (far + near)).tolist(), abs=1e-8)


def test_normalisation_decides(spark):
    """Two scorers of one range: it is the norm that weighs them, so the one that spreads its scores evenly counts less."""
    spiky, even = [0.0] * 9 + [1.0], [i / 9 for i in range(10)]
    rows = [(1, s, d, v, None) for s, values in (("spiky", spiky), ("even", even[::-1])) for d, v in enumerate(values)]
    order = [r.doc_id for r in combined_order(results(spark, rows), winsor=(0, 1)).orderBy(F.desc("closeness"), "doc_id").collect()]
    z = [[(v - sum(x) / 10) / math.sqrt(sum((u - sum(x) / 10) ** 2 for u in x)) for v in x] for x in (spiky, even[::-1])]
    far, near = ([math.hypot(*(c[d] - end(c) for c in z)) for d in range(10)] for end in (min, max))
    assert order == sorted(range(10), key=lambda d: (-round(far[d] / (far[d] + near[d]), 9), d)) and order[0] == 9
    ranged = [math.hypot(spiky[d], even[::-1][d]) for d in range(10)]
    assert abs(ranged[0] - ranged[9]) < 1e-9  # by ranges alone the two would tie, and the smaller id lead


@pytest.mark.parametrize("hot", [3, 3000])
def test_quantiles_are_exact(spark, hot):
    rng = random.Random(hot)
    rows = [(0, rng.choice([rng.random(), 0.5, -1.0])) for _ in range(hot)] + [(k, rng.random()) for k in range(1, 40) for _ in range(k)]
    got = {(r.k, r.level): r.v for r in quantile_rows(spark.createDataFrame(rows, "k long, v double").repartition(7), ["k"], "v", [0.0, 0.05, 0.95, 1.0]).collect()}
    groups = defaultdict(list)
    for k, v in rows:
        groups[k].append(v)
    assert got == {(k, i): sorted(v)[max(1, math.ceil(q * len(v))) - 1] for k, v in groups.items() for i, q in enumerate([0.0, 0.05, 0.95, 1.0])}


def test_join_per_key(spark):
    rows = spark.createDataFrame([(0 if i < 5000 else i, i) for i in range(8000)], "k long, v long")
    per = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = join_per_key(rows, per, ["k"], "n")
    assert joined.count() == 8000 and joined.where("k = 0 and n = 5000").count() == 5000
