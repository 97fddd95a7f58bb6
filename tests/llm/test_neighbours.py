"""Problem 4 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm.neighbours import hilbert_keys, similar_vectors


def test_hilbert_is_a_curve():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    out = {}
    for i, a in enumerate(ids):
        order = sorted((-round(c, 6), b) for c, b in zip(cos[i], ids) if c > -2 and c >= least)[:k]
        out[a] = [b for _, b in order]
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((150, 16))
    x = np.concatenate([centres + 0.12 * rng.standard_normal(centres.shape) for _ in range(4)] + [rng.standard_normal((100, 16))]).astype(np.float32)
    x[500:520] = x[0]  # copies
    x[520] = 3 * x[1]
    ids = (np.arange(len(x)) * 3 + 1).tolist()
    rows = [(i, v.tolist(), 1.0, 2) for i, v in zip(ids, x)]
    bad = [None, [], [1.0], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16]
    rows += [(10**6 + n, v, 1.0, 2) for n, v in enumerate(bad)] + [(None, x[0].tolist(), 1.0, 2)]
    df = spark.createDataFrame(rows, "id long, vec array<float>, cosine double, n int")
    got = {}
    for r in similar_vectors(df, "id", "vec", dim=16, k=5, least=0.86, curves=12, window=32, axes=8, bits=4).collect():
        got.setdefault(r.item, {})[r.place] = r.other
    expected = brute(ids, x.astype(np.float64), 5, 0.86)
    pairs = lambda d: {(a, b) for a, bs in d.items() for b in bs}
    found = pairs({a: list(p.values()) for a, p in got.items()})
    assert len(found & pairs(expected)) / len(pairs(expected)) >= 0.97
    assert len(found - pairs(expected)) <= 0.02 * len(found)
    copies = sorted([ids[0], *ids[500:520]])
    for a in copies:
        assert [got[a][p] for p in range(1, 6)] == [c for c in copies if c != a][:5]
    assert max(got) < 10**6


def test_edges(spark):
    schema = "id long, vec array<float>"
    assert similar_vectors(spark.createDataFrame([], schema), "id", "vec", dim=16).count() == 0
    one = spark.createDataFrame([(1, [1.0] * 16), (1, [1.0] * 16)], schema)
    assert similar_vectors(one, "id", "vec", dim=16).count() == 0
    two = spark.createDataFrame([(1, [1.0] * 16), (2, [-1.0] * 16)], schema)
    assert [(r.item, r.other, r.cosine) for r in similar_vectors(two, "id", "vec", dim=16).orderBy("item").collect()] == [(1, 2, -1.0), (2, 1, -1.0)]
    with pytest.raises(ValueError):
        similar_vectors(two, "id", "vec", dim=16, axes=20)


def test_more_equal_keys_than_the_window(spark):
    rng = np.random.default_rng(5)
    one = rng.standard_normal(16).astype(np.float32)
    scaled = one * rng.uniform(0.2, 5, (150, 1)).astype(np.float32)
    near = rng.standard_normal(16) + 1e-4 * rng.standard_normal((150, 16))
    x = np.concatenate([scaled, near, rng.standard_normal((100, 16))]).astype(np.float32)
    ids = rng.permutation(1000)[: len(x)].tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id long, vec array<float>")
    got = {}
    for r in similar_vectors(df, "id", "vec", dim=16, k=5, least=0.86, curves=4, window=16, axes=8, bits=4).collect():
        got.setdefault(r.item, {})[r.place] = r.other
    expected = brute(ids, x.astype(np.float64), 5, 0.86)
    hot = ids[:300]
    right = sum([got.get(i, {}).get(p) for p in range(1, 6)] == expected[i] for i in hot)
    assert right >= 0.99 * len(hot)


def test_borders_repeated_ids_and_asking_rows(spark, parts=12):
    """Isotropic vectors in many range partitions, of which only some rows ask; ids that occur with several vectors."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, rng.standard_normal(16).tolist()) for i in range(0, 3000, 50)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "id long, vec array<float>")
        found = similar_vectors(df, "id", "vec", dim=16, k=5, curves=6, window=400, axes=6, bits=6, asks=F.col("id") % 10 == 1).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    got = {}
    for r in found:
        got.setdefault(r.item, {})[r.place] = r.other
    kept = [i for i in range(3000) if i % 50]
    expected = brute(kept, x[kept].astype(np.float64), 5, -1)
    assert sorted(got) == list(range(1, 3000, 10)) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    sure = {i: [o for o in got[i].values() if o % 50] for i in got}
    missed = sum(len(set(expected[i][: len(sure[i])]) - set(sure[i])) for i in got)
    assert missed <= 0.05 * 5 * len(got)
