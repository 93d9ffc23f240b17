"""Hard negatives: against a plain version, in grids of several cells, bounds, edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stampline.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    good = []
    for i, v, y in rows:
        if None in (i, v, y) or any(x is None or not math.isfinite(x) for x in v):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        good.append((i, [math.floor(256 * float(np.float32(x))) for x in v], y))
    anchors, out = {(i, tuple(v), y) for i, v, y in good if i % 100 == 0}, []
    for a, va, ya in anchors:
        def first(rows):
            return sorted(rows, key=lambda r: (-r[1], r[0]))[:5]

        scored = [(i, sum(p * q for p, q in zip(v, va)), y) for i, v, y in good if len(v) == len(va)]
        for p, s, _ in first(r for r in scored if r[2] == ya and r[0] != a):
            band = first(r for r in scored if r[2] != ya and 80 * s <= 100 * r[1] <= 100 * s)
            out += [(a, p, k, n, s, t) for k, (n, t, _) in enumerate(band, 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in N.mined_negatives(df).collect())


def vectors(seed, n, dim=16, labels=3, near=0.2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dim))
    out = []
    for i in range(n):
        v = centre[rng.integers(4)] + near * rng.normal(size=dim)
        out.append((i * 10, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(labels))))
    return out


def test_given_vectors_in_a_grid(spark, monkeypatch):
    rows = vectors(1, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows)
    assert want and mined(df) == want
    monkeypatch.setattr(N, "PART", 90)
    monkeypatch.setattr(N, "GROUP", 12)
    assert mined(df) == want


def test_ties_repeats_hot_labels_and_few_rows(spark):
    rng = random.Random(2)
    rows = [(i * 20, [float(rng.randrange(3)) for _ in range(4)], 1 if i % 3 else 2) for i in range(120)]
    rows += rows[:40]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    few = [(0, [1.0, 1.0], 4), (1, [1.0, 0.9], 5), (2, [1.0, 0.8], 6), (3, [1.0, 1.0], 5)]
    assert mined(spark.createDataFrame(few, SCHEMA)) == plain(few) != []
    alone = [(100, [1.0], 1)]
    assert mined(spark.createDataFrame(alone, SCHEMA)) == []


def test_odd_rows(spark):
    rows = vectors(3, 60) + [(None, [1.0] * 16, 1), (5000, None, 1), (5100, [1.0] * 16, None), (5200, [None] + [1.0] * 15, 1),
                             (5300, [float("nan")] * 16, 1), (5400, [float("inf")] * 16, 1), (5500, [], 1), (5600, [], 1),
                             (5601, [], 2), (5700, [0.5] * 3, 1), (5701, [0.5] * 3, 2), (5702, [0.5] * 3, 1), (0, [1.0] * 16, 3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(7) for n in ("id", "key", "vector", "scores", "cell", "n", "r", "g")})
    assert mined(df) == plain(rows)
    assert mined(spark.createDataFrame([], SCHEMA)) == []


def test_large_components_stay_exact(spark):
    rows = [(i * 50, [float(1000 + i), float(-3 * i), 4000.0 - i], i % 2) for i in range(30)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def block(vectors, labels=None):
    n = len(vectors)
    pack = next(N._pack(iter([N.pa.RecordBatch.from_arrays(
        [N.pa.array(range(n)), N.pa.array(range(n)), N.pa.array(labels or [0] * n),
         N.pa.array([[] for _ in range(n)], N.pa.list_(N.pa.int64())), N.pa.array(vectors.tolist(), N.pa.list_(N.pa.float64()))],
        names=["id", "key", "label", "scores", "vector"])])))
    return N.Block(pack.to_pylist()[0])


@pytest.mark.parametrize("dim", [1, 3, 4, 16, 48])
def test_bounds_hold_at_every_level(dim):
    rng = np.random.default_rng(dim)
    a, b = (block(np.floor(rng.normal(20, 100, (50, dim)))) for _ in range(2))
    score = a.vectors.astype(int) @ b.vectors.astype(int).T
    assert [len(x[0][0]) for x in a.levels] == N.segments_of(dim)
    last = None
    for (m, d, n), (m2, d2, _) in zip(a.levels, b.levels):
        middle, reach = n * m @ m2.T, d @ d2.T
        assert (middle - reach <= score + 1).all() and (score <= middle + reach + 1).all()
        assert last is None or (reach <= last + 1e-3).all() or dim < 48
        last = reach


def test_survivors_are_all_pairs_in_the_band():
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 200, (3, 16)) + 100
    a, b = (block(np.floor(centre[rng.integers(3, size=200)] + rng.normal(0, 5, (200, 16)))) for _ in range(2))
    score = a.vectors.astype(int) @ b.vectors.astype(int).T
    low, high = np.quantile(score, 0.98, axis=1).astype(int), np.quantile(score, 0.995, axis=1).astype(int)
    left = np.ones(score.shape, bool)
    i, j, s = N.survivors(a, slice(0, 200), b, left, low, high)
    want = (score >= low[:, None]) & (score <= high[:, None])
    assert {*zip(i.tolist(), j.tolist())} == {*zip(*(x.tolist() for x in np.nonzero(want)))}
    assert (s == score[i, j]).all() and left.mean() < 0.9
