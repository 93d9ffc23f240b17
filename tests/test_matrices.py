"""Replicate matrices against plain recomputation: equal-mass bins, logistic fits, callbacks of the caller."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stampline.functions import matrices as mx
from stampline.operators import calibration as cal
from stampline.operators import resampling as rs
from stampline.session import pinned


def rows_of(seed, n=300):
    """(y, p, entity, cell): a third of all rows at one score, a third of one entity, ties throughout."""
    rng, out = random.Random(seed), []
    for i in range(n):
        p = 0.4 if rng.random() < 0.34 else round(rng.random(), 2)
        e = 0 if rng.random() < 0.34 else rng.randrange(1, 25)
        out.append((int(rng.random() < p), p, e, "x" if i % 3 else "y"))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "y int, p double, entity long, cell string")


def drawn(df, n_boot, mode):
    w = {(r.rep, r.entity): r.w for r in rs.cluster_weights(df, "entity", n_boot, 3, mode).collect()}
    return w | {(-1, r.entity): 1 for r in df.select("entity").distinct().collect()}


def brute_ece(rows, k):
    """rows of (y, p, weight)."""
    rows = sorted((p, y, w) for y, p, w in rows if w)
    total = sum(w for *_, w in rows)
    bins = {}
    for p, y, w in rows:
        rank = 1 + sum(v for q, _, v in rows if q < p)
        b = bins.setdefault(math.ceil(k * rank / total) - 1, [0, 0, 0.0])
        b[0], b[1], b[2] = b[0] + w, b[1] + w * y, b[2] + w * p
    return sum(n * abs(s / n - t / n) for n, s, t in bins.values()) / total


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("mode", ["multinomial", "poisson"])
@pytest.mark.parametrize("ranges,broadcast", [(1, True), (7, True), (16, False)])
def test_equal_mass_bins_of_every_replicate(spark, monkeypatch, few_partitions, mode, ranges, broadcast):
    """Ties are cut by range borders, since ranges also split on the entity."""
    few_partitions(ranges)
    monkeypatch.setattr(mx, "CELLS_PER_CHUNK", 60)
    monkeypatch.setattr(cal, "SUMS_PER_PASS", 5)
    if not broadcast:
        monkeypatch.setattr(mx, "BROADCAST_CARRY", 0)
        monkeypatch.setattr(rs, "BROADCAST_DRAWS", 0)
    rows = rows_of(ranges)
    df = frame(spark, rows)
    order = ["cell", "score", "entity"]
    hist = cal.score_histogram(df, "y", "p", ["cell", "entity"]).repartitionByRange(*order).sortWithinPartitions(*order)
    hist = pinned(cal.tag_first(hist, ["cell"]))
    if ranges > 1:
        edges = hist.where("score = 0.4").select(mx.RANGE).distinct().count()
        assert edges > 1
    sums = cal.replicate_mass_bins(hist, rs.entity_draws(df, "entity", 12, 3, mode), "entity", ["cell"], 6)
    curve = sums.withColumn("gap", F.col("pos") / F.col("n") - F.col("sp") / F.col("n"))
    got = {(r.rep, r.cell): r.ece for r in cal.ece_of(curve, ["rep", "cell"]).collect()}
    w = drawn(df, 12, mode)
    assert len(got) == 26
    for (rep, cell), value in got.items():
        assert value == pytest.approx(brute_ece([(y, p, w.get((rep, e), 0)) for y, p, e, c in rows if c == cell], 6), abs=1e-12)


def test_equal_mass_interval_equals_the_point_without_keys(spark):
    df = frame(spark, rows_of(9))
    out = cal.ece_ci(df, "y", "p", "entity", 15, "equal_mass", [], 20).first()
    assert out.estimate == pytest.approx(cal.ece(df, "y", "p", 15, "equal_mass").first().ece, abs=1e-12)
    assert out.n_finite == 20 and out.ci_lo <= out.ci_hi


@pytest.mark.parametrize("mode", ["multinomial", "poisson"])
def test_fits_of_every_replicate(spark, monkeypatch, mode):
    """The matrix loop against fits of the repeated rows, cell by cell."""
    monkeypatch.setattr(cal, "SUMS_PER_PASS", 4)
    rows = rows_of(5) + [(1, 0.3, 500 + i, "one class") for i in range(9)] + [(i % 2, 0.3, 600 + i, "flat") for i in range(30)]
    df = frame(spark, rows)
    hist = pinned(cal.score_histogram(df, "y", "p", ["cell", "entity"]))
    draws = rs.entity_draws(df, "entity", 9, 3, mode)
    weighted = rs.with_replicates(hist, draws, "entity").groupBy("rep", "cell", "score").agg(
        F.sum(F.col("pos") * F.col("w")).alias("pos"), F.sum((F.col("pos") + F.col("neg")) * F.col("w")).alias("n")) \
        .withColumn("x", cal.logit(F.col("score")))
    want = {(r.rep, r.cell): (r.intercept, r.slope) for r in cal.fit_cells(pinned(weighted), ["rep", "cell"]).collect()}
    got = {}
    for first in (0, 4, 8):
        part = hist.select("cell", "entity", "pos", (F.col("pos") + F.col("neg")).alias("n"), cal.logit(F.col("score")).alias("x"))
        part = rs.with_weights(part, draws.part(first, 4), "entity").withColumns(
            {"nx": F.col("n") * F.col("x"), "nxx": F.col("n") * F.col("x") * F.col("x"), "sq": F.lit(0.0)})
        for r in cal.replicate_fits(pinned(part), ["cell"], first).collect():
            assert (r.rep, r.cell) not in got
            got[r.rep, r.cell] = (r.intercept, r.slope)
    for key, values in want.items():
        for a, b in zip(got[key], values):
            assert a == (pytest.approx(b, abs=1e-6) if b is not None else None), key
    assert got[-1, "one class"] == (None, None) and got[-1, "flat"][1] is None and got[-1, "flat"][0] is not None


def test_fit_interval_shape(spark):
    out = cal.calibration_fit_ci(frame(spark, rows_of(6)), "y", "p", "entity", [], 30).collect()
    assert sorted(r.quantity for r in out) == ["brier", "intercept", "slope"]
    assert all(r.n_finite == 30 and r.ci_lo <= r.estimate <= r.ci_hi for r in out)
    none = cal.calibration_fit_ci(frame(spark, []), "y", "p", "entity", ["cell"], 5)
    assert none.collect() == []


def deviation():
    """Weighted standard deviation of p: three sums per replicate."""
    def add(state, rows, weights):
        p = rows["p"]
        return state + np.stack([p ** i for i in range(3)]) @ weights

    def finish(state):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.sqrt(np.maximum(state[2] / state[0] - (state[1] / state[0]) ** 2, 0))

    return mx.Mergeable(lambda width: np.zeros((3, width)), add, lambda a, b: a + b, finish)


@pytest.mark.parametrize("mode", ["multinomial", "poisson"])
def test_callback_equals_the_dataframe_path(spark, monkeypatch, few_partitions, mode):
    monkeypatch.setattr(mx, "CELLS_PER_CHUNK", 50)
    monkeypatch.setattr(rs, "SUMS_PER_PASS", 7)
    monkeypatch.setattr(mx, "PIECES", 2)
    few_partitions(6)
    df = frame(spark, rows_of(11)).repartition(6)

    def statistic(rows, keys):
        n, s, q = (F.sum(F.col("w") * F.pow("p", i)) for i in range(3))
        return rows.groupBy(*keys).agg(F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("value"))

    want = {r.cell: r for r in rs.clustered_stat_ci(df, "entity", statistic, ["cell"], 25, 1, mode).collect()}
    got = {r.cell: r for r in rs.clustered_callback_ci(df, "entity", deviation(), ["p"], ["cell"], 25, 1, mode).collect()}
    assert got.keys() == want.keys()
    for cell in want:
        assert (got[cell].n_finite, got[cell].n_groups) == (want[cell].n_finite, want[cell].n_groups)
        for c in ("estimate", "ci_lo", "ci_hi", "p_value"):
            assert got[cell][c] == pytest.approx(want[cell][c], abs=1e-9)


def test_callback_with_any_state_and_undefined_replicates(spark):
    """A state that is a dict of lists; the value is undefined where no row of the cell was drawn."""
    def add(state, rows, weights):
        for place in range(weights.shape[1]):
            state.setdefault(place, []).extend(np.repeat(rows["p"], weights[:, place]).tolist())
        return state

    def finish(state):
        return np.array([max(state[i]) if state.get(i) else np.nan for i in range(max(state) + 1)])

    largest = mx.Mergeable(lambda width: {}, add, lambda a, b: {k: a.get(k, []) + b.get(k, []) for k in {*a, *b}}, finish)
    df = frame(spark, rows_of(2, 40) + [(1, 0.9, 777, "alone")])
    out = {r.cell: r for r in rs.clustered_callback_ci(df, "entity", largest, ["p"], ["cell"], 40).collect()}
    assert out["alone"].estimate == 0.9 and 0 < out["alone"].n_finite < 40
    assert out["x"].estimate == max(p for _, p, _, c in rows_of(2, 40) if c == "x")
