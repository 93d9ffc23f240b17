"""Ordered operators give the same answer whether or not keys are cut into slices."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stampline.functions.ordered import asof, position, running_before
from stampline.operators import features as f

BASE = dt.datetime(2024, 1, 1)
TS = "timestamp_ntz"


def event_frames(spark, seed, n=300):
    """Half of the rows belong to one key; times tie often."""
    rng = random.Random(seed)

    def rows(count):
        return [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}" if rng.random() < 0.95 else None,
                 BASE + dt.timedelta(minutes=rng.randrange(120))) for i in range(count)]

    left = rows(n)
    right = [(k, t if rng.random() < 0.95 else None, f"v{i}") for i, k, t in rows(n // 3)]
    return (left, right, spark.createDataFrame(left, f"id long, k string, t {TS}"),
            spark.createDataFrame(right, f"k string, rt {TS}, v string"))


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("budget", [None, 7])
def test_asof_matches_brute_force(spark, strict, direction, budget):
    left, right, ldf, rdf = event_frames(spark, 5)
    got = {r.id: (r._hit.t, r._hit.v) if r._hit else None for r in
           asof(ldf, rdf, ["k"], "t", "rt", ["v"], strict, direction, budget).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        if direction == "backward":
            hits = [(rt, v) for rk, rt, v in right if rt and k and rk == k and (rt < t if strict else rt <= t)]
            want = max(hits) if hits else None
        else:
            hits = [(rt, v) for rk, rt, v in right if rt and k and rk == k and (rt > t if strict else rt >= t)]
            want = min(hits) if hits else None
        assert got[i] == want


@pytest.mark.parametrize("budget", [None, 5])
def test_positions_match_brute_force(spark, budget):
    left, _, ldf, _ = event_frames(spark, 6)
    order = F.unix_micros(F.col("t").cast("timestamp"))
    strict = {r.id: r.position for r in position(ldf, ["k"], order, rows_per_slice=budget).collect()}
    count = {r.id: r.position for r in position(ldf, ["k"], order, ["id"], "cumcount", rows_per_slice=budget).collect()}
    for i, k, t in left:
        assert strict[i] == sum(1 for j, k2, t2 in left if k2 == k and t2 < t)
        assert count[i] == sum(1 for j, k2, t2 in left if k2 == k and (t2, j) < (t, i))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("budget", [None, 4])
def test_running_sum_matches_brute_force(spark, descending, budget):
    rng = random.Random(3)
    rows = [("a" if i < 60 else "b", i / 7.0, float(rng.randrange(9))) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, s double, x double")
    out = running_before(df, ["k"], "s", {"b": "x"}, descending, budget)
    for r in out.collect():
        want = sum(x for k, s, x in rows if k == r.k and (s > r.s if descending else s < r.s))
        assert r.b == pytest.approx(want)


def test_cover_falls_back_when_the_interval_closed(spark):
    left = spark.createDataFrame([(1, BASE + dt.timedelta(hours=h)) for h in (1, 3, 9)], f"k long, t {TS}")
    inner = spark.createDataFrame([(1, BASE + dt.timedelta(hours=2), "icu", BASE + dt.timedelta(hours=5))],
                                  f"k long, s {TS}, u string, e {TS}")
    plain = f.covering_latest(left, inner, ["k"], "t", "s", "u", "none").orderBy("t").collect()
    ended = f.covering_latest(left, inner, ["k"], "t", "s", "u", "none", end="e").orderBy("t").collect()
    assert [r.unit for r in plain] == ["none", "icu", "icu"]
    assert [r.unit for r in ended] == ["none", "icu", "none"]


def test_audit_catches_the_injected_leak(spark):
    rows = [(i, float(i), BASE, BASE + dt.timedelta(minutes=90)) for i in range(100)]
    df = spark.createDataFrame(rows, f"id long, x double, t {TS}, close {TS}")
    registry = [f.Feature("x", "acq_pre", "index")]
    clean = f.stamp_availability(df, registry, {"index": "t"})
    assert f.audit_summary(f.leakage_audit(clean, registry, "t")).first().result == "PASS"
    leaked = f.inject_leak(clean, "x", "close", "id")
    row = f.leakage_audit(leaked, registry, "t").first()
    assert (row.status, row.late_rows, row.max_late_minutes) == ("violation", 20, 90.0)
    assert f.audit_summary(f.leakage_audit(leaked, registry, "t")).first().result == "FAIL"
    bare = clean.withColumn("available_at__x", F.when(F.col("id") > 3, F.col("t")))
    assert f.leakage_audit(bare, registry, "t").first().unstamped_values == 4
    with pytest.raises(ValueError, match="not produced"):
        f.stamp_availability(df, [f.Feature("y", "acq_pre", "index")], {"index": "t"})
