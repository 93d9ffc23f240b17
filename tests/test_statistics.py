"""Identities the statistics must satisfy, and brute-force twins on skewed fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stampline.operators import calibration as cal
from stampline.operators import decision as dec
from stampline.operators import discrimination as d
from stampline.operators import inference as inf
from stampline.operators import matching as m
from stampline.operators import resampling as rs
from stampline.session import pinned


def brute_auroc(rows):
    """rows of (y, score, weight)."""
    pos = [(s, w) for y, s, w in rows if y == 1]
    neg = [(s, w) for y, s, w in rows if y == 0]
    pairs = sum(w for _, w in pos) * sum(w for _, w in neg)
    if not pairs:
        return None
    wins = sum(a * b * (1.0 if s > t else 0.5 if s == t else 0.0) for s, a in pos for t, b in neg)
    return wins / pairs


def scored(seed, n=400, ties=True, hot=True):
    """Rows (y, score, entity, stratum); one score, entity and stratum hold a third each."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = 0.5 if hot and rng.random() < 0.34 else round(rng.random(), 2 if ties else 9)
        y = int(rng.random() < 0.2 + 0.5 * s)
        e = 0 if hot and rng.random() < 0.34 else rng.randrange(1, 30)
        g = "s0" if hot and rng.random() < 0.34 else f"s{rng.randrange(1, 6)}"
        out.append((y, s, e, g))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "y int, score double, entity long, stratum string")


@pytest.mark.parametrize("n_ranges", [None, 1, 7])
def test_auroc_matches_pairs_across_ranges(spark, n_ranges):
    for seed, ties in ((1, True), (2, False)):
        rows = scored(seed, ties=ties)
        got = d.auroc(frame(spark, rows), "y", "score", n_ranges=n_ranges).first()
        assert got.auroc == pytest.approx(brute_auroc([(y, s, 1) for y, s, _, _ in rows]), abs=1e-12)


def test_auroc_degenerate_cases(spark):
    one_class = frame(spark, [(1, 0.1, 1, "a"), (1, 0.9, 2, "a")])
    assert d.auroc(one_class, "y", "score").first().auroc is None
    constant = frame(spark, [(i % 2, 0.3, i, "a") for i in range(20)])
    assert d.auroc(constant, "y", "score").first().auroc == 0.5


@pytest.mark.parametrize("mode", ["multinomial", "poisson"])
@pytest.mark.parametrize("ranges", ["1", "3", "16"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_replicates_match_brute_force(spark, monkeypatch, mode, ranges, broadcast):
    """Same replicate values from the matrix kernel as from plain pair counting."""
    if not broadcast:
        monkeypatch.setattr(rs, "BROADCAST_DRAWS", 0)
        monkeypatch.setattr(inf, "REPLICATES_PER_PASS", 5)
    monkeypatch.setattr("stampline.functions.replicates.CELLS_PER_CHUNK", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        rows = scored(4, 240)
        df = frame(spark, rows).withColumn("cell", F.when(F.col("entity") % 2 == 0, "x").otherwise("y"))
        weights = pinned(rs.cluster_weights(df, "entity", 12, 3, mode))
        w = {(r.rep, r.entity): r.w for r in weights.collect()}
        w |= {(-1, e): 1 for _, _, e, _ in rows}
        draws = rs.entity_draws(df, "entity", 12, 3, mode)
        plain = inf.replicate_statistic(
            inf.entity_histogram(df, "y", "score", "entity", ["cell"]), draws, "entity", ["cell"])
        within = inf.replicate_statistic(
            inf.entity_histogram(df, "y", "score", "entity", ["cell"], "stratum"), draws, "entity", ["cell"], "stratum")
        got = {(r.rep, r.cell): r.value for r in plain.collect()}
        got_in = {(r.rep, r.cell): r.value for r in within.collect()}
        for rep in range(-1, 12):
            for cell in ("x", "y"):
                mine = [(y, s, w.get((rep, e), 0), g) for y, s, e, g in rows if (e % 2 == 0) == (cell == "x")]
                want = brute_auroc([r[:3] for r in mine])
                assert got.get((rep, cell)) == (pytest.approx(want, abs=1e-12) if want is not None else None)
                wins = pairs = 0.0
                for g in {r[3] for r in mine}:
                    part = [r[:3] for r in mine if r[3] == g]
                    n = sum(x for y, _, x in part if y == 1) * sum(x for y, _, x in part if y == 0)
                    if n:
                        wins, pairs = wins + brute_auroc(part) * n, pairs + n
                assert got_in.get((rep, cell)) == (pytest.approx(wins / pairs, abs=1e-12) if pairs else None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_multinomial_draws_every_slot(spark):
    df = spark.range(37).withColumnRenamed("id", "entity")
    per = rs.cluster_weights(df, "entity", 9, 1).groupBy("rep").agg(F.sum("w").alias("n")).collect()
    assert sorted((r.rep, r.n) for r in per) == [(b, 37) for b in range(9)]


def test_p_value_counts_zero_in_both_tails(spark):
    rows = [(-1, 0.4)] + [(b, v) for b, v in enumerate([0.0, 0.1, 0.2, None])]
    out = rs.summarise(spark.createDataFrame(rows, "rep int, value double"), [], 4).first()
    assert out.n_finite == 3 and out.estimate == 0.4
    assert out.p_value == pytest.approx(2 / 3)


def test_stratified_controls(spark):
    out = {r.control: r for r in inf.stat_controls(frame(spark, scored(8)), "y", "score", "stratum").collect()}
    single, twice = out["single_stratum"], out["duplicated_rows"]
    assert single.unstratified == pytest.approx(single.within_stratum)
    assert twice.within_stratum == pytest.approx(single.within_stratum)
    assert twice.n_items == 2 * single.n_items
    assert out["constant_within_stratum"].within_stratum == 0.5


def test_recovery_ratio_is_undefined_at_chance(spark):
    df = spark.createDataFrame([(0.7, 0.9), (0.7, 0.5)], "a double, b double")
    got = [r.v for r in df.select(inf.recovery_ratio(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got[0] == pytest.approx(0.5) and got[1] is None


def test_holm_uses_the_declared_size(spark):
    tests = spark.createDataFrame([("a", 0.0), ("b", 0.02), ("c", 0.5)], "t string, p double")
    out = {r.t: r for r in inf.holm(tests, "p", 5, 200).collect()}
    assert [out[t].p_holm for t in "abc"] == [0.0, pytest.approx(0.08), 1.0]
    assert out["a"].p_text == "<0.01" and out["a"].at_floor and out["b"].p_text == "0.0200"
    assert out["a"].holm_tests_pending == 2


@pytest.mark.parametrize("k", [3, 10])
def test_equal_mass_bins(spark, k):
    rng = random.Random(k)
    rows = [(i, 0.25 if rng.random() < 0.34 else round(rng.random(), 2)) for i in range(203)]
    df = spark.createDataFrame(rows, "id long, p double")
    got = {r.id: r.bin for r in cal.equal_mass_bin(df, "p", k).collect()}
    n = len(rows)
    for i, p in rows:
        rank = 1 + sum(1 for _, q in rows if q < p)
        assert got[i] == math.ceil(k * rank / n) - 1
    assert len({(p, got[i]) for i, p in rows}) == len({p for _, p in rows})  # ties share a bin


def test_constant_predictor_ece(spark):
    df = spark.createDataFrame([(int(i % 4 == 0), 0.4) for i in range(80)], "y int, p double")
    for scheme in cal.SCHEMES:
        assert cal.ece(df, "y", "p", 15, scheme).first().ece == pytest.approx(0.15)


def test_miscalibration_moves_ece_but_not_auroc(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        p = rng.betavariate(2, 8)
        rows.append((i, int(rng.random() < p), p, "a"))
    df = spark.createDataFrame(rows, "id long, y int, p double, arm string")
    bent = df.withColumn("p", F.col("p") * F.col("p"))
    assert d.auroc(df, "y", "p").first().auroc == pytest.approx(d.auroc(bent, "y", "p").first().auroc)
    good = cal.ece_null_band(df, "y", "p", "id", 15, "equal_mass", ["arm"], 60).first()
    bad = cal.ece_null_band(bent, "y", "p", "id", 15, "equal_mass", ["arm"], 60).first()
    assert good.inside_null_band and not bad.inside_null_band
    assert abs(cal.calibration_slope(df, "y", "p").first().slope - 1) < 0.15
    assert abs(cal.calibration_intercept(df, "y", "p").first().intercept) < 0.15


def test_flat_scores_have_no_slope(spark):
    df = spark.createDataFrame([(i % 2, 0.3) for i in range(30)], "y int, p double")
    assert cal.calibration_slope(df, "y", "p").first().slope is None
    assert cal.calibration_intercept(df, "y", "p").first().intercept == pytest.approx(-math.log(0.3 / 0.7))


def test_net_benefit_identities(spark):
    rng = random.Random(9)
    rows = [(int(rng.random() < 0.126), rng.random(), "a") for _ in range(2000)]
    df = spark.createDataFrame(rows, "y int, p double, arm string")
    rate = np.mean([y for y, _, _ in rows])
    for r in dec.net_benefit_curve(df, "y", "p", dec.grid(0.05, 0.5, 0.05), ["arm"]).collect():
        t = r.threshold
        assert r.treat_all == pytest.approx(rate - (1 - rate) * t / (1 - t))
        assert r.treat_none == 0.0 and r.net_benefit <= rate + 1e-12
    perfect = df.withColumn("p", F.col("y").cast("double"))
    assert dec.net_benefit_curve(perfect, "y", "p", [0.2], ["arm"]).first().net_benefit == pytest.approx(rate)
    edge = spark.createDataFrame([(1, 0.3, "a"), (0, 0.1, "a")], "y int, p double, arm string")
    assert dec.net_benefit_curve(edge, "y", "p", [0.3], ["arm"]).first().flagged_share == 0.5


def test_pair_weights_balance_the_coarse_variables(spark):
    rng = random.Random(4)
    rows = [(i, f"s{min(rng.randrange(9), 4)}", rng.random(), int(rng.random() < 0.3)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, c string, x double, lab int").withColumn("stratum", F.col("c"))
    out = m.balance_table(df, ["lab"], {"c": "c"}, ["x"], "stratum").collect()
    assert all(abs(r.smd_after) < 1e-9 for r in out if r.scale == "coarsened")
    assert {r.scale for r in out} == {"coarsened", "underlying"}


def test_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(15.0,), (15.1,), (30.0,), (60.0,), (61.0,), (None,)], "delay_minutes double")
    got = [r.b for r in df.select(m.DELAY.column().alias("b")).collect()]
    assert got == ["<=15", "15-30", "15-30", "30-60", ">60", None]


def test_undefined_outcomes_are_no_outcomes(spark):
    from stampline.operators.arms import score_arm
    from stampline.operators.discrimination import brier

    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.2), ("a", -999, 0.5)], "arm string, y int, score double")
    assert brier(df, "y", "score").first().brier == pytest.approx((0.01 + 0.04) / 2)
    row = score_arm(df, ["arm"]).first()
    assert (row.n_items, row.n_positives, row.prevalence) == (2, 1, 0.5)


def test_a_missing_scheme_is_not_calibrated(spark):
    from stampline.operators.decision import usable_probability_verdict

    ece = spark.createDataFrame([("a", "w", True), ("a", "m", True), ("b", "w", True), ("c", "w", True), ("c", "m", None)],
                                "label string, scheme string, inside_null_band boolean")
    nb = spark.createDataFrame([(x, 0.1) for x in "abc"], "label string, net_benefit double")
    got = {r.label: r.usable_probabilities for r in usable_probability_verdict(ece, nb, ["label"]).collect()}
    assert got == {"a": True, "b": False, "c": False}


@pytest.mark.parametrize("n_boot,text", [(200, "<0.01"), (400, "<0.005"), (600, "<0.003333333333"), (10000, "<0.0002")])
def test_the_floor_is_not_rounded(spark, n_boot, text):
    from stampline.operators.inference import holm

    row = holm(spark.createDataFrame([(0.0,)], "p double"), "p", 1, n_boot).first()
    assert row.p_text == text


def test_pairs_beyond_a_long(spark):
    """Three thousand million rows of each class in one stratum, given as counts."""
    from pyspark.sql import functions as F

    from stampline.operators.matching import stratum_labels

    df = spark.range(4).select(F.lit("s").alias("stratum"), (F.col("id") % 2).cast("int").alias("h"))
    per = stratum_labels(df, ["h"], "stratum")
    assert dict(per.dtypes)["n_pairs"] == "double"
    big = spark.createDataFrame([(3_000_000_000, 4_000_000_000)], "n_pos long, n_neg long")
    assert big.select(F.col("n_pos").cast("double") * F.col("n_neg")).first()[0] == 1.2e19


def test_the_ratio_takes_rows_that_the_reference_scored(spark):
    from stampline.operators.inference import recovery_ratio_fixed_denominator

    rows = spark.createDataFrame([(i, i % 5, i % 2, (i % 2) * 0.5 + (i % 7) / 20) for i in range(40)]
                                 + [(100 + i, i, 1, 0.0) for i in range(5)],
                                 "item_id long, entity long, y int, score double")
    names = spark.createDataFrame([("d", 0.8)], "name string, denominator double")
    other = rows.where("item_id < 40")
    got = recovery_ratio_fixed_denominator(rows, names, "entity", 20, 0.7, reference=other).first()
    want = recovery_ratio_fixed_denominator(other, names, "entity", 20, 0.7).first()
    assert (got.estimate, got.ci_lo) == (want.estimate, want.ci_lo)


def test_arms_with_different_rows_share_their_draws(spark):
    """The ratio of an arm does not change when another arm scored other items."""
    def rows(arm, items, step):
        return [(arm, "h", i, i % 9, i % 2, ((i * step) % 11) / 11) for i in items]

    schema = "arm string, label string, item_id long, entity long, y int, score double"
    base = rows("ref", range(90), 3) + rows("a", range(90), 5)
    both = spark.createDataFrame(base + rows("b", range(45, 90), 7), schema)

    def ratio(arms):
        out = inf.recovery_ratio_ci(both, arms, "ref", ["label"], "item_id", "entity", 30, 0.7, ("a", "h"))
        return {r.arm: (r.estimate, r.ci_lo, r.ci_hi) for r in out.collect()}

    assert ratio(["a", "b"])["a"] == ratio(["a"])["a"]


def test_pairs_of_a_sensitivity_table_keep_their_own_rows(spark):
    """Two pairs at once give what each gives alone, though one arm scored fewer items of the same entities."""
    def rows(arm, items, step):
        return [(arm, "h", i, i % 9, i // 9 % 2, ((i * step) % 11) / 11) for i in items]

    table = spark.createDataFrame(rows("ref", range(90), 3) + rows("a", range(90), 5) + rows("b", range(45, 90), 7),
                                  "arm string, label string, item_id long, entity long, y int, score double")

    def got(pairs):
        out = inf.arm_sensitivity(table, pairs, "ref", ["label"], "item_id", "entity", 30)
        return {(r.question, r.quantity, r.arm): (r.estimate, r.ci_lo, r.ci_hi, r.n_items, r.declared_arm)
                for r in out.collect()}

    first, second = ("a", "ref", "one"), ("b", "a", "two")
    both = got([first, second])
    assert both == {**got([first]), **got([second])}
    assert {v[3] for k, v in both.items() if k[0] == "two"} == {45}
