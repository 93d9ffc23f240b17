"""Replicates from sums per cell and score: same values as from rows that carry weights, and no such rows."""

import random

import pytest
from pyspark.sql import functions as F

from stampline.operators import inference as inf
from stampline.operators import resampling as rs


def rows(spark, n=300, seed=5):
    rng = random.Random(seed)
    data = [(int(rng.random() < 0.4), round(rng.random(), 1), rng.randrange(40), f"s{rng.randrange(3)}", rng.choice(["x", None]))
            for _ in range(n)]
    return spark.createDataFrame(data, "y int, score double, entity long, stratum string, cell string")


def values(spark, mode):
    df = rows(spark)
    draws = rs.entity_draws(df, "entity", 9, 2, mode)
    hist = inf.entity_histogram(df, "y", "score", "entity", ["cell"], "stratum")
    return {(r.rep, r.cell): r.value for r in inf.replicate_statistic(hist, draws, "entity", ["cell"], "stratum").collect()}


@pytest.mark.parametrize("mode", ["multinomial", "poisson"])
def test_repeated_scores_carry_no_weights(spark, monkeypatch, mode):
    """Draws too large for a broadcast were joined to every row; sums per cell and score move none."""
    with monkeypatch.context() as patch:
        patch.setattr(inf, "fits", lambda *_: False)
        carried = values(spark, mode)
    monkeypatch.setattr(rs, "BROADCAST_DRAWS", 0)
    monkeypatch.setattr("stampline.functions.cellsums.ENTITIES", 7)
    monkeypatch.setattr("stampline.functions.cellsums.REPLICATES", 4)
    monkeypatch.setattr("stampline.functions.cellsums.SUMS_PER_TASK", 1000)

    def refused(*_):
        raise AssertionError("rows were joined with their weights")

    monkeypatch.setattr(inf, "with_weights", refused)
    got = values(spark, mode)
    assert set(got) == {(rep, cell) for rep in range(-1, 9) for cell in ("x", None)}
    assert got == {k: pytest.approx(v, abs=1e-12) if v is not None else None for k, v in carried.items()}


def test_poisson_listing_draws_once_per_entity(spark):
    """A filter on the length of the array was pushed below the distinct entities: one draw per row and replicate."""
    df = spark.range(100).select((F.col("id") % 3).alias("entity"))
    plan = rs.cluster_weights(df, "entity", 4, 1, "poisson")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate"):]
    assert "transform" not in below.split("\n", 1)[1]


def test_seeds_are_counted_beyond_one_word(spark):
    from stampline.operators import discrimination as d

    seeds = list(range(70))
    df = spark.createDataFrame([("a", s) for s in seeds] + [("b", s) for s in seeds[:-1] + [0, 99]], "g string, seed int")
    assert dict(df.groupBy("g").agg(d.seeds_seen(seeds).alias("n")).collect()) == {"a": 70, "b": 69}
    nothing = d.seed_pool(df.where(F.col("seed") == 99).selectExpr("g", "seed", "1 as item_id", "0.5D as score"), seeds, ["g"])
    plan = d.seed_pool(df.selectExpr("g", "seed", "1 as item_id", "0.5D as score"), seeds, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert not nothing.count() and "ObjectHashAggregate" not in plan


def test_many_cells_are_banded_not_passed_over_again(spark, monkeypatch):
    """With sums of all cells too many for a task, rows were read again for every few replicates."""
    with monkeypatch.context() as patch:
        patch.setattr(inf, "fits", lambda *_: False)
        carried = values(spark, "multinomial")
    monkeypatch.setattr("stampline.functions.cellsums.SUMS_PER_TASK", 300)
    passes, whole = [], inf.replicate_shares

    def counted(*args):
        passes.append(args)
        return whole(*args)

    monkeypatch.setattr(inf, "replicate_shares", counted)
    got = values(spark, "multinomial")
    assert len(passes) == 1 and passes[0][6] > 1  # one pass, several bands
    assert got == {k: pytest.approx(v, abs=1e-12) if v is not None else None for k, v in carried.items()}


@pytest.mark.parametrize("mode", ["multinomial", "poisson"])
def test_fits_of_repeated_probabilities_carry_no_weights(spark, monkeypatch, mode):
    """Every row went through each Newton step with its weights."""
    from stampline.operators import calibration as cal

    df = rows(spark).withColumn("p", F.col("score") * 0.8 + 0.1)

    def fits():
        out = cal.calibration_fit_ci(df, "y", "p", "entity", ["cell"], 9, 2, mode)
        return {(r.cell, r.quantity): tuple(r)[2:] for r in out.collect()}

    with monkeypatch.context() as patch:
        patch.setattr(cal, "MOST_PROBABILITIES", 0)
        carried = fits()
    monkeypatch.setattr(cal, "with_weights", None)
    monkeypatch.setattr(cal, "newton_sums", None)
    got = fits()
    assert len(got) == 6 and got == {k: pytest.approx(v, abs=1e-7) for k, v in carried.items()}


def test_rows_meet_counted_places_where_they_are(spark, monkeypatch):
    """The histogram was shuffled by entity to meet the entities' places, and then again into their order."""
    df = rows(spark)
    hist = inf.entity_histogram(df, "y", "score", "entity", ["cell"])
    distinct = hist.select(F.struct("cell", "score").alias("_cell")).distinct()
    draws = rs.entity_draws(df, "entity", 9, 2)

    def shuffles():
        placed = rs.placed_cells(hist, distinct, distinct.count(), draws, "entity")[0]
        plan = placed._jdf.queryExecution().executedPlan().toString()
        return [x for x in plan.split("\n") if " Exchange " in x], sorted(placed.collect())

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        few, got = shuffles()
        monkeypatch.setattr(rs, "BROADCAST_PLACES", 0)
        many, want = shuffles()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(few) == 1 and "rangepartitioning" in few[0] and len(many) > 1
    assert got == want
