"""Score histograms: the shared core of every rank statistic.

Rows are first reduced to one row per (keys, score) with positive and negative weight, which
Spark does map-side. A rank statistic is then a running sum over distinct scores. The histogram
is cut into contiguous score ranges by a range partitioning, so a single huge cell spreads over
many tasks; per-range results combine through one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "_range"


def score_histogram(df: DataFrame, y: str, score: str, keys: list[str],
                    weight: str | None = None) -> DataFrame:
    """(keys, score, pos, neg) over rows with a defined 0/1 label and a score."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return (
        df.where(F.col(y).isin(0, 1) & F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).alias("score"))
        .agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("pos"),
             F.sum(F.when(F.col(y) == 0, w).otherwise(0.0)).alias("neg"))
    )


def tag_ranges(hist: DataFrame, keys: list[str], n_ranges: int | None = None) -> DataFrame:
    """Range-partition by (keys, score) and number the ranges; equal scores share a range."""
    cols = [*keys, "score"]
    spread = hist.repartitionByRange(n_ranges, *cols) if n_ranges else hist.repartitionByRange(*cols)
    return spread.withColumn(RANGE, F.spark_partition_id())


def ordered_pairs(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, wins, pos, neg): wins = positive-over-negative pairs, ties counted half.

    `hist` carries `_range`. Inside a range a running sum gives the negatives below each
    score; across ranges the negatives of the earlier ones are added once per range.
    """
    groups = list(keys) or ["_all"]
    base = hist if keys else hist.withColumn("_all", F.lit(0))
    inside = Window.partitionBy(*groups, RANGE).orderBy("score") \
        .rowsBetween(Window.unboundedPreceding, -1)
    per_range = (
        base.withColumn("_below", F.coalesce(F.sum("neg").over(inside), F.lit(0.0)))
        .groupBy(*groups, RANGE)
        .agg(F.sum(F.col("pos") * (F.col("_below") + 0.5 * F.col("neg"))).alias("_wins"),
             F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    )
    across = Window.partitionBy(*groups).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    total = (
        per_range.withColumn("_under", F.coalesce(F.sum("_neg").over(across), F.lit(0.0)))
        .groupBy(*groups)
        .agg(F.sum(F.col("_wins") + F.col("_pos") * F.col("_under")).alias("wins"),
             F.sum("_pos").alias("pos"), F.sum("_neg").alias("neg"))
    )
    return total if keys else total.drop("_all")


def pair_share(wins: Column | str = "wins", pairs: Column | None = None) -> Column:
    """wins / pairs, NULL when a class is absent."""
    pairs = F.col("pos") * F.col("neg") if pairs is None else pairs
    return F.when(pairs > 0, (F.col(wins) if isinstance(wins, str) else wins) / pairs)
