"""Cohort construction and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampline.functions.expr import unpivot_labels

SENTINEL = -999


def canonicalise(df: DataFrame, rename: dict[str, str], casts: dict[str, str]) -> DataFrame:
    """Rename columns and cast; a value that does not fit the type becomes NULL."""
    out = df.withColumnsRenamed(rename)
    return out.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items()})


def assign_split(df: DataFrame, fold: str, assignment: dict[str, list[int]],
                 name: str = "split") -> DataFrame:
    """Map the fold number to its declared split; an undeclared fold gives NULL."""
    case = None
    for split, folds in assignment.items():
        hit = F.col(fold).isin(*folds)
        case = F.when(hit, split) if case is None else case.when(hit, split)
    return df.withColumn(name, case)


def assert_range(df: DataFrame, value: Column, lo: float, hi: float) -> DataFrame:
    """One row: smallest, largest, and how many rows fall outside [lo, hi]."""
    bad = (value < lo) | (value > hi)
    return df.agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"),
                  F.count_if(bad).alias("violations"))


def require_range(df: DataFrame, value: Column, lo: float, hi: float, what: str) -> DataFrame:
    """Abort when any value leaves [lo, hi], else hand the frame on."""
    found = assert_range(df, value, lo, hi).first()
    if found.violations:
        raise ValueError(f"{what} must lie in [{lo}, {hi}]: {found.violations} rows outside, "
                         f"range {found.min_value}..{found.max_value}")
    return df


def superset_with_membership(stays: DataFrame, people: DataFrame, cohort: DataFrame,
                             person: str, stay: str, intime: str, anchor_age: str,
                             anchor_year: str, minutes: int = 90, min_age: int = 18,
                             flag: str = "in_cohort") -> DataFrame:
    """All stays with age at arrival, window close, and whether the stay is in the cohort."""
    member = cohort.select(stay).where(F.col(stay).isNotNull()).distinct() \
        .withColumn("_hit", F.lit(True))
    age = F.col(anchor_age) + F.year(intime) - F.col(anchor_year)
    return (
        stays.join(people.select(person, anchor_age, anchor_year), person, "left")
        .withColumn("age", age.cast("bigint"))
        .where(F.col("age") >= min_age)
        .withColumn("window_close", F.col(intime) + F.expr(f"INTERVAL {int(minutes)} MINUTES"))
        .join(member, stay, "left")
        .withColumn(flag, F.col("_hit").isNotNull())
        .drop("_hit", anchor_age, anchor_year)
    )


def label_prevalence(df: DataFrame, labels: list[str], entity: str,
                     sentinel: int = SENTINEL) -> DataFrame:
    """Per label: valid, missing and positive rows, prevalence, entities among valid rows."""
    long = unpivot_labels(df, [entity], labels)
    y = F.col("y")
    valid = y != sentinel
    return long.groupBy("label").agg(
        F.count_if(valid).alias("n_valid"),
        (F.count(F.lit(1)) - F.count_if(valid)).alias("n_missing"),
        F.count_if(y == 1).alias("n_positive"),
        F.round(F.avg(F.when(valid, y)), 5).alias("prevalence"),
        F.countDistinct(F.when(valid, F.col(entity))).alias("n_entities"))


def split_disjointness(df: DataFrame, entity: str, split: str) -> DataFrame:
    """Entities that appear in more than one split; empty when the split is clean."""
    return (
        df.groupBy(entity).agg(F.countDistinct(split).alias("n_splits"))
        .where(F.col("n_splits") > 1)
    )


def split_counts(df: DataFrame, split: str) -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))


def reconcile_counts(local: DataFrame, published: DataFrame) -> DataFrame:
    """Local against published per quantity: gap, and gap in percent (4 places)."""
    gap = F.col("local") - F.col("published")
    return local.join(published, "quantity", "left").select(
        "quantity", "local", "published", gap.alias("gap"),
        F.when(F.col("published") != 0, F.round(100.0 * gap / F.col("published"), 4)).alias("pct"))


def local_counts(df: DataFrame, entity: str, episode: str, labels: list[str],
                 sentinel: int = SENTINEL) -> DataFrame:
    """(quantity, local): rows, entities, episodes and positives per label, in one pass."""
    one = df.agg(
        F.count(F.lit(1)).alias("n_samples"), F.countDistinct(entity).alias("n_entities"),
        F.countDistinct(episode).alias("n_episodes"),
        *[F.count_if((F.col(c) == 1) & (F.col(c) != sentinel)).alias(f"positives[{c}]")
          for c in labels])
    return one.unpivot([], one.columns, "quantity", "local")


def first_of_episode(df: DataFrame, seq: str) -> DataFrame:
    """Rows numbered 0 inside their episode; ties are kept."""
    return df.where(F.col(seq) == 0)


def first_of_episode_counts(df: DataFrame, seq: str, episode: str) -> DataFrame:
    """One row: kept and dropped rows, episodes kept, episodes whose first row is tied."""
    per = df.groupBy(episode).agg(F.count_if(F.col(seq) == 0).alias("_first"),
                                  F.count(F.lit(1)).alias("_rows"))
    kept, rows = (F.coalesce(F.sum(c), F.lit(0)) for c in ("_first", "_rows"))  # no rows: zero
    return per.agg(kept.alias("kept_rows"), (rows - kept).alias("dropped_rows"),
                   F.count_if((F.col("_first") > 0) & F.col(episode).isNotNull()).alias("episodes"),
                   F.count_if((F.col("_first") > 1) & F.col(episode).isNotNull()).alias("tied_episodes"))


def cohort_reconciliation(df: DataFrame, published: DataFrame, entity: str, episode: str,
                          seq: str, split: str, labels: list[str], test: str = "test",
                          sentinel: int = SENTINEL) -> DataFrame:
    """Long report (section, quantity, local, published, gap).

    The table is read once for the whole cohort, once per split count and three times for the
    test fold; every reading ends in an aggregate.
    """
    def long(df: DataFrame, cells: list[tuple[str, str, Column]]) -> DataFrame:
        one = df.agg(*[c.alias(f"c{i}") for i, (_, _, c) in enumerate(cells)])
        parts = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(q).alias("quantity"), F.col(f"c{i}").alias("local"))
                          for i, (s, q, _) in enumerate(cells)])
        return one.select(F.explode(parts).alias("_p")).select("_p.*")

    def size(section: str) -> list[tuple[str, str, Column]]:
        return [(section, "records", F.count(F.lit(1))), (section, "entities", F.countDistinct(entity)),
                (section, "episodes", F.countDistinct(episode))]

    whole = long(df, size("cohort")
                 + [("positives", c, F.count_if(F.col(c) == 1)) for c in labels]
                 + [("exclusions", c, F.count_if(F.col(c) == sentinel)) for c in labels])
    splits = df.where(F.col(split).isNotNull()).groupBy(F.col(split).alias("quantity")) \
        .agg(F.count(F.lit(1)).alias("local")).select(F.lit("split").alias("section"), "quantity", "local")
    tests = df.where(F.col(split) == test)
    first = first_of_episode_counts(tests, seq, episode)
    first = long(first, [("first of episode", name, F.max(c)) for name, c in (
        ("first records", "kept_rows"), ("episodes among them", "episodes"),
        ("tied episodes", "tied_episodes"), ("later records", "dropped_rows"))])
    levels = tests.groupBy(seq).agg(F.count(F.lit(1)).alias("local")).select(
        F.lit("sequence").alias("section"),
        F.concat(F.lit("numbered "), F.col(seq).cast("string")).alias("quantity"), "local")
    report = whole
    for part in (splits, long(tests, size("test fold")), first, levels):
        report = report.unionByName(part)
    return report.join(published, ["section", "quantity"], "left") \
        .withColumn("gap", F.col("local") - F.col("published"))
