"""Point-in-time features, availability stamps and the leakage audit.

A feature `X` carries the moment it became knowable in `available_at__X`. The registry that
declares features is plain data: a list of `Feature`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stampline.functions.expr import days_between, micros, minutes_between
from stampline.functions.ordered import asof, attach, position
from stampline.session import pinned

STAMP = "available_at__"
#: Blocks whose features must be knowable at the index time, whatever rule they declare.
AUDITED_BLOCKS = ("acq_pre", "demographics")


@dataclass(frozen=True)
class Feature:
    """One declared feature: its block and the rule that says when it is knowable."""

    name: str
    block: str
    rule: str
    droppable: bool = False


# ---- feature columns --------------------------------------------------------

def elapsed_minutes(df: DataFrame, index: str, arrival: str, name: str = "delay_minutes") -> DataFrame:
    return df.withColumn(name, minutes_between(index, arrival))


def calendar_parts(df: DataFrame, ts: str) -> DataFrame:
    """Hour 0-23, ISO weekday 1-7 (Monday first), month 1-12."""
    return df.withColumns({
        "hour_of_day": F.hour(ts), "day_of_week": F.extract(F.lit("DAYOFWEEK_ISO"), F.col(ts)).cast("int"),
        "month": F.month(ts)})


def asof_prior(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str,
               rows_per_slice: int | None = None) -> DataFrame:
    """Latest right event strictly before the left time: its time, whether it exists, days since."""
    out = asof(left, right, by, left_time, right_time, strict=True, rows_per_slice=rows_per_slice)
    return out.withColumn("prior_time", F.col("_hit.t")).drop("_hit").withColumns({
        "prior_exists": F.col("prior_time").isNotNull(),
        "days_since_prior": days_between(left_time, "prior_time")})


def prior_event_count(df: DataFrame, entity: str, ts: str, ties: str = "strict",
                      tiebreak: list[str] | None = None, rows_per_slice: int | None = None) -> DataFrame:
    """How many rows of this entity came earlier; 'cumcount' also counts tied earlier rows."""
    return position(df, [entity], micros(ts), tiebreak, ties, "prior_count", rows_per_slice)


def episode_window_stats(df: DataFrame, episode: str, ts: str) -> DataFrame:
    """Rows per episode and mean gap between consecutive rows, back on every row.

    The mean of consecutive gaps is (last - first) / (n - 1), so one small aggregate replaces
    an ordered pass; rows without an episode form their own group.
    """
    per = df.groupBy(episode).agg(F.count(F.lit(1)).alias("episode_rows"), F.count(ts).alias("_n"),
                                  F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    gap = F.when(F.col("_n") > 1, minutes_between("_hi", "_lo") / (F.col("_n") - 1))
    per = per.withColumn("mean_gap_minutes", gap).drop("_n", "_lo", "_hi")
    return attach(df, per, [episode])


def covering_latest(left: DataFrame, intervals: DataFrame, key: list[str], left_time: str, start: str,
                    value: str, default: str, end: str | None = None, name: str = "unit",
                    rows_per_slice: int | None = None) -> DataFrame:
    """Value of the latest interval that started at or before the left time, else the default.

    With `end`, an interval that closed before the left time falls back to the default.
    """
    values = [value] + ([end] if end else [])
    out = asof(left, intervals, key, left_time, start, values, strict=False, rows_per_slice=rows_per_slice)
    found = F.col(f"_hit.{value}")
    if end:
        found = F.when(F.col(f"_hit.{end}").isNull() | (F.col(f"_hit.{end}") >= F.col(left_time)), found)
    return out.withColumn(name, F.coalesce(found, F.lit(default))).drop("_hit")


# ---- text markers -----------------------------------------------------------

def has_marker(text: str, markers: list[str]) -> Column:
    """Case-insensitive containment of any marker; NULL text has none."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = F.lit(False)
    for m in markers:
        hit = hit | low.contains(m.lower())
    return hit


def marker_probe(df: DataFrame, cols: list[str], markers: list[str], lo: float = 0.01,
                 hi: float = 0.99) -> DataFrame:
    """Marker rate per candidate column, whether it is usable, and which usable one comes first."""
    present = [c for c in cols if c in df.columns]
    one = df.agg(*[F.avg(has_marker(c, markers).cast("double")).alias(c) for c in present])
    order = F.create_map(*[x for i, c in enumerate(present) for x in (F.lit(c), F.lit(i))])
    long = one.unpivot([], present, "column", "rate").withColumn("_i", order[F.col("column")])
    usable = F.col("rate").between(lo, hi)
    first = F.min(F.when(usable, F.col("_i"))).over(Window.partitionBy(F.lit(0)))
    return long.select(
        "column", "rate", F.coalesce(usable, F.lit(False)).alias("usable"),
        F.coalesce(F.col("_i") == first, F.lit(False)).alias("chosen"),
        F.when(usable, "usable").otherwise("degenerate").alias("status"))


def chosen_column(probe: DataFrame) -> str | None:
    row = probe.where("chosen").select("column").first()
    return row.column if row else None


def marker_flag(df: DataFrame, source: DataFrame, key: str, text: str, markers: list[str],
                name: str = "marker") -> DataFrame:
    """Row flag from the text column of another table; rows without a match are false."""
    flags = source.groupBy(key).agg(F.bool_or(has_marker(text, markers)).alias(name))
    return df.join(flags, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


# ---- stamps and audit -------------------------------------------------------

def stamp_availability(df: DataFrame, registry: list[Feature], rule_columns: dict[str, str],
                       dropped: list[str] | None = None) -> DataFrame:
    """Add `available_at__X` for every declared feature that was not dropped."""
    wanted = [f for f in registry if f.name not in (dropped or [])]
    absent = [f.name for f in wanted if f.name not in df.columns]
    if absent:
        raise ValueError(f"declared but not produced: {', '.join(absent)}")
    return df.withColumns({STAMP + f.name: F.col(rule_columns[f.rule]) for f in wanted})


def leakage_audit(df: DataFrame, registry: list[Feature], index: str,
                  blocks: tuple[str, ...] = AUDITED_BLOCKS) -> DataFrame:
    """One row per feature of the audited blocks: rows checked, violations, worst lateness, status.

    A value without a stamp and a stamp after the index time are violations; rows checked are those with a
    stamp and an index time. A feature without a stamp column counts its values as unstamped. A feature that
    is not there is `dropped` if its declaration allows that, else `absent`. All features are counted in one
    aggregate over the table.
    """
    safe = [f for f in registry if f.block in blocks]
    stampable = [f for f in safe if f.name in df.columns and STAMP + f.name in df.columns]
    aggs = []
    for f in stampable:
        stamp, value = F.col(STAMP + f.name), F.col(f.name)
        late = stamp > F.col(index)
        aggs += [F.count_if(stamp.isNotNull() & F.col(index).isNotNull()).alias(f"rows#{f.name}"),
                 F.count_if(value.isNotNull() & stamp.isNull()).alias(f"bare#{f.name}"),
                 F.count_if(late).alias(f"late#{f.name}"),
                 F.max(F.when(late, minutes_between(stamp, index))).alias(f"worst#{f.name}")]
    bare = [f for f in safe if f.name in df.columns and STAMP + f.name not in df.columns]
    for f in bare:
        aggs += [F.lit(0).cast("bigint").alias(f"rows#{f.name}"), F.count(f.name).alias(f"bare#{f.name}"),
                 F.lit(0).cast("bigint").alias(f"late#{f.name}"), F.lit(None).cast("double").alias(f"worst#{f.name}")]
    stampable += bare
    spark = df.sparkSession
    kinds = [(f.name, f.block,
              "dropped" if f.name not in df.columns and f.droppable else "absent" if f.name not in df.columns else
              "unstamped" if STAMP + f.name not in df.columns else None) for f in safe]
    declared = spark.createDataFrame(kinds, "feature string, block string, gap string")
    if not stampable:
        return declared.select("feature", "block", F.lit(0).cast("bigint").alias("rows_checked"),
                               F.lit(0).cast("bigint").alias("unstamped_values"),
                               F.lit(0).cast("bigint").alias("late_rows"),
                               F.lit(None).cast("double").alias("max_late_minutes"),
                               F.col("gap").alias("status"))
    one = df.agg(*aggs)
    parts = F.array(*[F.struct(
        F.lit(f.name).alias("feature"), F.col(f"`rows#{f.name}`").alias("rows_checked"),
        F.col(f"`bare#{f.name}`").alias("unstamped_values"), F.col(f"`late#{f.name}`").alias("late_rows"),
        F.col(f"`worst#{f.name}`").alias("max_late_minutes")) for f in stampable])
    counted = one.select(F.explode(parts).alias("_f")).select("_f.*")
    status = F.when(F.col("gap").isNotNull(), F.col("gap")) \
        .when(F.col("late_rows") + F.col("unstamped_values") > 0, "violation").otherwise("ok")
    return declared.join(counted, "feature", "left").select(
        "feature", "block", F.coalesce("rows_checked", F.lit(0)).alias("rows_checked"),
        F.coalesce("unstamped_values", F.lit(0)).alias("unstamped_values"),
        F.coalesce("late_rows", F.lit(0)).alias("late_rows"), "max_late_minutes", status.alias("status"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """One row: features audited, rows checked, features in violation, PASS or FAIL.

    Only violations and features without stamps fail; leaving a feature out is a decision, not a leak.
    """
    bad = F.count_if(F.col("status").isin("violation", "unstamped"))
    return audit.agg(F.count(F.lit(1)).alias("features"), F.max("rows_checked").alias("rows_checked"),
                     bad.alias("failing"), F.when(bad > 0, "FAIL").otherwise("PASS").alias("result"))


def window_block_report(df: DataFrame, registry: list[Feature], index: str,
                        blocks: tuple[str, ...] = AUDITED_BLOCKS) -> DataFrame:
    """Features outside the audited blocks: how many rows are stamped after the index, or that none is."""
    suspect = [f for f in registry if f.block not in blocks]
    here = [f for f in suspect if STAMP + f.name in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count_if(F.col(STAMP + f.name) > F.col(index)).alias(f"late#{f.name}") for f in here])
    parts = F.array(*[F.struct(
        F.lit(f.name).alias("feature"), F.col("n").alias("rows_checked"),
        (F.col(f"`late#{f.name}`") if f in here else F.lit(None).cast("bigint")).alias("late_rows"))
        for f in suspect])
    status = F.when(F.col("late_rows").isNull(), "dropped") \
        .when(F.col("late_rows") == 0, "INDEX-FIXED").otherwise("AFTER-INDEX")
    return one.select(F.explode(parts).alias("_f")).select("_f.*").withColumn("status", status)


def inject_leak(df: DataFrame, feature: str, late: str, key: str, share: int = 20) -> DataFrame:
    """Positive control: every k-th row by key order (k = rows // share) gets a late stamp.

    Row numbers come from `dense_rows`, so no task sorts the whole table.
    """
    numbered, n = dense_rows(df, key)
    k = max(1, n // share)
    stamp = F.when(F.col("_row") % k == 0, F.col(late)).otherwise(F.col(STAMP + feature))
    return numbered.withColumn(STAMP + feature, stamp).drop("_row")


def dense_rows(df: DataFrame, *key: str) -> tuple[DataFrame, int]:
    """Zero-based row numbers in key order, and the row count."""
    ranged = pinned(df.repartitionByRange(*key).withColumn("_range", F.spark_partition_id()))
    across = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*key)) - 1
    # One offset per range: bounded by the number of shuffle partitions.
    out = ranged.withColumn("_p", place).join(F.broadcast(offsets), "_range") \
        .withColumn("_row", F.col("_p") + F.col("_off")).drop("_p", "_off", "_range")
    return out, ranged.count()


# ---- profiles ---------------------------------------------------------------

def feature_profile(df: DataFrame, registry: list[Feature]) -> DataFrame:
    """Per declared feature: fitted or not, levels, share of the modal value, share undefined.

    Values are counted as (feature, value) pairs, which Spark pre-aggregates before shuffling.
    """
    here = [f for f in registry if f.name in df.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(f.name).alias("feature"),
                                         F.col(f.name).cast("string").alias("value")) for f in here]))
    counts = df.select(pairs.alias("_p")).groupBy("_p.feature", "_p.value") \
        .agg(F.count(F.lit(1)).alias("n"))
    seen = F.col("value").isNotNull()
    per = counts.groupBy("feature").agg(
        F.count_if(seen).alias("n_levels"),
        (F.max(F.when(seen, F.col("n"))) / F.sum(F.when(seen, F.col("n")))).alias("modal_share"),
        (F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)) / F.sum("n")).alias("undefined_share"))
    spark = df.sparkSession
    declared = spark.createDataFrame([(f.name, f.block, f.name in df.columns) for f in registry],
                                     "feature string, block string, fitted boolean")
    levels = F.coalesce("n_levels", F.lit(0))
    return declared.join(per, "feature", "left").select(
        "feature", "block", "fitted", levels.alias("n_levels"), "modal_share", "undefined_share",
        (levels > 1).alias("carries_information"),
        F.when(~F.col("fitted"), "dropped").when(levels > 1, "varies").otherwise("constant").alias("status"))


def missing_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, null_share) in one aggregate."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "null_share")


def missingness(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean, median, max null share, columns nearly and fully empty, empty rows."""
    per = missing_shares(df, cols).agg(
        F.avg("null_share").alias("mean_share"), F.percentile("null_share", F.lit(0.5)).alias("median_share"),
        F.max("null_share").alias("max_share"), F.count_if(F.col("null_share") > 0.9).alias("nearly_empty"),
        F.count_if(F.col("null_share") == 1.0).alias("fully_empty"))
    empty = F.lit(True)
    for c in cols:
        empty = empty & F.col(c).isNull()
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(empty).alias("rows_without_data"))
    return per.crossJoin(rows)


# ---- model matrix -----------------------------------------------------------

def assemble_matrix(cohort: DataFrame, tables: list[DataFrame], key: str, label: str,
                    features: list[str], carry: list[str] | None = None,
                    sentinel: int = -999) -> DataFrame:
    """Cohort with its feature columns; rows undefined for this label are left out."""
    out = cohort.where(F.col(label).isNotNull() & (F.col(label) != sentinel))
    for t in tables:
        out = out.join(t, key, "left")
    absent = [f for f in features if f not in out.columns]
    if absent:
        raise ValueError(f"features not found: {', '.join(absent)}")
    return out.select(key, *(carry or []), label, *features)


def undefined_rows(cohort: DataFrame, label: str, sentinel: int = -999) -> DataFrame:
    """One row: rows kept and dropped for this label."""
    bad = F.col(label).isNull() | (F.col(label) == sentinel)
    return cohort.agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("dropped"))


def standardise_train_only(df: DataFrame, cols: list[str], split: str, categories: list[str] | None = None,
                           train: str = "train") -> DataFrame:
    """Scale by train-split mean and population deviation; code categories.

    NULL becomes the mean (zero after scaling); a column with any NULL is marked in
    `X__missing`; a constant column keeps deviation 1. Category codes follow the sorted
    distinct values. The statistics are one row, read once.
    """
    is_train = F.col(split) == train
    stats = df.agg(
        *[F.avg(F.when(is_train, F.col(c))).alias(f"m#{c}") for c in cols],
        *[F.stddev_pop(F.when(is_train, F.col(c))).alias(f"s#{c}") for c in cols],
        *[F.count_if(F.col(c).isNull()).alias(f"n#{c}") for c in cols]).first()
    new = {}
    for c in cols:
        mean, dev = stats[f"m#{c}"], stats[f"s#{c}"] or 1.0
        if stats[f"n#{c}"]:
            new[f"{c}__missing"] = F.col(c).isNull().cast("int")
        centred = F.col(c).cast("double") - F.lit(mean).cast("double")
        new[f"{c}__z"] = F.coalesce(centred, F.lit(0.0)) / F.lit(dev)
    out = df.withColumns(new)
    for c in categories or []:
        values, _ = dense_rows(df.select(F.col(c)).where(F.col(c).isNotNull()).distinct(), c)
        codes = values.select(c, F.col("_row").cast("int").alias(f"{c}__code"))
        out = out.join(codes, c, "left")
    return out
