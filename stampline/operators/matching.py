"""Coarsened exact matching: strata, pair weights and balance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampline.functions.expr import TINY, uniform
from stampline.operators.cohort import SENTINEL
from stampline.operators.discrimination import auroc


@dataclass(frozen=True)
class BinSpec:
    """Right-closed bins: (-inf, c1], (c1, c2], …, (cn, inf), one label each."""

    source: str
    name: str
    cuts: tuple[float, ...]
    labels: tuple[str, ...]

    def column(self) -> Column:
        case = F.when(F.col(self.source) <= self.cuts[0], self.labels[0])
        for cut, label in zip(self.cuts[1:], self.labels[1:]):
            case = case.when(F.col(self.source) <= cut, label)
        return case.when(F.col(self.source) > self.cuts[-1], self.labels[-1])


#: Declared coarsening (fixed values): minutes of delay, hour of the day.
DELAY = BinSpec("delay_minutes", "delay_bucket", (15, 30, 60), ("<=15", "15-30", "30-60", ">60"))
HOUR = BinSpec("hour_of_day", "hour_bucket", (5.5, 11.5, 17.5), ("night", "morning", "afternoon", "evening"))


def coarsen(df: DataFrame, specs: tuple[BinSpec, ...] = (DELAY, HOUR), weekday: str = "day_of_week",
            acuity: str = "acuity", weekend_from: int = 6) -> DataFrame:
    """Bucket the matching variables; missing acuity becomes its own level '-1'."""
    out = df.withColumns({s.name: s.column() for s in specs})
    return out.withColumns({
        "is_weekend": (F.col(weekday) >= weekend_from).cast("int"),
        "acuity_level": F.coalesce(F.col(acuity).cast("bigint").cast("string"), F.lit("-1"))})


def stratum_key(df: DataFrame, cols: list[str], name: str = "stratum") -> DataFrame:
    """Joint level of the chosen coarse columns; a subset gives a sensitivity key."""
    return df.withColumn(name, F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def stratum_labels(df: DataFrame, labels: list[str], stratum: str, sentinel: int = SENTINEL) -> DataFrame:
    """(stratum, label, n_pos, n_neg, n_pairs), undefined rows ignored; one pass over the rows."""
    long = df.unpivot([stratum], labels, "label", "y").where(F.col("y") != sentinel)
    per = long.groupBy(stratum, "label").agg(F.count_if(F.col("y") == 1).alias("n_pos"),
                                             F.count_if(F.col("y") == 0).alias("n_neg"))
    return per.withColumn("n_pairs", F.col("n_pos").cast("double") * F.col("n_neg"))  # may pass a long


def strata_table(df: DataFrame, labels: list[str], stratum: str, entity: str,
                 sentinel: int = SENTINEL) -> DataFrame:
    """Per stratum: rows, entities, and per label positives, negatives and pairs."""
    counts = []
    for c in labels:
        pos, neg = F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 0)
        counts += [pos.alias(f"n_pos__{c}"), neg.alias(f"n_neg__{c}"), (pos.cast("double") * neg).alias(f"n_pairs__{c}")]
    return df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_records"),
                                   F.countDistinct(entity).alias("n_entities"), *counts)


def strata_size_summary(df: DataFrame, stratum: str, at_least: int = 10) -> DataFrame:
    """One row: strata, median and largest size, rows living in strata of a given size."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_strata"), F.percentile("n", F.lit(0.5)).alias("median_size"),
                     F.max("n").alias("max_size"),
                     F.coalesce(F.sum(F.when(F.col("n") >= at_least, F.col("n"))), F.lit(0)).alias("rows_in_large"))


def effective_sample(df: DataFrame, labels: list[str], stratum: str, entity: str,
                     sentinel: int = SENTINEL) -> DataFrame:
    """Per label: what is left once only strata with both classes count."""
    long = df.unpivot([stratum, entity], labels, "label", "y").where(F.col("y") != sentinel)
    per = long.groupBy("label", stratum).agg(F.count_if(F.col("y") == 1).alias("_p"),
                                             F.count_if(F.col("y") == 0).alias("_n"))
    good = per.where((F.col("_p") > 0) & (F.col("_n") > 0))
    marked = long.join(good.select("label", stratum, F.lit(True).alias("_in")), ["label", stratum], "left")
    rows = marked.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_records_defined"), F.count("_in").alias("n_records_informative"),
        F.countDistinct(entity).alias("n_entities_defined"),
        F.countDistinct(F.when(F.col("_in"), F.col(entity))).alias("n_entities_effective"))
    strata = per.groupBy("label").agg(
        F.count_if((F.col("_p") > 0) & (F.col("_n") > 0)).alias("n_strata_informative"),
        F.sum(F.col("_p").cast("double") * F.col("_n")).alias("n_within_pairs"),
        (F.sum("_p").cast("double") * F.sum("_n")).alias("n_all_pairs"))
    total = df.agg(F.countDistinct(stratum).alias("n_strata_total"))
    return rows.join(strata, "label").crossJoin(F.broadcast(total)).withColumn(
        "pair_retention", F.when(F.col("n_all_pairs") > 0, F.col("n_within_pairs") / F.col("n_all_pairs")))


def pair_weights(df: DataFrame, y: str, stratum: str, by: list[str] | None = None,
                 name: str = "pair_weight") -> DataFrame:
    """A positive weighs the stratum's negatives, a negative its positives.

    The class counts are one row per stratum, joined back, so a huge stratum never sits in one
    task as a window would make it.
    """
    keys = [*(by or []), stratum]
    per = df.groupBy(*keys).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    weight = F.when(F.col(y) == 1, F.col("_n")).when(F.col(y) == 0, F.col("_p"))
    return df.join(per, keys, "left").withColumn(name, weight).drop("_p", "_n")


def weighted_smd(df: DataFrame, value: str, y: str, weights: dict[str, str | None],
                 by: list[str] | None = None) -> DataFrame:
    """Standardised mean difference positives minus negatives, one column per weighting.

    Two passes: the weighted means first, then the variance around them, which keeps large
    means from cancelling. Undefined when a class has no weight; infinite when both variances
    vanish but the means differ.
    """
    by = by or []
    anchor = [] if by else ["_all"]
    rows = (df if by else df.withColumn("_all", F.lit(0))).where(F.col(y).isin(0, 1) & F.col(value).isNotNull())
    keys = [*by, *anchor, y]
    x = F.col(value).cast("double")

    def w(col: str | None) -> Column:
        return F.lit(1.0) if col is None else F.col(col).cast("double")

    means = rows.groupBy(*keys).agg(
        *[F.sum(w(c) * x).alias(f"_s_{n}") for n, c in weights.items()],
        *[F.sum(w(c)).alias(f"_w_{n}") for n, c in weights.items()])
    for n in weights:
        means = means.withColumn(f"_m_{n}", F.when(F.col(f"_w_{n}") > 0, F.col(f"_s_{n}") / F.col(f"_w_{n}")))
    # Cells are declared (labels, variables), two rows each.
    spread = rows.join(F.broadcast(means), keys).groupBy(*keys).agg(
        *[F.sum(w(c) * F.pow(x - F.col(f"_m_{n}"), 2)).alias(f"_v_{n}") for n, c in weights.items()],
        *[F.first(f"_m_{n}").alias(f"_m_{n}") for n in weights],
        *[F.first(f"_w_{n}").alias(f"_w_{n}") for n in weights])
    groups = [*by, *anchor]
    wide = spread.groupBy(*groups).agg(*[
        F.max(F.when(F.col(y) == cls, col)).alias(f"{tag}{cls}_{n}")
        for n in weights for cls in (0, 1)
        for tag, col in (("m", F.col(f"_m_{n}")),
                         ("v", F.when(F.col(f"_w_{n}") > 0, F.col(f"_v_{n}") / F.col(f"_w_{n}"))))])
    out = []
    for n in weights:
        gap = F.col(f"m1_{n}") - F.col(f"m0_{n}")
        pooled = F.sqrt((F.col(f"v1_{n}") + F.col(f"v0_{n}")) / 2.0)
        out.append(F.when(pooled > 0, gap / pooled).when(F.abs(gap) < TINY, 0.0)
                   .when(gap.isNotNull(), F.lit(float("inf"))).alias(n))
    return wide.select(*by, *out)


def balance_table(df: DataFrame, labels: list[str], coarse: dict[str, str], raw: list[str], stratum: str,
                  sentinel: int = SENTINEL) -> DataFrame:
    """SMD before and after pair weighting, per label, variable and level.

    `coarse` maps a source variable to its coarse column; every level becomes an indicator.
    Raw variables are compared on their own scale over their finite values. Indicators are
    counted per (label, level) instead of being written out row by row.
    """
    held = list(coarse)
    cols = list(dict.fromkeys([stratum, *coarse.values(), *raw]))
    long = df.unpivot(cols, labels, "label", "y").where(F.col("y").isin(0, 1) & (F.col("y") != sentinel))
    rows = pair_weights(long, "y", stratum, ["label"])
    raw_parts = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in raw])
    under = rows.select("label", "y", "pair_weight", F.explode(raw_parts).alias("_r")) \
        .select("label", "y", "pair_weight", "_r.*").where(F.col("x").isNotNull() & ~F.isnan("x"))
    under = weighted_smd(under, "x", "y", {"smd_before": None, "smd_after": "pair_weight"}, ["label", "variable"]) \
        .withColumns({"level": F.lit("(continuous)"), "scale": F.lit("underlying"),
                      "held_fixed": F.col("variable").isin(*held) if held else F.lit(False)})
    levels = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level"))
                       for c in coarse.values()])
    # Joint levels first, so that only they multiply by the variables, not the rows.
    joint = rows.groupBy("label", "y", *dict.fromkeys(coarse.values())).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("pair_weight").cast("double")).alias("w"))
    cells = joint.select("label", "y", "n", "w", F.explode(levels).alias("_l")) \
        .groupBy("label", "y", "_l.variable", "_l.level").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    totals = long.groupBy("label").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))
    pairs = stratum_labels(df, labels, stratum, sentinel).groupBy("label").agg(F.sum("n_pairs").alias("pairs"))
    wide = cells.groupBy("label", "variable", "level").agg(*[
        F.coalesce(F.sum(F.when(F.col("y") == cls, F.col(c))), F.lit(0.0)).alias(f"{c}_{cls}")
        for c in ("n", "w") for cls in (0, 1)])
    wide = wide.join(F.broadcast(totals), "label").join(F.broadcast(pairs), "label")

    def indicator_smd(p1: Column, p0: Column) -> Column:
        gap, pooled = p1 - p0, F.sqrt((p1 * (1 - p1) + p0 * (1 - p0)) / 2.0)
        return F.when(pooled > 0, gap / pooled).when(F.abs(gap) < TINY, 0.0) \
            .when(gap.isNotNull(), F.lit(float("inf")))

    def share(num: str, den: str) -> Column:
        return F.when(F.col(den) > 0, F.col(num) / F.col(den))

    coarse_rows = wide.select(
        "label", "variable", "level", F.lit("coarsened").alias("scale"), F.lit(True).alias("held_fixed"),
        indicator_smd(share("n_1", "n1"), share("n_0", "n0")).alias("smd_before"),
        indicator_smd(share("w_1", "pairs"), share("w_0", "pairs")).alias("smd_after"))
    return coarse_rows.unionByName(under.select(coarse_rows.columns))


def worst_balance(balance: DataFrame) -> DataFrame:
    """Largest absolute SMD after weighting per scale."""
    return balance.groupBy("scale").agg(F.max(F.abs("smd_after")).alias("worst_after"))


def availability_propensity(superset: DataFrame, flag: str, numeric: list[str], categorical: list[str],
                            entity: str, holdout: float = 0.2, seed: int = 0, max_iter: int = 20,
                            max_depth: int = 4) -> DataFrame:
    """How well membership can be told from context alone: held-out AUROC, rate and counts.

    The hold-out is drawn by entity, so no entity sits on both sides.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = superset.withColumn("label", F.col(flag).cast("double"))
    held = uniform(F.lit(seed), F.lit("holdout"), F.col(entity)) < holdout
    train, test = data.where(~held), data.where(held)
    index, levels = None, 0
    if categorical:
        index = StringIndexer(inputCols=categorical, outputCols=[f"{c}__i" for c in categorical],
                              handleInvalid="keep").fit(train)
        levels = max(map(len, index.labelsArray))
    assemble = VectorAssembler(inputCols=[*numeric, *[f"{c}__i" for c in categorical]], outputCol="features",
                               handleInvalid="keep")
    gbt = GBTClassifier(maxIter=max_iter, maxDepth=max_depth, seed=seed, maxBins=max(64, levels + 1))
    stages = ([index] if categorical else []) + [assemble, gbt]
    scored = Pipeline(stages=stages).fit(train).transform(test) \
        .withColumn("score", vector_to_array("probability")[1])
    out = auroc(scored.withColumn("y", F.col("label").cast("int")), "y", "score")
    return out.select("auroc", (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("base_rate"),
                      (F.col("n_pos") + F.col("n_neg")).alias("n_held_out"))
