"""Discrimination statistics on score histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampline.functions.histogram import (
    ordered_pairs, pair_share, score_histogram, tag_ranges,
)
from stampline.functions.ordered import running_before


def auroc(df: DataFrame, y: str, score: str, by: list[str] | None = None,
          n_ranges: int | None = None) -> DataFrame:
    """Probability that a positive outranks a negative, ties half; NULL with one class."""
    by = by or []
    hist = tag_ranges(score_histogram(df, y, score, by), by, n_ranges)
    pairs = ordered_pairs(hist, by)
    return pairs.select(*by, pair_share().alias("auroc"),
                        F.col("pos").cast("bigint").alias("n_pos"),
                        F.col("neg").cast("bigint").alias("n_neg"))


def auprc(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Average precision: recall steps times precision over distinct thresholds."""
    by = by or []
    hist = score_histogram(df, y, score, by).withColumn("n", F.col("pos") + F.col("neg"))
    run = running_before(hist, by, "score", {"_pos": "pos", "_n": "n"}, descending=True)
    precision = (F.col("_pos") + F.col("pos")) / (F.col("_n") + F.col("n"))
    agg = [F.sum(F.col("pos") * precision).alias("_s"), F.sum("pos").alias("_p")]
    return (run.groupBy(*by).agg(*agg) if by else run.agg(*agg)) \
        .select(*by, F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")).alias("auprc"))


def brier(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Mean squared distance between probability and outcome; undefined outcomes are left out."""
    gap = F.when(F.col(y).isin(0, 1), F.pow(F.col(p) - F.col(y), 2))
    return df.groupBy(*(by or [])).agg(F.avg(gap).alias("brier"), F.count(gap).alias("n_items"))


def concordance_pairs(hist: DataFrame, keys: list[str], stratum: str) -> DataFrame:
    """(keys, wins, pairs): only pairs of one stratum count."""
    per = ordered_pairs(hist, [*keys, stratum])
    agg = [F.sum("wins").alias("wins"), F.sum(F.col("pos") * F.col("neg")).alias("pairs")]
    return per.groupBy(*keys).agg(*agg) if keys else per.agg(*agg)


def within_stratum_concordance(df: DataFrame, y: str, score: str, stratum: str,
                               by: list[str] | None = None) -> DataFrame:
    """Share of same-stratum positive/negative pairs ranked correctly."""
    by = by or []
    keys = [*by, stratum]
    hist = tag_ranges(score_histogram(df.where(F.col(stratum).isNotNull()), y, score, keys), keys)
    return concordance_pairs(hist, by, stratum).select(
        *by, pair_share(pairs=F.col("pairs")).alias("concordance"),
        F.col("pairs").cast("double").alias("n_pairs"))


def informative_strata(df: DataFrame, y: str, stratum: str, entity: str,
                       by: list[str] | None = None) -> DataFrame:
    """Strata holding both classes, their pairs, rows and distinct entities."""
    by = by or []
    defined = df.where(F.col(y).isin(0, 1) & F.col(stratum).isNotNull())
    per = defined.groupBy(*by, stratum).agg(
        F.sum(F.col(y).cast("bigint")).alias("pos"),
        F.sum((1 - F.col(y)).cast("bigint")).alias("neg"))
    good = per.where((F.col("pos") > 0) & (F.col("neg") > 0))
    strata_agg = [F.count(F.lit(1)).alias("n_strata"),
                  F.sum(F.col("pos").cast("double") * F.col("neg")).alias("n_pairs"),  # may pass a long
                  F.sum(F.col("pos") + F.col("neg")).alias("n_items")]
    kept = defined.join(good.select(*by, stratum), [*by, stratum], "left_semi")
    people = F.countDistinct(entity).alias("n_entities")
    if not by:
        return good.agg(*strata_agg).crossJoin(kept.agg(people))
    return good.groupBy(*by).agg(*strata_agg).join(kept.groupBy(*by).agg(people), by)


def seeds_seen(seeds: list[int]) -> Column:
    """How many of the declared seeds a group holds, as bits of longs: such sums stay in hash aggregation."""
    declared = list(dict.fromkeys(seeds))
    seen = F.lit(0)
    for lo in range(0, len(declared), 62):
        bit = F.coalesce(*[F.when(F.col("seed") == s, F.lit(1 << i).cast("bigint")) for i, s in enumerate(declared[lo:lo + 62])])
        seen = seen + F.bit_count(F.coalesce(F.bit_or(bit), F.lit(0).cast("bigint")))
    return seen


def seed_pool(preds: DataFrame, seeds: list[int], keys: list[str], item: str = "item_id",
              carry: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Mean score per item over the seeds; only items scored by every seed stay."""
    mean = F.avg("score") if digits is None else F.round(F.avg("score"), digits)
    return (
        preds.where(F.col("seed").isin(*seeds)).groupBy(*keys, item)
        .agg(*[F.first(c).alias(c) for c in (carry or [])], mean.alias("score"), seeds_seen(seeds).alias("_n"))
        .where(F.col("_n") == len(set(seeds))).drop("_n")
    )


def seed_spread(preds: DataFrame, seeds: list[int], keys: list[str]) -> DataFrame:
    """Per-seed AUROC range, mean and sample deviation; cells missing a seed are left out."""
    per = auroc(preds.where(F.col("seed").isin(*seeds)), "y", "score", [*keys, "seed"])
    a = F.col("auroc")
    return (
        per.groupBy(*keys)
        .agg(F.avg(a).alias("seed_mean"), F.min(a).alias("seed_min"), F.max(a).alias("seed_max"),
             (F.max(a) - F.min(a)).alias("seed_spread"), F.stddev_samp(a).alias("seed_sd"),
             F.countDistinct("seed").alias("n_seeds"))
        .where(F.col("n_seeds") == len(set(seeds)))
    )


def join_arms(pooled: DataFrame, arms: list[str], keys: list[str], carry: list[str]) -> DataFrame:
    """One row per item with a score column per arm; items lacking an arm are dropped."""
    cols = [F.max(F.when(F.col("arm") == a, F.col("score"))).alias(a) for a in arms]
    return (
        pooled.where(F.col("arm").isin(*arms)).groupBy(*keys)
        .agg(*[F.first(c).alias(c) for c in carry], *cols).dropna(subset=[*arms, *carry])
    )


def fold_crops(preds: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """Record score as the mean over its crops; label and entity ride along."""
    return preds.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carry], F.round(F.avg("score"), 9).alias("score"),
        F.count(F.lit(1)).alias("n_crops"))


def macro_auroc(preds: DataFrame, target: str, by: list[str] | None = None) -> DataFrame:
    """Unweighted mean of the defined per-target AUROCs."""
    by = by or []
    per = auroc(preds, "y", "score", [*by, target])
    return per.groupBy(*by).agg(F.avg("auroc").alias("macro_auroc"),
                                F.count("auroc").alias("n_targets_scored"),
                                F.count(F.lit(1)).alias("n_targets"))


def midrank_spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Spearman correlation with average ranks per group; NULL if either side is flat.

    Pearson on mid-ranks, on the histogram of value pairs: tied pairs are one row before any join. Ranks are
    taken around their mean, which is known, so large groups lose no digits.
    """
    pair = df.dropna(subset=[x, y]).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_c"))
    sizes = pair.groupBy(*by).agg(F.sum("_c").alias("n"))

    def ranks(col: str, name: str) -> DataFrame:
        counts = pair.groupBy(*by, F.col(col)).agg(F.sum("_c").alias("_n"))
        run = running_before(counts, by, col, {"_before": "_n"})
        return run.select(*by, col, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name))

    a, b = (F.col(r) - (F.col("n") + 1) / 2.0 for r in ("_rx", "_ry"))
    sums = pair.join(F.broadcast(sizes), by).join(ranks(x, "_rx"), [*by, x]).join(ranks(y, "_ry"), [*by, y]).groupBy(*by).agg(
        F.sum(F.col("_c") * a * b).alias("_ab"), F.sum(F.col("_c") * a * a).alias("_aa"),
        F.sum(F.col("_c") * b * b).alias("_bb"), F.max("n").alias("n"))
    spread = F.sqrt("_aa") * F.sqrt("_bb")
    return sums.select(*by, F.when(spread > 0, F.col("_ab") / spread).alias("spearman"), "n")


def rank_correlation(x: str, y: str) -> Column:
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(~flat, F.corr(x, y))


def masked_focal_bce(preds: DataFrame, gamma: float, target: str, by: list[str] | None = None,
                     eps: float = 1e-7) -> DataFrame:
    """Sum over targets of the mean focal cross-entropy on the defined rows."""
    by = by or []
    p = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), F.col("score")))
    pt = F.when(F.col("y") == 1, p).otherwise(1 - p)
    loss = F.pow(1 - pt, F.lit(float(gamma))) * -F.log(pt)
    per = preds.where(F.col("y").isin(0, 1)).groupBy(*by, target).agg(F.avg(loss).alias("_loss"))
    out = [F.sum("_loss").alias("focal_loss"), F.count(F.lit(1)).alias("n_targets")]
    return per.groupBy(*by).agg(*out) if by else per.agg(*out)
