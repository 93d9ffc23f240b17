"""Entity-clustered inference on rank statistics.

Everything starts from one pinned entity histogram: (cell keys, entity, score, pos, neg). The
input is read once; replicates, intervals, differences and ratios all come from that table.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stampline.functions.cellsums import MOST_CELLS, even_passes, fits, replicate_shares
from stampline.functions.expr import ratio
from stampline.functions.histogram import score_histogram
from stampline.functions.replicates import replicate_pairs
from stampline.operators.discrimination import (
    auroc, join_arms, rank_correlation, within_stratum_concordance,
)
from stampline.operators.resampling import (
    OBSERVED, REPLICATES_PER_PASS, Draws, entity_draws, placed_cells, summarise, with_weights,
)
from stampline.session import pinned

BASE = 0.5


# ---- replicate tables -------------------------------------------------------

def entity_histogram(df: DataFrame, y: str, score: str, entity: str, keys: list[str],
                     stratum: str | None = None) -> DataFrame:
    """Histogram per (keys, stratum, entity, score), written once."""
    groups = [*keys, *([stratum] if stratum else [])]
    return pinned(score_histogram(df.where(F.col(entity).isNotNull()), y, score, [*groups, entity]))


def replicate_statistic(hist: DataFrame, draws: Draws, entity: str, keys: list[str],
                        stratum: str | None = None) -> DataFrame:
    """(rep, keys, value): AUROC, or concordance inside strata, of every cell on every draw.

    Where the distinct scores of all cells are few, rows are put in entity order once and tasks add up sums per cell
    and score (`functions/cellsums.py`); else rows in score order carry their weights (`carried_statistic`).
    """
    groups = [*keys, *([stratum] if stratum else [])]
    cell = F.struct(*groups, "score").alias("_cell")
    distinct = hist.select(cell).distinct()
    n_cells = distinct.limit(MOST_CELLS + 1).count()
    if not fits(n_cells, draws.n_boot):
        return carried_statistic(hist, draws, entity, keys, stratum)
    placed, named, bands, passes = placed_cells(hist, distinct, n_cells, draws, entity)
    out = None
    for first, n in passes:
        part = replicate_shares(placed, named, draws.counts, draws.first + first, n, n_cells, bands, keys, stratum)
        if first:  # the observed sample came with the first pass
            part = part.where(F.col("rep") != OBSERVED)
        out = part if out is None else out.unionByName(part)
    return out


def carried_statistic(hist: DataFrame, draws: Draws, entity: str, keys: list[str],
                      stratum: str | None = None) -> DataFrame:
    """`replicate_statistic` with rows that carry their entity's weights, for scores that hardly repeat.

    Rows are range-partitioned by (keys, stratum, score, entity), so partitions stay even when one cell, stratum or
    score holds most rows. Passes are even and take at most REPLICATES_PER_PASS replicates, and a pass draws and joins
    only its own. With broadcast draws the rows stay where they are; with joined draws they are put back in score order,
    each carrying two bytes per replicate of the pass.
    """
    order = [*keys, *([stratum] if stratum else []), "score", entity]
    ordered = pinned(hist.repartitionByRange(*order).sortWithinPartitions(*order))
    out = None
    for first, per_pass in even_passes(draws.n_boot, REPLICATES_PER_PASS):
        block = draws.part(first, per_pass)
        rows = with_weights(ordered, block, entity)
        if not block.small:
            rows = rows.repartitionByRange(*order)
        part = replicate_pairs(rows.sortWithinPartitions(*order), keys, stratum)
        if first:  # the observed sample came with the first pass
            part = part.where(F.col("rep") != OBSERVED).withColumn("rep", F.col("rep") + first)
        out = part if out is None else out.unionByName(part)
    return out


def replicate_auroc(hist: DataFrame, entity: str, keys: list[str], n_boot: int, seed: int = 0,
                    mode: str = "multinomial", universe: DataFrame | None = None) -> DataFrame:
    """(rep, keys, value) on fresh draws; rep -1 is the observed sample."""
    draws = entity_draws(universe if universe is not None else hist, entity, n_boot, seed, mode)
    return replicate_statistic(hist, draws, entity, keys)


def cell_counts(hist: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """Rows, positives and entities of each cell."""
    agg = [F.sum(F.col("pos") + F.col("neg")).cast("bigint").alias("n_items"),
           F.sum("pos").cast("bigint").alias("n_positives"),
           F.countDistinct(entity).alias("n_groups")]
    return hist.groupBy(*keys).agg(*agg)


def common_rows(pooled: DataFrame, arms: list[str], by: list[str], item: str,
                carry: list[str]) -> DataFrame:
    """Long (by, item, carry, arm, score) over items every arm scored."""
    wide = join_arms(pooled, arms, [*by, item], carry)
    # Not unpivot, after which Spark no longer knows how the rows are dealt.
    scores = F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("score")) for a in arms])
    return wide.select(*by, item, *carry, F.inline(scores))


def pivot_arms(reps: DataFrame, by: list[str], arms: list[str]) -> DataFrame:
    """One row per (rep, by) with a value column per arm."""
    return reps.groupBy("rep", *by).agg(
        *[F.max(F.when(F.col("arm") == a, F.col("value"))).alias(a) for a in arms])


# ---- intervals --------------------------------------------------------------

def clustered_auroc_ci(df: DataFrame, y: str, score: str, entity: str, by: list[str],
                       n_boot: int, seed: int = 0, mode: str = "multinomial") -> DataFrame:
    """AUROC with percentile interval per cell, all cells on the same draws."""
    hist = entity_histogram(df, y, score, entity, by)
    reps = replicate_auroc(hist, entity, by, n_boot, seed, mode)
    out = summarise(reps, by, n_boot).drop("p_value").withColumnRenamed("estimate", "auroc")
    counts = cell_counts(hist, entity, by)
    return out.join(counts, by) if by else out.crossJoin(counts)


def arm_replicates(pooled: DataFrame, arms: list[str], by: list[str], item: str, entity: str,
                   n_boot: int, seed: int = 0, mode: str = "multinomial", universe: DataFrame | None = None
                   ) -> tuple[DataFrame, DataFrame]:
    """(wide replicate table over the arms, counts per cell) on the common rows.

    Draws are of the entities in `universe`, so that comparisons with one universe share them; by default of the
    entities in the common rows.
    """
    rows = common_rows(pooled, arms, by, item, [entity, "y"])
    hist = entity_histogram(rows, "y", "score", entity, [*by, "arm"])
    reps = replicate_auroc(hist, entity, [*by, "arm"], n_boot, seed, mode, universe)
    one_arm = hist.where(F.col("arm") == arms[0])
    return pinned(pivot_arms(reps, by, arms)), cell_counts(one_arm, entity, by)


COMPARISON = "comparison"


def compared_replicates(pooled: DataFrame, comparisons: dict[str, list[str]], by: list[str], item: str, entity: str,
                        n_boot: int, seed: int = 0, mode: str = "multinomial", universe: DataFrame | None = None
                        ) -> tuple[DataFrame, DataFrame]:
    """`arm_replicates` of several sets of arms at once: each set on the rows that all its arms scored.

    The name of the set joins the cell key as `comparison`, so rows are grouped, drawn and sorted once for all
    sets. Columns of arms outside a set are NULL. All sets share the draws: of the entities in `universe`, by default
    those in the rows of any set.
    """
    arms = list(dict.fromkeys(a for members in comparisons.values() for a in members))
    carry, keys = [entity, "y"], [*by, COMPARISON]
    wide = pooled.where(F.col("arm").isin(*arms)).groupBy(*by, item).agg(
        *[F.first(c).alias(c) for c in carry],
        *[F.max(F.when(F.col("arm") == a, F.col("score"))).alias(a) for a in arms]).dropna(subset=carry)
    cells = [F.when(reduce(and_, [F.col(m).isNotNull() for m in members]),
                    F.struct(F.lit(name).alias(COMPARISON), F.lit(a).alias("arm"), F.col(a).alias("score")))
             for name, members in comparisons.items() for a in dict.fromkeys(members)]
    rows = wide.select(*by, *carry, F.explode(F.array_compact(F.array(*cells))).alias("_c")).select(*by, *carry, "_c.*")
    hist = entity_histogram(rows, "y", "score", entity, [*keys, "arm"])
    reps = replicate_auroc(hist, entity, [*keys, "arm"], n_boot, seed, mode, universe)
    leads = reduce(or_, [(F.col(COMPARISON) == name) & (F.col("arm") == members[0])
                         for name, members in comparisons.items()])
    return pinned(pivot_arms(reps, keys, arms)), cell_counts(hist.where(leads), entity, keys)


def paired_auroc_diff(pooled: DataFrame, a: str, b: str, by: list[str], item: str, entity: str,
                      n_boot: int, seed: int = 0, mode: str = "multinomial") -> DataFrame:
    """AUROC(b) - AUROC(a) on the same draws, with interval and two-sided p."""
    wide, counts = arm_replicates(pooled, [a, b], by, item, entity, n_boot, seed, mode)
    diff = wide.withColumn("value", F.col(b) - F.col(a))
    ends = wide.where(F.col("rep") == OBSERVED).select(
        *by, F.col(a).alias("auroc_a"), F.col(b).alias("auroc_b"))
    out = summarise(diff, by, n_boot).withColumnRenamed("estimate", "difference")
    return out.join(ends, by).join(counts, by)


def clustered_macro_ci(preds: DataFrame, target: str, entity: str, by: list[str], n_boot: int,
                       seed: int = 0, mode: str = "multinomial") -> DataFrame:
    """Per-target and macro AUROC on one draw of entities; `target` is 'macro' for the mean.

    A target without both classes in a replicate is undefined there and left out of that
    replicate's mean; `n_undefined` counts such replicates.
    """
    hist = entity_histogram(preds, "y", "score", entity, [*by, target])
    reps = pinned(replicate_auroc(hist, entity, [*by, target], n_boot, seed, mode))
    macro = reps.groupBy("rep", *by).agg(F.avg("value").alias("value")) \
        .withColumn(target, F.lit("macro"))
    both = reps.select("rep", *by, target, "value").unionByName(macro)
    return summarise(both, [*by, target], n_boot).drop("p_value") \
        .withColumn("n_undefined", F.col("n_boot") - F.col("n_finite"))


def clustered_concordance_ci(df: DataFrame, y: str, score: str, stratum: str, entity: str,
                             by: list[str], n_boot: int, seed: int = 0,
                             mode: str = "multinomial") -> DataFrame:
    """Within-stratum concordance with an entity-clustered interval."""
    hist = entity_histogram(df.where(F.col(stratum).isNotNull()), y, score, entity, by, stratum)
    draws = entity_draws(hist, entity, n_boot, seed, mode)
    reps = replicate_statistic(hist, draws, entity, by, stratum)
    return summarise(reps, by, n_boot).withColumn("n_groups", F.lit(draws.n_entities).cast("bigint"))


# ---- ratios -----------------------------------------------------------------

def recovery_ratio(num: Column, den: Column) -> Column:
    """(num - 1/2) / (den - 1/2), undefined at a zero denominator."""
    return ratio(num - F.lit(BASE), den - F.lit(BASE))


def recovery_ratio_ci(pooled: DataFrame, arms: list[str], reference: str, by: list[str], item: str,
                      entity: str, n_boot: int, target: float, primary: tuple[str, str],
                      label: str = "label", seed: int = 0, mode: str = "multinomial") -> DataFrame:
    """Recovery ratio of each arm against the reference, resampled as one quantity.

    Each arm is compared on the rows it shares with the reference, all arms on the same draws: those of the
    entities of the whole table.
    """
    everyone = pinned(pooled.select(entity).distinct())
    wide, counts = compared_replicates(pooled, {arm: [arm, reference] for arm in arms}, by, item, entity, n_boot, seed,
                                       mode, everyone)
    keys = [*by, COMPARISON]
    own = F.coalesce(*[F.when(F.col(COMPARISON) == a, F.col(a)) for a in arms])
    vals = wide.withColumns({"numerator_auroc": own, "denominator_auroc": F.col(reference),
                             "value": recovery_ratio(own, F.col(reference))})
    ends = vals.where(F.col("rep") == OBSERVED).select(*keys, "numerator_auroc", "denominator_auroc")
    out = summarise(vals, keys, n_boot).join(ends, keys).join(counts, keys).withColumnRenamed(COMPARISON, "arm")
    return out.withColumns({
        "meets_target": F.coalesce(F.col("estimate") >= F.lit(target), F.lit(False)),
        "is_primary": (F.col("arm") == primary[0]) & (F.col(label) == primary[1])})


def recovery_ratio_fixed_denominator(df: DataFrame, denominators: DataFrame, entity: str,
                                     n_boot: int, target: float, seed: int = 0,
                                     mode: str = "multinomial", reference: DataFrame | None = None,
                                     item: str = "item_id") -> DataFrame:
    """Ratio against constants: only the numerator is resampled.

    `denominators` is a short declared table (name, denominator). With the rows of a reference arm, only items
    that it scored as well take part.
    """
    if reference is not None:
        df = df.join(reference.select(item).distinct(), item, "left_semi")
    hist = entity_histogram(df, "y", "score", entity, [])
    reps = replicate_auroc(hist, entity, [], n_boot, seed, mode)
    vals = reps.crossJoin(F.broadcast(denominators)).withColumn(
        "auroc", F.col("value")).withColumn(
        "value", recovery_ratio(F.col("auroc"), F.col("denominator")))
    numer = vals.where(F.col("rep") == OBSERVED).select("name", F.col("auroc").alias("numerator_auroc"))
    return (
        summarise(vals, ["name", "denominator"], n_boot).join(numer, "name")
        .withColumns({"meets_target": F.coalesce(F.col("estimate") >= F.lit(target), F.lit(False)),
                      "denominator_resampled": F.lit(False), "is_primary": F.lit(False)})
    )


def stratified_rows(pooled: DataFrame, strata: DataFrame, arms: list[str], by: list[str], item: str,
                    entity: str, stratum: str) -> DataFrame:
    """Common rows of the arms with their stratum, written once because several passes follow."""
    rows = common_rows(pooled, arms, by, item, [entity, "y"])
    return pinned(rows.join(strata.select(item, stratum).where(F.col(stratum).isNotNull()), item))


def matched_replicates(rows: DataFrame, base: str, wave: str, stratum: str, by: list[str],
                       item: str, entity: str, n_boot: int, seed: int = 0,
                       mode: str = "multinomial") -> tuple[DataFrame, DataFrame]:
    """(rep, by, w_in, b_in, w_all, b_all) on the informative rows, and their counts.

    `rows` is long with an arm column; a row is informative when its stratum holds both
    classes. Matched and unmatched statistics use the same rows and the same draws.
    """
    keys = [*by, "arm"]
    per = rows.groupBy(*keys, stratum).agg(F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    good = per.where((F.col("_lo") == 0) & (F.col("_hi") == 1)).select(*keys, stratum)
    kept = rows.join(good, [*keys, stratum], "left_semi")
    strat = entity_histogram(kept, "y", "score", entity, keys, stratum)
    hist = pinned(strat.groupBy(*keys, entity, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    draws = entity_draws(hist, entity, n_boot, seed, mode)
    within = replicate_statistic(strat, draws, entity, keys, stratum).withColumnRenamed("value", "within")
    plain = replicate_statistic(hist, draws, entity, keys).withColumnRenamed("value", "plain")
    both = within.join(plain, ["rep", *keys])

    def of(arm: str, col: str, name: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col(col))).alias(name)

    wide = both.groupBy("rep", *by).agg(
        of(wave, "within", "w_in"), of(base, "within", "b_in"),
        of(wave, "plain", "w_all"), of(base, "plain", "b_all"))
    return pinned(wide), cell_counts(hist.where(F.col("arm") == wave), entity, by)


def gain_retained(pooled: DataFrame, strata: DataFrame, base: str, wave: str, by: list[str],
                  item: str, entity: str, n_boot: int, threshold: float, stratum: str = "stratum",
                  seed: int = 0, mode: str = "multinomial") -> DataFrame:
    """How much of the gain of `wave` over `base` survives inside strata, in both readings."""
    rows = stratified_rows(pooled, strata, [base, wave], by, item, entity, stratum)
    wide, counts = matched_replicates(rows, base, wave, stratum, by, item, entity, n_boot, seed, mode)
    unmatched = F.col("w_all") - F.col("b_all")
    main = summarise(wide.withColumn("value", ratio(F.col("w_in") - F.col("b_in"), unmatched)), by, n_boot)
    alt = summarise(wide.withColumn("value", ratio(F.col("w_in") - F.col("b_all"), unmatched)), by, n_boot) \
        .select(*by, F.col("estimate").alias("retained_plain_baseline"),
                F.col("ci_lo").alias("retained_plain_baseline_lo"),
                F.col("ci_hi").alias("retained_plain_baseline_hi"))
    seen = wide.where(F.col("rep") == OBSERVED).select(
        *by, (F.col("w_in") - F.col("b_in")).alias("gain_matched"),
        unmatched.alias("gain_unmatched_same_rows"))
    whole = auroc(rows, "y", "score", [*by, "arm"]).groupBy(*by).agg(
        (F.max(F.when(F.col("arm") == wave, F.col("auroc")))
         - F.max(F.when(F.col("arm") == base, F.col("auroc")))).alias("gain_unmatched_full_cohort"))
    return (
        main.join(alt, by).join(seen, by).join(whole, by).join(counts, by)
        .withColumns({
            "meets_target": F.coalesce(F.col("estimate") <= F.lit(threshold), F.lit(False)),
            "meets_target_plain_baseline":
                F.coalesce(F.col("retained_plain_baseline") <= F.lit(threshold), F.lit(False))})
    )


def restricted_vs_plain_diff(pooled: DataFrame, strata: DataFrame, arm: str, by: list[str],
                             item: str, entity: str, n_boot: int, stratum: str = "stratum",
                             seed: int = 0, mode: str = "multinomial") -> DataFrame:
    """Within-stratum concordance minus plain AUROC of one arm, same rows, same draws."""
    rows = stratified_rows(pooled, strata, [arm], by, item, entity, stratum)
    wide, counts = matched_replicates(rows, arm, arm, stratum, by, item, entity, n_boot, seed, mode)
    diff = summarise(wide.withColumn("value", F.col("w_in") - F.col("w_all")), by, n_boot)
    seen = wide.where(F.col("rep") == OBSERVED).select(
        *by, F.col("w_in").alias("within"), F.col("w_all").alias("plain"))
    return diff.withColumnRenamed("estimate", "difference").join(seen, by).join(counts, by)


# ---- trends and ladders -----------------------------------------------------

def replicate_spearman(reps: DataFrame, x: str, value: str, n_points: int, by: list[str] | None = None) -> DataFrame:
    """(rep, by, value): Spearman between x and value per replicate, undefined unless all points are.

    Each replicate holds one row per horizon, so its window is bounded by the declared ladder.
    """
    keys = ["rep", *(by or [])]

    def midrank(col: str) -> Column:
        w = Window.partitionBy(*keys)
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, col))
        return F.rank().over(w.orderBy(col)) + (ties - 1) / 2.0

    ranked = reps.select(*keys, F.col(value).alias("_v"), midrank(x).alias("_rx"), midrank(value).alias("_ry"))
    full = F.count("_v") == n_points  # then no rank counts an undefined point
    return ranked.groupBy(*keys).agg(F.when(full, rank_correlation("_rx", "_ry")).alias("value"))


def horizon_trend(pooled: DataFrame, horizons: dict[str, int], a: str, b: str, quantity: str | list[str],
                  item: str, entity: str, n_boot: int, label: str = "label", seed: int = 0,
                  mode: str = "multinomial") -> DataFrame:
    """Spearman of horizon against b - a ('delta') or the ratio of a to b ('ratio'), one row per quantity asked for.

    Several quantities come from one table of replicates. A table without common rows gives no row.
    """
    rows = pooled.where(F.col(label).isin(*horizons))
    wide, _ = arm_replicates(rows, [a, b], [label], item, entity, n_boot, seed, mode)
    made = {"delta": F.col(b) - F.col(a), "ratio": recovery_ratio(F.col(a), F.col(b))}
    asked = [quantity] if isinstance(quantity, str) else quantity
    parts = F.array(*[F.struct(F.lit(q).alias("quantity"), made[q].alias("q")) for q in asked])
    days = F.create_map(*[F.lit(x) for pair in horizons.items() for x in pair])
    values = wide.select("rep", days[F.col(label)].alias("horizon"), F.explode(parts).alias("_p")) \
        .select("rep", "horizon", "_p.*")
    reps = replicate_spearman(values, "horizon", "q", len(horizons), ["quantity"])
    return summarise(reps, ["quantity"], n_boot).withColumns({
        "n_labels": F.lit(len(horizons)).cast("bigint"),
        "supported": F.coalesce((F.col("estimate") < 0) & (F.col("ci_hi") < 0), F.lit(False))})


def horizon_ladder(pooled: DataFrame, horizons: dict[str, int], primary: list[str], a: str, b: str,
                   item: str, entity: str, n_boot: int, label: str = "label", seed: int = 0,
                   mode: str = "multinomial") -> DataFrame:
    """Paired difference per horizon; only primary horizons count as confirmation."""
    rows = pooled.where(F.col(label).isin(*horizons))
    days = F.create_map(*[F.lit(x) for pair in horizons.items() for x in pair])
    is_primary = F.col(label).isin(*primary)
    return paired_auroc_diff(rows, a, b, [label], item, entity, n_boot, seed, mode).withColumns({
        "horizon": days[F.col(label)].cast("bigint"),
        "role": F.when(is_primary, "primary").otherwise("generating"),
        "counts_as_confirmation": is_primary})


# ---- multiplicity -----------------------------------------------------------

def holm(tests: DataFrame, p: str, m: int, n_boot: int, family: list[str] | None = None,
         order: list[str] | None = None) -> DataFrame:
    """Holm step-down at a declared family size, with the resampling floor made visible.

    A family holds at most the declared tests, so its window is bounded by m.
    """
    family = family or []
    floor = 2.0 / n_boot
    shown = format(Fraction(2, n_boot), ".12f").rstrip("0")  # the smallest p-value there is, never rounded to less
    part = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    step = part.orderBy(p, *(order or []))
    i = F.row_number().over(step) - 1
    raw = F.least(F.lit(1.0), (F.lit(m) - i) * F.col(p))
    present = F.count(F.lit(1)).over(part)
    return (
        tests.withColumn("_raw", raw)
        .withColumn("p_holm", F.max("_raw").over(step.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_raw")
        .withColumns({
            "holm_family_size": F.lit(m).cast("bigint"), "holm_tests_present": present,
            "holm_tests_pending": F.lit(m) - present, "at_floor": F.col(p) < F.lit(floor)})
        .withColumn("p_text", F.when(F.col("at_floor"), F.lit(f"<{shown}"))
                    .otherwise(F.format_string("%.4f", F.col(p))))
    )


def family_union(parts: dict[str, DataFrame], p: str, m: int, n_boot: int,
                 keys: list[str]) -> DataFrame:
    """Contrasts of several phases as one family, Holm recomputed at its full size."""
    both = None
    for phase, df in parts.items():
        one = df.select(*keys, p).withColumn("phase", F.lit(phase))
        both = one if both is None else both.unionByName(one)
    out = holm(both, p, m, n_boot, order=keys)
    return out.withColumn("family_complete", F.col("holm_tests_present") == F.col("holm_family_size"))


def noise_floor(spread: DataFrame, contrasts: DataFrame, by: list[str]) -> DataFrame:
    """Does each contrast clear the larger seed spread of its two arms?"""
    def side(name: str) -> DataFrame:
        return spread.select(F.col("arm").alias(name), *by, F.col("seed_spread").alias(f"_{name}"))

    floor = F.greatest(F.coalesce("_arm_a", F.lit(0.0)), F.coalesce("_arm_b", F.lit(0.0)))
    return (
        contrasts.join(side("arm_a"), ["arm_a", *by], "left").join(side("arm_b"), ["arm_b", *by], "left")
        .withColumn("noise_floor", floor).drop("_arm_a", "_arm_b")
        .withColumn("clears_noise_floor", F.abs("difference") > F.col("noise_floor"))
    )


# ---- controls and sensitivities --------------------------------------------

def stat_controls(df: DataFrame, y: str, score: str, stratum: str) -> DataFrame:
    """Three checks the concordance must pass on derived frames of the given rows.

    One stratum gives the plain statistic; a score that only knows the stratum falls to 1/2
    inside strata; doubling every row changes nothing.
    """
    rows = df.where(F.col(y).isin(0, 1) & F.col(stratum).isNotNull()) \
        .select(F.col(y).alias("y"), F.col(score).alias("score"), F.col(stratum).alias("stratum"))
    rate = rows.groupBy("stratum").agg(F.avg("y").alias("_rate"))
    twice = F.explode(F.array(F.lit(0), F.lit(1)))
    frames = {
        "single_stratum": rows.withColumn("stratum", F.lit("all")),
        "constant_within_stratum": rows.join(rate, "stratum").withColumn("score", F.col("_rate")).drop("_rate"),
        "duplicated_rows": rows.withColumn("stratum", F.lit("all")).withColumn("_c", twice).drop("_c"),
    }
    tagged = None
    for name, frame in frames.items():
        one = frame.select("y", "score", "stratum", F.lit(name).alias("control"))
        tagged = one if tagged is None else tagged.unionByName(one)
    plain = auroc(tagged, "y", "score", ["control"])
    within = within_stratum_concordance(tagged, "y", "score", "stratum", ["control"])
    strata = tagged.groupBy("control").agg(F.countDistinct("stratum").alias("n_strata"))
    return plain.join(within, "control").join(strata, "control").select(
        "control", F.col("auroc").alias("unstratified"), F.col("concordance").alias("within_stratum"),
        (F.col("n_pos") + F.col("n_neg")).alias("n_items"), "n_strata")


def unit_restriction_sensitivity(crops: DataFrame, first_items: DataFrame, target: str, item: str,
                                 entity: str, n_boot: int, seed: int = 0,
                                 mode: str = "multinomial") -> DataFrame:
    """Macro AUROC at crop and record unit, on all rows and on first-of-episode rows."""
    # Crops meet the first items before they are folded, so that a table dealt by item stays where it is.
    first = first_items.select(item).distinct().withColumn("_first", F.lit(True))
    marked = crops.select(target, item, entity, "y", "score").join(first, item, "left")
    records = marked.groupBy(target, item).agg(
        F.first(entity).alias(entity), F.first("y").alias("y"),
        F.round(F.avg("score"), 9).alias("score"), F.first("_first").alias("_first"))
    cols = [target, entity, "y", "score", "_first"]
    units = marked.select(*cols, F.lit("crop").alias("unit")) \
        .unionByName(records.select(*cols, F.lit("record").alias("unit")))
    scopes = F.when(F.col("_first"), F.array(F.lit("all"), F.lit("first_of_episode"))) \
        .otherwise(F.array(F.lit("all")))
    rows = units.select(*cols[:-1], "unit", F.explode(scopes).alias("restriction"))
    by = ["unit", "restriction"]
    hist = entity_histogram(rows, "y", "score", entity, [*by, target])
    reps = replicate_auroc(hist, entity, [*by, target], n_boot, seed, mode)
    macro = reps.groupBy("rep", *by).agg(F.avg("value").alias("value"))
    counts = hist.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).cast("bigint").alias("n_scored"),
        F.countDistinct(target).alias("n_targets"), F.countDistinct(entity).alias("n_groups"))
    return summarise(macro, by, n_boot).drop("p_value").withColumnRenamed("estimate", "macro_auroc") \
        .join(counts, by)


def arm_sensitivity(pooled: DataFrame, pairs: list[tuple[str, str, str]], reference: str,
                    by: list[str], item: str, entity: str, n_boot: int, seed: int = 0,
                    mode: str = "multinomial") -> DataFrame:
    """Exploratory against declared arm on common rows: AUROC, recovery ratio, paired difference.

    All pairs share one table of replicates, drawn from the entities in any pair's common rows.
    """
    sets = {str(i): list(dict.fromkeys([arm, declared, reference])) for i, (arm, declared, _) in enumerate(pairs)}
    wide, counts = compared_replicates(pooled, sets, by, item, entity, n_boot, seed, mode)

    def part(quantity: str, who: str, value: Column) -> Column:
        return F.struct(F.lit(quantity).alias("quantity"), F.lit(who).alias("arm"), value.alias("value"))

    def parts(arm: str, declared: str) -> Column:
        return F.array(*[part("auroc", m, F.col(m)) for m in (arm, declared)],
                       *[part("recovery_ratio", m, recovery_ratio(F.col(m), F.col(reference))) for m in (arm, declared)],
                       part("paired_difference", f"{declared} - {arm}", F.col(declared) - F.col(arm)))

    def of_pair(choice) -> Column:
        return F.coalesce(*[F.when(F.col(COMPARISON) == str(i), choice(*pair)) for i, pair in enumerate(pairs)])

    keys = [*by, COMPARISON]
    long = wide.select("rep", *keys, F.explode(of_pair(lambda arm, declared, _: parts(arm, declared))).alias("_p")) \
        .select("rep", *keys, "_p.*")
    return summarise(long, [*keys, "quantity", "arm"], n_boot).join(counts, keys).withColumns({
        "question": of_pair(lambda arm, declared, question: F.lit(question)),
        "declared_arm": of_pair(lambda arm, declared, question: F.lit(declared))}).drop(COMPARISON)
