"""Decision curves: net benefit over thresholds and at a declared one."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stampline.functions.histogram import score_histogram
from stampline.operators.resampling import (
    OBSERVED, entity_draws, replicate_sums, summarise,
)
from stampline.session import pinned


def grid(lo: float, hi: float, step: float) -> list[float]:
    """Thresholds from lo up to hi, each a step above the one before, in exact decimals."""
    at, end, by = (Decimal(str(x)) for x in (lo, hi, step))
    cuts = []
    while at <= end:
        cuts.append(float(at))
        at += by
    return cuts


def net_benefit(tp: Column, fp: Column, n: Column, t: Column) -> Column:
    return tp / n - fp / n * (t / (1 - t))


def net_benefit_curve(df: DataFrame, y: str, p: str, thresholds: list[float], by: list[str]) -> DataFrame:
    """Net benefit, treat-all, treat-none and flagged share per threshold.

    A row falls in the slot of the highest threshold at or below its probability; the curve is
    a reverse running sum over the slots, so rows never meet the whole grid.
    """
    hist = score_histogram(df, y, p, by)
    cuts = F.array(*[F.lit(float(t)) for t in thresholds])
    slots = pinned(hist.withColumn("slot", F.size(F.filter(cuts, lambda t: F.col("score") >= t)))
                   .groupBy(*by, "slot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    totals = slots.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    ladder = F.posexplode(cuts).alias("_i", "threshold")
    steps = totals.select("*", ladder)
    at = steps.join(slots.withColumnRenamed("slot", "_slot"),
                    [steps[c].eqNullSafe(slots[c]) for c in by] + [F.col("_slot") == F.col("_i") + 1], "left") \
        .select(*[steps[c] for c in by], "_i", "threshold", "_p", "_n", "pos", "neg")
    w = Window.partitionBy(*by).orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tp = F.sum(F.coalesce("pos", F.lit(0.0))).over(w)
    fp = F.sum(F.coalesce("neg", F.lit(0.0))).over(w)
    n, t = F.col("_p") + F.col("_n"), F.col("threshold")
    return at.withColumns({"_tp": tp, "_fp": fp}).select(
        *by, "threshold", net_benefit(F.col("_tp"), F.col("_fp"), n, t).alias("net_benefit"),
        net_benefit(F.col("_p"), F.col("_n"), n, t).alias("treat_all"), F.lit(0.0).alias("treat_none"),
        ((F.col("_tp") + F.col("_fp")) / n).alias("flagged_share"), (F.col("_p") / n).alias("prevalence"))


def flag_counts(df: DataFrame, y: str, p: str, threshold: float, entity: str, by: list[str]) -> DataFrame:
    """(by, n, pos, tp, fp) over rows of a known entity: all a net benefit needs."""
    rows = df.where(F.col(y).isin(0, 1) & F.col(p).isNotNull() & F.col(entity).isNotNull())
    flag = F.col(p) >= F.lit(threshold)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"),
        F.count_if(flag & (F.col(y) == 1)).alias("tp"), F.count_if(flag & (F.col(y) == 0)).alias("fp"))


def net_benefit_at(pooled: DataFrame, seeds: DataFrame, y: str, p: str, threshold: float, entity: str,
                   by: list[str], n_boot: int, seed: int = 0, mode: str = "multinomial") -> DataFrame:
    """Net benefit at one threshold with interval, paired against treat-all, with seed spread."""
    counts = pinned(flag_counts(pooled, y, p, threshold, entity, [*by, entity]))
    draws = entity_draws(counts, entity, n_boot, seed, mode)
    sums = replicate_sums(counts, draws, entity, by, ["n", "pos", "tp", "fp"])
    t = F.lit(threshold)
    nb = net_benefit(F.col("tp"), F.col("fp"), F.col("n"), t)
    everyone = net_benefit(F.col("pos"), F.col("n") - F.col("pos"), F.col("n"), t)
    reps = pinned(sums.select("rep", *by, nb.alias("nb"), everyone.alias("all_nb"),
                              ((F.col("tp") + F.col("fp")) / F.col("n")).alias("flagged"),
                              (F.col("pos") / F.col("n")).alias("prevalence")))
    main = summarise(reps, by, n_boot, "nb").drop("p_value").withColumnRenamed("estimate", "net_benefit")
    versus = summarise(reps.withColumn("d", F.col("nb") - F.col("all_nb")), by, n_boot, "d").select(
        *by, F.col("estimate").alias("vs_treat_all"), F.col("ci_lo").alias("vs_treat_all_lo"),
        F.col("ci_hi").alias("vs_treat_all_hi"))
    seen = reps.where(F.col("rep") == OBSERVED).select(
        *by, F.col("all_nb").alias("treat_all"), F.col("flagged").alias("flagged_share"), "prevalence")
    per_seed = flag_counts(seeds, y, p, threshold, entity, [*by, "seed"]).groupBy(*by).agg(
        F.min(nb).alias("seed_nb_min"), F.max(nb).alias("seed_nb_max"),
        (F.max(nb) - F.min(nb)).alias("seed_nb_spread"))
    return main.join(versus, by).join(seen, by).join(per_seed, by).withColumns({
        "beats_treat_all": F.col("vs_treat_all_lo") > 0, "beats_treat_none": F.col("ci_lo") > 0})


def usable_probability_verdict(ece: DataFrame, benefit: DataFrame, by: list[str], n_schemes: int = 2) -> DataFrame:
    """Calibrated only if inside the null band under each of the declared schemes; joined to benefit and ranked.

    A scheme that is missing or has no band counts against the cell.

    Cells are declared (arm, label) pairs, so the ranking window is bounded by the declaration.
    """
    inside = F.bool_and(F.coalesce("inside_null_band", F.lit(False)))
    usable = ece.groupBy(*by).agg(F.count(F.lit(1)).alias("n_schemes"), inside.alias("_inside")).select(
        *by, "n_schemes", (F.col("_inside") & (F.col("n_schemes") == n_schemes)).alias("usable_probabilities"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("net_benefit").desc(), *by))
    return benefit.join(usable, by, "left") \
        .withColumn("usable_probabilities", F.coalesce("usable_probabilities", F.lit(False))) \
        .withColumn("place", place)
