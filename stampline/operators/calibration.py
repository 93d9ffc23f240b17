"""Calibration: binning, reliability, ECE with its null band, intercept and slope."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampline.functions.cellsums import REPLICATES, cell_sums
from stampline.functions.expr import uniform
from stampline.functions.histogram import score_histogram
from stampline.functions.matrices import (
    CELLS_PER_CHUNK, RANGE, SUMS, NewtonCell, key_schema, keyed, mass_bin_sums, newton_parts, newton_sums, range_carries,
    tag_first, with_carries,
)
from stampline.functions.ordered import running_before
from stampline.operators.resampling import (
    OBSERVED, SUMS_PER_PASS, Draws, array_sums, entity_draws, placed_cells, replicate_sums, summarise, with_weights,
)
from stampline.session import pinned

SCHEMES = ("equal_width", "equal_mass")
#: Probabilities are kept this far from 0 and 1 before taking logits.
LOGIT_CLIP = 1e-12
#: A spread of logits below this leaves the slope undefined.
FLAT_LOGIT = 1e-8
#: State rows (one per fitted cell) that are broadcast between Newton steps.
BROADCAST_STATE = 2_000_000
#: Most (cell, probability) pairs whose sums a task holds for one part of the replicates.
MOST_PROBABILITIES = 50_000


# ---- bins -------------------------------------------------------------------

def width_bin(p: Column, k: int) -> Column:
    return F.least(F.lit(k - 1), F.greatest(F.lit(0), F.floor(p * k))).cast("int")


def mass_bin(rank: Column, n: Column, k: int) -> Column:
    """ceil(k * rank / n) - 1, where tied scores share the rank of the first of them."""
    return (F.ceil(k * rank.cast("double") / n) - 1).cast("int")


def equal_width_bin(df: DataFrame, p: str, k: int, name: str = "bin") -> DataFrame:
    return df.withColumn(name, width_bin(F.col(p), k))


def binned_histogram(hist: DataFrame, keys: list[str], k: int, scheme: str) -> DataFrame:
    """Add `bin` to a histogram (keys, score, pos, neg) and the row count `n`."""
    rows = hist.withColumn("n", F.col("pos") + F.col("neg"))
    if scheme == "equal_width":
        return rows.withColumn("bin", width_bin(F.col("score"), k))
    if scheme != "equal_mass":
        raise ValueError(f"scheme must be one of {SCHEMES}, not {scheme!r}")
    run = running_before(rows, keys, "score", {"_before": "n"})
    total = rows.groupBy(*keys).agg(F.sum("n").alias("_total")) if keys else rows.agg(F.sum("n").alias("_total"))
    run = run.join(total, keys) if keys else run.crossJoin(F.broadcast(total))
    return run.withColumn("bin", mass_bin(F.col("_before") + 1, F.col("_total"), k)).drop("_before", "_total")


def equal_mass_bin(df: DataFrame, p: str, k: int, by: list[str] | None = None, name: str = "bin") -> DataFrame:
    """Blocks of about n/k rows by score; a boundary never cuts through tied scores.

    Bins are found on the distinct scores and joined back to the rows.
    """
    by = by or []
    hist = df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("score")) \
        .agg(F.count(F.lit(1)).cast("double").alias("pos")).withColumn("neg", F.lit(0.0))
    bins = binned_histogram(hist, by, k, "equal_mass").select(*by, F.col("score").alias(p), F.col("bin").alias(name))
    return df.join(bins, [*by, p], "left")


# ---- reliability and ECE ----------------------------------------------------

def reliability_of(binned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, n, mean_predicted, observed_rate, gap) for occupied bins."""
    n, sp, sy = F.sum("n"), F.sum(F.col("score") * F.col("n")), F.sum("pos")
    return binned.groupBy(*keys, "bin").agg(
        n.alias("n"), (sp / n).alias("mean_predicted"), (sy / n).alias("observed_rate"),
        (sy / n - sp / n).alias("gap"))


def ece_of(curve: DataFrame, keys: list[str], name: str = "ece") -> DataFrame:
    """Mean absolute gap over the bins, weighted by their rows."""
    value = F.sum(F.col("n") * F.abs("gap")) / F.sum("n")
    return curve.groupBy(*keys).agg(value.alias(name)) if keys else curve.agg(value.alias(name))


def reliability(df: DataFrame, y: str, p: str, k: int, scheme: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    hist = score_histogram(df, y, p, by)
    return reliability_of(binned_histogram(hist, by, k, scheme), by).withColumn("n", F.col("n").cast("bigint"))


def ece(df: DataFrame, y: str, p: str, k: int, scheme: str, by: list[str] | None = None) -> DataFrame:
    return ece_of(reliability(df, y, p, k, scheme, by), by or [])


def bin_occupancy(curve: DataFrame, by: list[str], k: int) -> DataFrame:
    """Occupied bins, smallest and largest occupied count."""
    return curve.groupBy(*by).agg(
        F.lit(k).cast("bigint").alias("n_bins"), F.count(F.lit(1)).alias("n_occupied"),
        F.min("n").alias("count_min"), F.max("n").alias("count_max"))


def ece_ci(df: DataFrame, y: str, p: str, entity: str, k: int, scheme: str, by: list[str], n_boot: int,
           seed: int = 0, mode: str = "multinomial") -> DataFrame:
    """ECE interval; every replicate finds its own bins.

    Equal-width bins are fixed by the score, so rows shrink to one per (entity, bin) before the
    replicates come in. Equal-mass bins follow the running replicate weight: rows stay in score order, each
    carrying its entity's weights, and ranges learn from one carry row what lies below them in every replicate.
    """
    rows = df.where(F.col(entity).isNotNull())
    if scheme == "equal_width":
        hist = score_histogram(rows, y, p, [*by, entity]).withColumns({
            "n": F.col("pos") + F.col("neg"), "bin": width_bin(F.col("score"), k)})
        frame = pinned(hist.groupBy(*by, entity, "bin").agg(
            F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("score") * F.col("n")).alias("sp")))
        draws = entity_draws(frame, entity, n_boot, seed, mode)
        sums = replicate_sums(frame, draws, entity, [*by, "bin"], ["n", "pos", "sp"]).where("n > 0")
        curve = sums.withColumn("gap", F.col("pos") / F.col("n") - F.col("sp") / F.col("n"))
        out = summarise(ece_of(curve, ["rep", *by], "value"), by, n_boot) \
            .withColumn("n_groups", F.lit(draws.n_entities).cast("bigint"))
    else:
        rows, keys = keyed(rows, by)
        order = [*keys, "score", entity]
        hist = score_histogram(rows, y, p, [*keys, entity]).repartitionByRange(*order).sortWithinPartitions(*order)
        hist = pinned(tag_first(hist, keys))
        draws = entity_draws(hist, entity, n_boot, seed, mode)
        sums = replicate_mass_bins(hist, draws, entity, keys, k)
        curve = sums.withColumn("gap", F.col("pos") / F.col("n") - F.col("sp") / F.col("n"))
        out = summarise(ece_of(curve, ["rep", *keys], "value"), keys, n_boot).drop("_all") \
            .withColumn("n_groups", F.lit(draws.n_entities).cast("bigint"))
    return out.drop("p_value").withColumn("point_below_ci_lo", F.col("estimate") < F.col("ci_lo"))


def replicate_mass_bins(hist: DataFrame, draws: Draws, entity: str, by: list[str], k: int) -> DataFrame:
    """(rep, by, bin, n, pos, sp) of bins of equal mass on every draw; `hist` went through `tag_first`."""
    out = None
    for first in range(0, draws.n_boot, SUMS_PER_PASS):
        block = draws.part(first, SUMS_PER_PASS)
        rows = with_weights(hist, block, entity)
        if not block.small:
            rows = in_ranges(rows, [*by, "score", entity])
        carries = pinned(range_carries(rows, by))
        rows, kept = with_carries(rows, carries, by, block.n_boot + 1)
        if not kept:
            rows = in_ranges(rows, [*by, "score", entity])
        sums = mass_bin_sums(rows, by, k)
        part = sums.select((F.col("place") - 1 + F.when(F.col("place") > 0, first).otherwise(0)).alias("rep"),
                           *by, "bin", "n", "pos", "sp")
        if first:
            part = part.where(F.col("rep") != OBSERVED)
        out = part if out is None else out.unionByName(part)
    return out


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """Back to the ranges of `tag_first` after a join by key."""
    n = rows.agg(F.max(RANGE)).first()[0]
    return rows.repartitionById((n or 0) + 1, F.col(RANGE)).sortWithinPartitions(*order)


def ece_seed_spread(df: DataFrame, y: str, p: str, k: int, scheme: str, by: list[str], seed: str = "seed") -> DataFrame:
    """ECE of every seed (mean, smallest, largest, spread) with the mean prediction and the observed rate.

    Rows without a defined outcome or a probability take no part.
    """
    rows = df.where(F.col(y).isin(0, 1) & F.col(p).isNotNull())
    per = ece(rows, y, p, k, scheme, [*by, seed]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("ece").alias("seed_ece_mean"), F.min("ece").alias("seed_ece_min"),
        F.max("ece").alias("seed_ece_max"), (F.max("ece") - F.min("ece")).alias("seed_ece_spread"))
    level = rows.groupBy(*by).agg(F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed_rate"))
    return per.join(level, by)


def ece_null_band(df: DataFrame, y: str, p: str, item: str, k: int, scheme: str, by: list[str],
                  n_draws: int, seed: int = 0) -> DataFrame:
    """What a perfectly calibrated score of this size and shape would show.

    Outcomes are redrawn from the scores. Bins do not depend on the outcome, so a draw only
    adds one count per bin, summed inside the tasks; no row is repeated per draw.
    """
    rows = df.where(F.col(y).isin(0, 1) & F.col(p).isNotNull())
    binned = equal_width_bin(rows, p, k) if scheme == "equal_width" else equal_mass_bin(rows, p, k, by)
    hits = F.transform(F.sequence(F.lit(0), F.lit(n_draws - 1)),
                       lambda d: (uniform(F.lit(seed), d, F.col(item)) < F.col(p)).cast("smallint"))
    counted = array_sums(binned.select(*by, "bin", F.lit(1).alias("hits"), hits.alias("w")), [*by, "bin"], ["hits"])
    sizes = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(p).alias("_p"))
    curves = counted.join(F.broadcast(sizes), [*by, "bin"])  # k bins a cell
    drawn = ece_of(curves.withColumn("gap", F.col("hits") / F.col("n") - F.col("_p")), [*by, "place"])
    q = F.percentile("ece", F.array(F.lit(0.025), F.lit(0.975)))
    band = drawn.groupBy(*by).agg(q.alias("_q")).select(
        *by, F.col("_q")[0].alias("null_lo"), F.col("_q")[1].alias("null_hi"))
    point = ece(df, y, p, k, scheme, by)
    return point.join(band, by).withColumn(
        "inside_null_band", F.col("ece").between(F.col("null_lo"), F.col("null_hi")))


# ---- intercept and slope ----------------------------------------------------

def logit(p: Column) -> Column:
    q = F.least(F.lit(1 - LOGIT_CLIP), F.greatest(F.lit(LOGIT_CLIP), p))
    return F.log(q / (1 - q))


#: The two fits that share a pass: offset only (slope fixed at one), and intercept with slope.
FITS = ("offset", "full")


def logistic_fits(cells: DataFrame, keys: list[str], max_iter: int = 25) -> DataFrame:
    """Both logistic fits of (pos, n) on x per cell by damped Newton.

    Returns (keys, offset_a, full_a, full_b, offset_done, full_done). `cells` holds
    (keys, x, n, pos) and should be a written table. One grouped aggregate per step serves all
    cells and both fits: it scores the candidates, and where the log-likelihood fell the step is
    halved instead of taken. Settled cells leave the loop; one scalar per step tells whether any
    is left.
    """
    cols = {}
    for f in FITS:
        cols |= {f"{f}_a": F.lit(0.0), f"{f}_b": F.lit(1.0 if f == "offset" else 0.0), f"{f}_da": F.lit(0.0), f"{f}_db": F.lit(0.0),
                 f"{f}_ll": F.lit(float("-inf")), f"{f}_done": F.lit(False)}
    aggs, steps, dones = newton_expressions(list(cols))
    finished = F.col("offset_done") & F.col("full_done")
    active = pinned(cells.select(*keys).distinct().withColumns(cols))
    settled, left = [], active.count()
    for _ in range(max_iter):
        table = F.broadcast(active) if left <= BROADCAST_STATE else active
        state = pinned(cells.join(table, keys).groupBy(*keys).agg(*aggs)
                       .select(*keys, *steps).select(*keys, *[c for c in cols if not c.endswith("_done")], *dones))
        settled.append(state.where(finished))
        active = state.where(~finished)
        left = active.count()
        if not left:
            break
    out = active
    for part in settled:
        out = out.unionByName(part)
    return out.select(*keys, "offset_a", "full_a", "full_b", "offset_done", "full_done")


def newton_expressions(state: list[str], tol: float = 1e-8) -> tuple[list[Column], list[Column], list[Column]]:
    """Sums of one pass, the step they imply, and which fits have settled."""
    aggs = [F.first(c).alias(c) for c in state]
    for f in FITS:
        eta = F.col(f"{f}_a") + F.col(f"{f}_da") + (F.col(f"{f}_b") + F.col(f"{f}_db")) * F.col("x")
        mu = 1.0 / (1.0 + F.exp(-eta))
        # log(1 + e^eta) without overflow
        soft = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
        r, w = F.col("pos") - F.col("n") * mu, F.col("n") * mu * (1 - mu)
        aggs += [F.sum(F.col("pos") * eta - F.col("n") * soft).alias(f"{f}_try"),
                 F.sum(r).alias(f"{f}_g0"), F.sum(w).alias(f"{f}_h00")]
        if f == "full":
            aggs += [F.sum(r * F.col("x")).alias("g1"), F.sum(w * F.col("x")).alias("h01"),
                     F.sum(w * F.col("x") * F.col("x")).alias("h11")]
    det = F.nullif(F.col("full_h00") * F.col("h11") - F.col("h01") * F.col("h01"), F.lit(0.0))
    newton = {
        "offset": (F.col("offset_g0") / F.nullif(F.col("offset_h00"), F.lit(0.0)), F.lit(0.0)),
        "full": ((F.col("h11") * F.col("full_g0") - F.col("h01") * F.col("g1")) / det,
                 (F.col("full_h00") * F.col("g1") - F.col("h01") * F.col("full_g0")) / det)}
    steps, dones = [], []
    for f in FITS:
        done, gained = F.col(f"{f}_done"), F.col(f"{f}_try")
        # Near the optimum the likelihood only moves by rounding, which is not a loss.
        better = gained >= F.col(f"{f}_ll") - 1e-10 * F.abs(gained)
        for part, move in zip(("a", "b"), newton[f]):
            here, by = F.col(f"{f}_{part}"), F.col(f"{f}_d{part}")
            steps += [F.when(~done & better, here + by).otherwise(here).alias(f"{f}_{part}"),
                      F.when(done, 0.0).when(better, F.coalesce(move, F.lit(0.0))).otherwise(by / 2).alias(f"{f}_d{part}")]
        steps += [F.when(~done & better, gained).otherwise(F.col(f"{f}_ll")).alias(f"{f}_ll"),
                  better.alias(f"{f}_ok"), done]
        small = (F.abs(f"{f}_da") < tol) & (F.abs(f"{f}_db") < tol)
        dones.append((done | (F.col(f"{f}_ok") & small)).alias(f"{f}_done"))
    return aggs, steps, dones


def logit_cells(df: DataFrame, y: str, p: str, keys: list[str]) -> DataFrame:
    """(keys, x, n, pos): one row per distinct probability, which is all a fit needs."""
    hist = score_histogram(df, y, p, keys)
    return hist.select(*keys, "score", logit(F.col("score")).alias("x"),
                       (F.col("pos") + F.col("neg")).alias("n"), "pos")


def flat_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, flat, one_class): where a slope or any fit is undefined."""
    mean = F.sum(F.col("n") * F.col("x")) / F.sum("n")
    square = F.sum(F.col("n") * F.col("x") * F.col("x")) / F.sum("n")
    least = F.greatest(F.lit(FLAT_LOGIT ** 2), 1e-14 * square)  # the rounding of long sums
    return cells.groupBy(*keys).agg(
        (square - mean * mean < least).alias("flat"),
        ((F.sum("pos") == 0) | (F.sum("pos") == F.sum("n"))).alias("one_class"))


def fit_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, intercept, slope): NULL where undefined or not converged.

    A cell with one class has no fit and never enters the loop.
    """
    marks = pinned(flat_cells(cells, keys))
    sound = cells.join(marks.where(F.col("one_class")), keys, "left_anti")
    fits = logistic_fits(pinned(sound), keys)
    return marks.join(fits, keys, "left").select(
        *keys, F.when(F.col("offset_done"), F.col("offset_a")).alias("intercept"),
        F.when(F.col("full_done") & ~F.col("flat"), F.col("full_b")).alias("slope"))


def calibration_fit(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """(by, intercept, slope) from one loop over the distinct probabilities."""
    rows, keys = keyed(df, by or [])
    return fit_cells(pinned(logit_cells(rows, y, p, keys)), keys).select(*(by or []), "intercept", "slope")


def calibration_intercept(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Intercept of a logistic fit with logit(p) as offset, slope fixed at one."""
    return calibration_fit(df, y, p, by).drop("slope")


def calibration_slope(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Coefficient on logit(p); NULL when the logits are flat or a class is absent."""
    return calibration_fit(df, y, p, by).drop("intercept")


def calibration_fit_ci(df: DataFrame, y: str, p: str, entity: str, by: list[str], n_boot: int, seed: int = 0,
                       mode: str = "multinomial") -> DataFrame:
    """(by, quantity, estimate, interval) for intercept, slope and Brier on the same draws.

    Where distinct probabilities are few, the counts of all replicates are added up per probability
    (`functions/cellsums.py`) and a task fits a few replicates of one cell to the end. Else rows carry their weights
    (`carried_fits`). The cells of `by` are declared or few.
    """
    rows, keys = keyed(df.where(F.col(entity).isNotNull()), by)
    hist = pinned(score_histogram(rows, y, p, [*keys, entity]))
    draws = entity_draws(hist, entity, n_boot, seed, mode)
    distinct = hist.select(F.struct(*keys, "score").alias("_cell")).distinct()
    n_cells = distinct.limit(MOST_PROBABILITIES + 1).count()
    long = summed_fits(hist, distinct, n_cells, draws, entity, keys) if 0 < n_cells <= MOST_PROBABILITIES \
        else carried_fits(hist, draws, entity, keys)
    long = long.unpivot(["rep", *keys], ["intercept", "slope", "brier"], "quantity", "value")
    return summarise(long, [*keys, "quantity"], n_boot).select(
        *by, "quantity", "estimate", "ci_lo", "ci_hi", "n_boot", "n_finite",
        (F.col("n_boot") - F.col("n_finite")).alias("n_undefined"))


def flat_logits(n: np.ndarray, nx: np.ndarray, nxx: np.ndarray) -> np.ndarray:
    """Where the logits hardly differ; sums over many rows leave a relative error of some 1e-15 in the variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean, square = nx / n, nxx / n
        return ~(square - mean * mean >= np.maximum(FLAT_LOGIT ** 2, 1e-14 * square))


def summed_fits(hist: DataFrame, distinct: DataFrame, n_cells: int, draws: Draws, entity: str, keys: list[str]) -> DataFrame:
    """(rep, keys, intercept, slope, brier) of all replicates from sums per cell and probability.

    A task holds the sums of one cell for the replicates of one part: probabilities x REPLICATES.
    """
    placed, named, bands, passes = placed_cells(hist, distinct, n_cells, draws, entity)
    named = named.withColumn("x", logit(F.col("score")))
    out = None
    for first, n in passes:
        sums = cell_sums(placed, draws.counts, draws.first + first, n, n_cells, bands)
        rows = sums.join(F.broadcast(named), "_id").select(*keys, "_part", "_id", "x", "score", "pos", "neg")
        part = rows.groupBy(*keys, "_part").applyInArrow(
            fits_of_part(keys), "rep long, " + key_schema(rows, keys) + "intercept double, slope double, brier double")
        rep = F.when(F.col("rep") >= 0, F.col("rep") + draws.first + first).otherwise(F.col("rep")).alias("rep")
        part = part.select(rep, *keys, "intercept", "slope", "brier")
        if first:  # the observed sample came with the first pass
            part = part.where(F.col("rep") != OBSERVED)
        out = part if out is None else out.unionByName(part)
    return out


def fits_of_part(keys: list[str], max_iter: int = 25):
    """The fits of a part's replicates, from rows (x, score, pos, neg) of one cell with its sums per replicate."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_id").combine_chunks()
        ids = table.column("_id").to_numpy()
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        pos, neg = (np.add.reduceat(table.column(c).combine_chunks().flatten().to_numpy().reshape(len(ids), -1), starts, axis=0)
                    for c in ("pos", "neg"))
        x, p = (table.column(c).to_numpy()[starts][:, None] for c in ("x", "score"))
        n, width = pos + neg, pos.shape[1]
        total, hits = n.sum(axis=0), pos.sum(axis=0)
        fit = NewtonCell(width, (hits > 0) & (hits < total))
        for _ in range(max_iter):
            if fit.done.all():
                break
            a0, a1, b1, live = fit.candidates()
            at = np.flatnonzero(live)
            found = np.zeros((SUMS, width))
            step = max(1, CELLS_PER_CHUNK // max(1, len(at)))
            for lo in range(0, len(x), step):
                here = slice(lo, lo + step)
                found[:, at] += newton_parts(x[here], n[here][:, at], pos[here][:, at], a0[at], a1[at], b1[at])
            fit.step(found)
        flat = flat_logits(total, (n * x).sum(axis=0), (n * x * x).sum(axis=0))
        with np.errstate(divide="ignore", invalid="ignore"):
            brier = (pos * (1 - p) ** 2 + neg * p ** 2).sum(axis=0) / total
        part = table.column("_part")[0].as_py()
        values = (np.where(fit.settled[0], fit.at[0], np.nan), np.where(fit.settled[1] & ~flat, fit.at[2], np.nan), brier)
        return pa.table([pa.array(np.arange(width) + part * REPLICATES - 1), *[
            pa.array([table.column(k)[0].as_py()] * width, table.schema.field(k).type) for k in keys], *[
            pa.array(v, mask=np.isnan(v)) for v in values]], names=["rep", *keys, "intercept", "slope", "brier"])

    return run


def carried_fits(hist: DataFrame, draws: Draws, entity: str, keys: list[str]) -> DataFrame:
    """`summed_fits` with rows that carry their entity's weights, for probabilities that hardly repeat.

    A Newton step serves all replicates of a pass: tasks add up nine sums per replicate from matrices rows x
    replicates, and only these reach the driver, which keeps a few numbers per cell and replicate. Settled
    replicates are not computed again.
    """
    n, x = F.col("pos") + F.col("neg"), logit(F.col("score"))
    squares = F.col("pos") * F.pow(1 - F.col("score"), 2) + F.col("neg") * F.pow("score", 2)
    hist = hist.select(*keys, entity, "pos", n.alias("n"), x.alias("x"), (n * x).alias("nx"), (n * x * x).alias("nxx"),
                       squares.alias("sq"))
    parts = None
    for first in range(0, draws.n_boot, SUMS_PER_PASS):
        block = draws.part(first, SUMS_PER_PASS)
        weighted = pinned(with_weights(hist, block, entity).select(*keys, "x", "n", "pos", "nx", "nxx", "sq", "w"))
        values = replicate_fits(weighted, keys, first)
        parts = values if parts is None else parts.unionByName(values)
    return parts


def replicate_fits(weighted: DataFrame, keys: list[str], first: int, max_iter: int = 25) -> DataFrame:
    """(rep, keys, intercept, slope, brier) of the replicates in the rows' weights; NULL where undefined or not
    converged. The observed sample comes with the first pass only."""
    import pandas as pd

    sums = array_sums(weighted, keys, ["n", "pos", "nx", "nxx", "sq"]).toPandas()
    cells = {tuple(None if pd.isna(k) else k for k in key): part.sort_values("place")
             for key, part in sums.groupby(keys, dropna=False)}
    fits, flats = {}, {}
    for key, part in cells.items():
        flats[key] = flat_logits(*(part[c].to_numpy() for c in ("n", "nx", "nxx")))
        fits[key] = NewtonCell(len(part), ((part["pos"] > 0) & (part["pos"] < part["n"])).to_numpy())
    for _ in range(max_iter):
        state = {key: fit.candidates() for key, fit in fits.items() if not fit.done.all()}
        if not state:
            break
        for key, found in newton_sums(weighted, keys, state).items():
            fits[key].step(found)
    out = []
    for key, part in cells.items():
        fit, rep = fits[key], np.arange(len(part)) - 1
        rep[1:] += first
        columns = {"rep": rep} | {k: [v] * len(part) for k, v in zip(keys, key)} | {
            "intercept": np.where(fit.settled[0], fit.at[0], np.nan),
            "slope": np.where(fit.settled[1] & ~flats[key], fit.at[2], np.nan),
            "brier": (part["sq"] / part["n"]).to_numpy()}
        out.append(pd.DataFrame(columns).iloc[1 if first else 0:])
    schema = "rep long, " + key_schema(weighted, keys) + "intercept double, slope double, brier double"
    if not out:
        return weighted.sparkSession.createDataFrame([], schema)
    values = weighted.sparkSession.createDataFrame(pd.concat(out), schema)
    defined = {c: F.when(~F.isnan(c), F.col(c)) for c in ("intercept", "slope", "brier")}
    return values.withColumns(defined)
