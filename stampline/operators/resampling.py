"""Entity-clustered resampling: replicate weights, intervals and p-values.

A replicate draws whole entities with replacement. The draw is a weight per (replicate,
entity), derived from a hash, so every cell that shares an entity sees the same draw and a
retried task sees the same numbers.

mode='multinomial'  exactly G of G entities per replicate, by binomial splitting over a dense entity index.
mode='poisson'      independent Poisson(1) weights; one narrow pass, no index, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stampline.functions.cellsums import Counts, bands_for, even_passes, replicates_per_pass, tasks_for
from stampline.functions.expr import poisson1, poisson1_cuts, uniform
from stampline.functions.matrices import Mergeable, keyed, merged_values
from stampline.functions.splitting import Tree, replicate_keys
from stampline.session import pinned

#: Replicate number that stands for the observed sample, every entity once.
OBSERVED = -1
#: Largest entities x replicates product whose draws are broadcast (two bytes each).
BROADCAST_DRAWS = 50_000_000
#: Most entities whose places are broadcast to the rows of a histogram; beyond, both are shuffled by entity.
BROADCAST_PLACES = 1_000_000
#: Replicates one pass over the histogram carries, which bounds a task's matrix.
REPLICATES_PER_PASS = 1000
#: Entities so few that each task draws for all of them and has cells of its own.
FEW_ENTITIES = 4096


def dense_index(entities: DataFrame, entity: str) -> DataFrame:
    """Number distinct entities 0..G-1 in key order without a single-task window."""
    ranged = pinned(
        entities.select(entity).where(F.col(entity).isNotNull()).distinct()
        .repartitionByRange(entity).withColumn("_range", F.spark_partition_id())
    )
    across = Window.partitionBy(F.lit(0)).orderBy("_range") \
        .rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: bounded by the number of shuffle partitions.
    offsets = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_offset", F.coalesce(F.sum("_n").over(across), F.lit(0)))
    inside = Window.partitionBy("_range").orderBy(entity)
    return (
        ranged.withColumn("_place", F.row_number().over(inside))
        .join(F.broadcast(offsets.select("_range", "_offset")), "_range")
        .select(entity, (F.col("_offset") + F.col("_place") - 1).cast("bigint").alias("idx"))
    )


@dataclass(frozen=True)
class Draws:
    """Replicate weights of entities: `weights(first, n)` is a frame (entity, w) for n replicates.

    w[0] is the observed sample (always 1), w[b + 1] is replicate first + b. Weights are made where they are
    asked for, so a pass over some replicates never computes or moves the others. `index` is (entity, _place), and
    `counts(first, n)` makes a function that draws inside a task, from the sorted places of its entities.
    """

    weights: Callable[[int, int], DataFrame]
    n_entities: int
    n_boot: int
    index: DataFrame
    counts: Callable[[int, int], Counts]
    first: int = 0

    @property
    def table(self) -> DataFrame:
        return self.weights(self.first, self.n_boot)

    @property
    def small(self) -> bool:
        """Counted, and fit for a broadcast."""
        return self.n_entities * self.n_boot <= BROADCAST_DRAWS

    def part(self, first: int, n: int) -> Draws:
        """The draws of n replicates from `first` on."""
        return Draws(self.weights, self.n_entities, min(n, self.n_boot - first), self.index, self.counts, first)


def poisson_weights(index: DataFrame, entity: str, seed: int) -> Callable[[int, int], DataFrame]:
    """One draw per replicate, in place: no row per replicate and no shuffle."""
    def weights(first: int, n: int) -> DataFrame:
        reps = F.sequence(F.lit(first), F.lit(first + n - 1))
        draws = F.transform(reps, lambda b: uniform(F.lit(seed), b, F.col(entity)))
        return index.select(entity, F.concat(F.array(F.lit(1).cast("smallint")),
                                             F.transform(draws, lambda u: poisson1(u).cast("smallint"))).alias("w"))

    return weights


def poisson_counts(seed: int) -> Callable[[int, int], Counts]:
    """The draws of `poisson_weights` inside a task; a place is the entity's text."""
    def of(first: int, n: int) -> Counts:
        heads = [f"{seed}|{b}|".encode() for b in range(first, first + n)]
        cuts = np.array(poisson1_cuts())

        def counts(places: np.ndarray) -> np.ndarray:
            tails = [str(p).encode() for p in places]
            digests = b"".join(md5(head + tail).digest()[:4] for tail in tails for head in heads)
            u = np.frombuffer(digests, ">u4") / 4294967296.0
            return np.searchsorted(cuts, u, "right").reshape(len(places), n)

        return counts

    return of


def multinomial_counts(size: int, seed: int) -> Callable[[int, int], Counts]:
    """The draws of `multinomial_weights` inside a task; a place is the dense index."""
    def of(first: int, n: int) -> Counts:
        tree = Tree(size, replicate_keys(seed, first, n))

        def counts(places: np.ndarray) -> np.ndarray:
            cuts = np.flatnonzero(np.append(True, np.diff(places) != 1))
            return np.concatenate([tree.counts(int(places[a]), int(places[b - 1]) + 1)
                                   for a, b in zip(cuts, [*cuts[1:], len(places)])])

        return counts

    return of


#: Entities whose replicate counts a task holds at once.
ENTITIES_PER_STEP = 512


def multinomial_weights(index: DataFrame, entity: str, size: int, seed: int) -> Callable[[int, int], DataFrame]:
    """G of G entities per replicate by recursive binomial splitting over the index: no row per draw, no shuffle."""
    def weights(first: int, n: int) -> DataFrame:
        def draw(batches):
            tree = Tree(size, replicate_keys(seed, first, n))
            for batch in batches:
                idx = batch.column("idx").to_numpy()
                runs = np.flatnonzero(np.append(True, np.diff(idx) != 1)) if len(idx) else []
                for run, stop in zip(runs, [*runs[1:], len(idx)]):
                    for lo in range(run, stop, ENTITIES_PER_STEP):
                        hi = min(lo + ENTITIES_PER_STEP, stop)
                        dense = np.ones((hi - lo, n + 1), np.int16)
                        dense[:, 1:] = tree.counts(int(idx[lo]), int(idx[hi - 1]) + 1)
                        lists = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * (n + 1), dense.ravel())
                        yield pa.RecordBatch.from_arrays([batch.column(entity)[lo:hi], lists], names=[entity, "w"])

        kind = index.schema[entity].dataType.simpleString()
        return index.select(entity, "idx").mapInArrow(draw, f"`{entity}` {kind}, w array<smallint>")

    return weights


def entity_draws(entities: DataFrame, entity: str, n_boot: int, seed: int = 0,
                 mode: str = "multinomial") -> Draws:
    """Replicate weights of every entity."""
    if mode == "poisson":
        index = entities.select(entity).where(F.col(entity).isNotNull()).distinct()
        return Draws(poisson_weights(index, entity, seed), index.count(), n_boot,
                     index.withColumn("_place", F.col(entity).cast("string")), poisson_counts(seed))
    if mode == "multinomial":
        index = pinned(dense_index(entities, entity))
        size = index.count()
        return Draws(multinomial_weights(index, entity, size, seed), size, n_boot,
                     index.withColumnRenamed("idx", "_place"), multinomial_counts(size, seed))
    raise ValueError(f"mode must be 'multinomial' or 'poisson', not {mode!r}")


def cluster_weights(entities: DataFrame, entity: str, n_boot: int, seed: int = 0,
                    mode: str = "multinomial") -> DataFrame:
    """(rep, entity, w) for rep 0..n_boot-1; entities that were not drawn have no row."""
    draws = entity_draws(entities, entity, n_boot, seed, mode).table
    # The outer form: else a filter on the array is pushed below the distinct entities and draws for every row.
    return draws.select(entity, F.posexplode_outer("w").alias("_i", "w")) \
        .where((F.col("_i") > 0) & (F.col("w") > 0)) \
        .select((F.col("_i") - 1).alias("rep"), entity, F.col("w").cast("bigint").alias("w"))


def with_weights(frame: DataFrame, draws: Draws, entity: str) -> DataFrame:
    """Attach each row's dense weights `w`.

    A counted-small draw table is broadcast, so the rows keep their partitioning. Otherwise one
    small array per entity is joined by key and adaptive execution splits a hot entity.
    """
    return frame.join(F.broadcast(draws.table) if draws.small else draws.table, entity)


def placed_cells(hist: DataFrame, distinct: DataFrame, n_cells: int, draws: Draws, entity: str
                 ) -> tuple[DataFrame, DataFrame, int, list[tuple[int, int]]]:
    """What `cell_sums` reads: rows in order of band and place, the table (_id, cell columns), bands and passes.

    `distinct` is the counted, bounded table of cells: one struct column `_cell` of columns of `hist`.
    """
    cells = pinned(dense_index(distinct, "_cell"))
    cores = hist.sparkSession.sparkContext.defaultParallelism
    passes = even_passes(draws.n_boot, replicates_per_pass(n_cells, REPLICATES_PER_PASS))
    bands = bands_for(n_cells, passes[0][1])
    if draws.n_entities <= FEW_ENTITIES:
        bands = max(bands, min(n_cells, 2 * cores))
    order = ["_band", "_place", "_id"]
    cell = F.struct(*distinct.schema["_cell"].dataType.names).alias("_cell")
    index = F.broadcast(draws.index) if draws.n_entities <= BROADCAST_PLACES else draws.index
    placed = hist.select(cell, entity, "pos", "neg").join(F.broadcast(cells), "_cell").join(index, entity) \
        .select(F.col("idx").alias("_id"), (F.col("idx") % bands).cast("int").alias("_band"), "_place", "pos", "neg") \
        .repartitionByRange(tasks_for(n_cells, draws.n_boot, bands, cores), *order).sortWithinPartitions(*order)
    if len(passes) > 1:  # else read once
        placed = pinned(placed)
    return placed, cells.select(F.col("idx").alias("_id"), "_cell.*"), bands, passes


def with_replicates(frame: DataFrame, draws: Draws, entity: str) -> DataFrame:
    """Repeat each row once per replicate that drew its entity, with the multiplicity `w`.

    For statistics that must see rows; pre-aggregate per entity first. Rows multiply only after
    the join.
    """
    cols = frame.columns
    return (
        with_weights(frame, draws, entity)
        .select(*cols, F.posexplode("w").alias("_i", "w")).where(F.col("w") > 0)
        .select(*cols, (F.col("_i") - 1).alias("rep"), F.col("w").cast("double").alias("w"))
    )


#: Replicates that one pass of sums in matrices carries.
SUMS_PER_PASS = 2500


def array_sums(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, place, values): for each place of the rows' arrays `w`, the sums of w[place] times the values.

    No row per place: a task multiplies its rows' arrays with their values and keeps one small matrix per
    cell. The cells of `by` are declared or few, and all arrays are equally long.
    """
    rows = rows.select(*by, *[F.col(c).cast("double").alias(c) for c in values], "w")
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by]
                       + ["place int"] + [f"`{c}` double" for c in values])

    def sums(batches):
        cells: dict[tuple, np.ndarray] = {}
        kinds = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(c).type for c in by]
            table = pa.Table.from_batches([batch])
            groups = table.select(by).to_pandas().groupby(by, dropna=False, sort=False).indices if by \
                else {(): np.arange(batch.num_rows)}
            keys = table.select(by).to_pylist() if by else None
            weights = batch.column(batch.schema.get_field_index("w")).flatten().to_numpy().reshape(batch.num_rows, -1)
            x = np.stack([table.column(c).to_numpy() for c in values], axis=1)
            for at in groups.values():
                key = tuple(keys[at[0]].values()) if by else ()
                part = weights[at].T.astype(float) @ x[at]
                cells[key] = cells[key] + part if key in cells else part
        for key, total in cells.items():
            columns = [pa.array([k] * len(total), kind) for k, kind in zip(key, kinds)]
            columns.append(pa.array(np.arange(len(total), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays(columns + [pa.array(c) for c in total.T.copy()], names=[*by, "place", *values])

    return rows.mapInArrow(sums, schema).groupBy(*by, "place").agg(*[F.sum(c).alias(c) for c in values])


def replicate_sums(frame: DataFrame, draws: Draws, entity: str, by: list[str], values: list[str]) -> DataFrame:
    """(rep, by, values): weighted sums of columns on every draw; rep -1 is the observed sample."""
    out = None
    for first in range(0, draws.n_boot, SUMS_PER_PASS):
        sums = array_sums(with_weights(frame, draws.part(first, SUMS_PER_PASS), entity), by, values)
        part = sums.select((F.col("place") - 1 + F.when(F.col("place") > 0, first).otherwise(0)).alias("rep"), *by, *values)
        if first:
            part = part.where(F.col("rep") != OBSERVED)
        out = part if out is None else out.unionByName(part)
    return out


def two_sided(value: Column) -> Column:
    """min(1, 2 * smaller tail share); both tails include zero."""
    low = F.avg(F.when(value <= 0, 1.0).when(value.isNotNull(), 0.0))
    high = F.avg(F.when(value >= 0, 1.0).when(value.isNotNull(), 0.0))
    return F.least(F.lit(1.0), 2.0 * F.least(low, high))


def summarise(replicates: DataFrame, by: list[str], n_boot: int, value: str = "value",
              level: float = 0.95) -> DataFrame:
    """Observed value, percentile interval, p-value and how many replicates were defined."""
    drawn = F.when(F.col("rep") >= 0, F.col(value))
    tail = (1.0 - level) / 2.0
    return (
        replicates.groupBy(*by)
        .agg(F.max(F.when(F.col("rep") == OBSERVED, F.col(value))).alias("estimate"),
             F.percentile(drawn, F.array(F.lit(tail), F.lit(1.0 - tail))).alias("_q"),
             two_sided(drawn).alias("p_value"),
             F.count(drawn).alias("n_finite"))
        .select(*by, "estimate", F.col("_q")[0].alias("ci_lo"), F.col("_q")[1].alias("ci_hi"),
                "p_value", F.lit(n_boot).cast("bigint").alias("n_boot"), "n_finite")
    )


def clustered_stat_ci(frame: DataFrame, entity: str,
                      statistic: Callable[[DataFrame, list[str]], DataFrame],
                      by: list[str], n_boot: int, seed: int = 0, mode: str = "multinomial",
                      universe: DataFrame | None = None, level: float = 0.95) -> DataFrame:
    """Interval and p-value for any statistic recomputed on each draw.

    `statistic(rows, keys)` receives the rows with their multiplicity `w` and returns one
    `value` per key; NULL marks an undefined replicate, which is left out and counted. The
    observed sample travels as one more replicate, so one job yields estimate and interval.
    """
    entities = (universe if universe is not None else frame).select(entity)
    draws = entity_draws(entities, entity, n_boot, seed, mode)
    rows = with_replicates(frame, draws, entity)
    values = statistic(rows, ["rep", *by])
    return summarise(values, by, n_boot, level=level) \
        .withColumn("n_groups", F.lit(draws.n_entities).cast("bigint"))


def clustered_callback_ci(frame: DataFrame, entity: str, statistic: Mergeable, columns: list[str], by: list[str],
                          n_boot: int, seed: int = 0, mode: str = "multinomial", universe: DataFrame | None = None,
                          level: float = 0.95) -> DataFrame:
    """Interval and p-value for a caller's statistic in plain Python, on each draw.

    The statistic is given rows of `columns` with their weights, a chunk and many replicates at a time, and merges
    its states; no call sees a whole replicate and no row is repeated per replicate. NaN marks an undefined one.
    """
    frame, keys = keyed(frame.select(*dict.fromkeys([*by, entity, *columns])), by)
    draws = entity_draws((universe if universe is not None else frame).select(entity), entity, n_boot, seed, mode)
    values = None
    for first in range(0, n_boot, SUMS_PER_PASS):
        rows = with_weights(frame, draws.part(first, SUMS_PER_PASS), entity)
        part = merged_values(rows, keys, columns, statistic).select(
            (F.col("place") - 1 + F.when(F.col("place") > 0, first).otherwise(0)).alias("rep"), *keys, "value")
        if first:
            part = part.where(F.col("rep") != OBSERVED)
        values = part if values is None else values.unionByName(part)
    return summarise(values, keys, n_boot, level=level).drop("_all") \
        .withColumn("n_groups", F.lit(draws.n_entities).cast("bigint"))
