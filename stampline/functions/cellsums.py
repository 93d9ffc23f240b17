"""Ranked-pair statistics of all replicates from sums per cell and score, where distinct scores are few.

Scores of pooled or rounded predictions repeat: a table of any length has a bounded number of (cell, score). Then rows
need not carry replicate weights. They are put in entity order once, a task draws the weights of its own entities in
place, and a matrix product (cell and score x entities) times (entities x replicates) adds them up. What is shuffled are
the tasks' sums, whose size follows the scores and replicates but not the rows. Where the sums of all cells are more than
a task may hold, the cells are dealt into bands and rows go by band first, so no task reads them once per few replicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most (cell, score) pairs for which sums are kept; their table is broadcast.
MOST_CELLS = 250_000
#: Sums one task holds at a time (8 bytes each), and sums all tasks of a statistic may hand on.
SUMS_PER_TASK, SUMS_HANDED_ON = 16_000_000, 1_000_000_000
#: Entities of one matrix product, and replicates one handed-on row holds.
ENTITIES, REPLICATES = 128, 128

#: Given the sorted places of entities, their counts in each replicate: entities x replicates.
Counts = Callable[[np.ndarray], np.ndarray]


def fits(n_cells: int, n_boot: int) -> bool:
    return n_cells <= MOST_CELLS and 2 * n_cells * n_boot <= SUMS_HANDED_ON


def replicates_per_pass(n_cells: int, least: int) -> int:
    """Replicates whose sums of all cells a task may hold, or `least` where these are fewer."""
    return max(least, min(SUMS_PER_TASK // max(1, 2 * n_cells) - 1, SUMS_PER_TASK // (8 * ENTITIES)))


def bands_for(n_cells: int, n: int) -> int:
    """Bands of cells so that a task may hold the sums of one of them for n replicates."""
    return max(1, min(n_cells, -(-2 * n_cells * (n + 1) // SUMS_PER_TASK)))


def tasks_for(n_cells: int, n_boot: int, bands: int, cores: int) -> int:
    return int(max(bands, min(2 * cores, bands * SUMS_HANDED_ON // max(1, 2 * n_cells * n_boot))))


def even_passes(n_boot: int, most: int) -> list[tuple[int, int]]:
    """(first, n) of even passes of at most `most` replicates."""
    step = max(1, -(-n_boot // max(1, -(-n_boot // most))))
    return [(first, min(step, n_boot - first)) for first in range(0, n_boot, step)]


def _block_sums(sums: np.ndarray, cell: np.ndarray, entity: np.ndarray, pos: np.ndarray, neg: np.ndarray,
                weights: np.ndarray) -> None:
    """Adds rows of a few entities to `sums`, whose rows are 2 * cell for positives and 2 * cell + 1 for negatives."""
    p, n = np.flatnonzero(pos), np.flatnonzero(neg)
    ids, at = np.unique(np.concatenate([2 * cell[p], 2 * cell[n] + 1]), return_inverse=True)
    value = np.concatenate([pos[p], neg[n]])
    # Whole numbers below 2^24 add up exactly in single precision.
    exact = not len(value) or value.sum() * weights.max() < 1 << 24
    kind = np.float32 if exact else np.float64
    table = np.zeros((len(ids), len(weights)), kind)
    np.add.at(table, (at, np.concatenate([entity[p], entity[n]])), value.astype(kind))
    sums[ids] += table @ weights.astype(kind)


def cell_sums(placed: DataFrame, counts_of: Callable[[int, int], Counts], first: int, n: int, n_cells: int,
              bands: int) -> DataFrame:
    """(_id, _part, pos, neg): sums over a task's rows for the observed sample and n replicates, REPLICATES to a part.

    `placed` is (_id, _band, _place, pos, neg) in order of band and place; a cell's band is its number modulo `bands`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(first, n)
        band, sums = None, None

        def found():
            seen = np.flatnonzero(sums[0::2, 0] + sums[1::2, 0])
            for lo in range(0, len(seen), 1024):
                at = seen[lo:lo + 1024]
                for part, begin in enumerate(range(0, n + 1, REPLICATES)):
                    width = min(REPLICATES, n + 1 - begin)
                    bounds = pa.array(np.arange(len(at) + 1, dtype=np.int32) * width)
                    lists = [pa.ListArray.from_arrays(bounds, pa.array(sums[2 * at + k, begin:begin + width].ravel()))
                             for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at * bands + band), pa.array(np.full(len(at), part, np.int32)), *lists],
                        names=["_id", "_part", "pos", "neg"])

        for batch in batches:
            bands_here, cells, pos, neg = (batch.column(c).to_numpy() for c in ("_band", "_id", "pos", "neg"))
            place = batch.column("_place").to_numpy(zero_copy_only=False)
            if not len(place):
                continue
            new = np.append(True, (place[1:] != place[:-1]) | (bands_here[1:] != bands_here[:-1]))
            starts, number = np.flatnonzero(new), np.cumsum(new) - 1
            ends, of = np.append(starts, len(place)), bands_here[starts]
            edges = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            for begin, end in zip(edges, [*edges[1:], len(starts)]):
                if of[begin] != band:
                    if band is not None:
                        yield from found()
                    band, sums = int(of[begin]), np.zeros((2 * -(-n_cells // bands), n + 1))
                for lo in range(begin, end, ENTITIES):
                    hi = min(lo + ENTITIES, end)
                    rows = slice(ends[lo], ends[hi])
                    weights = np.ones((hi - lo, n + 1), np.int64)
                    weights[:, 1:] = counts(place[starts[lo:hi]])
                    _block_sums(sums, cells[rows] // bands, number[rows] - lo, pos[rows], neg[rows], weights)
        if band is not None:
            yield from found()

    return placed.mapInArrow(run, "_id long, _part int, pos array<double>, neg array<double>")


def won_pairs(rows: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    """(_part, keys, wins, pairs): per task and cell the ordered pairs won and all pairs, added over the groups.

    `rows` is (_part, groups, score, pos, neg) with whole groups in a task, sorted by _part, groups and score.
    """
    fields = {f.name: f for f in rows.schema.fields}
    arrays = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField("_part", T.IntegerType())] + [fields[k] for k in keys]
                          + [T.StructField(c, arrays) for c in ("wins", "pairs")])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    marks = ["_part", *groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, wins, pairs = None, None, None
        group = score = None
        below = above = tie_pos = tie_neg = won = None

        def end_tie():
            nonlocal below, above, won
            won += tie_pos * (below + 0.5 * tie_neg)
            below += tie_neg
            above += tie_pos

        def end_group():
            nonlocal wins, pairs
            end_tie()
            wins += won
            pairs += above * below

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([v], type=f.type) for v, f in zip([*cell, wins.tolist(), pairs.tolist()], arrow)], schema=arrow)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in [*marks, "score", "pos", "neg"]}
            new = np.zeros(n, bool)
            new[0] = True
            for m in marks:
                codes = col[m].dictionary_encode("encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            scores = col["score"].to_numpy()
            begins = {c: col[c].offsets.to_numpy() for c in ("pos", "neg")}
            flat = {c: col[c].values.to_numpy() for c in ("pos", "neg")}
            for i in range(n):
                p, q = (flat[c][begins[c][i]:begins[c][i + 1]] for c in ("pos", "neg"))
                if new[i]:
                    key = tuple(col[m][i].as_py() for m in marks)
                    if key != group:
                        if group is not None:
                            end_group()
                        group, score = key, None
                        below, above, won = np.zeros(len(p)), np.zeros(len(p)), np.zeros(len(p))
                        tie_pos, tie_neg = np.zeros(len(p)), np.zeros(len(p))
                        if cell != key[:1 + len(keys)]:
                            if cell is not None:
                                yield row()
                            cell, wins, pairs = key[:1 + len(keys)], np.zeros(len(p)), np.zeros(len(p))
                if score is None or scores[i] != score:
                    end_tie()
                    score, tie_pos, tie_neg = scores[i], np.zeros(len(p)), np.zeros(len(p))
                tie_pos += p
                tie_neg += q
        if group is not None:
            end_group()
            yield row()

    return rows.mapInArrow(run, schema)


def replicate_shares(placed: DataFrame, cells: DataFrame, counts_of: Callable[[int, int], Counts], first: int, n: int,
                     n_cells: int, bands: int, keys: list[str], stratum: str | None = None) -> DataFrame:
    """(rep, keys, value): share of ordered pairs won on the observed sample and on n replicates; NULL without a pair.

    `cells` is the bounded table (_id, keys, stratum, score).
    """
    groups = [*keys, *([stratum] if stratum else [])]
    cores = placed.sparkSession.sparkContext.defaultParallelism
    rows = cell_sums(placed, counts_of, first, n, n_cells, bands).join(F.broadcast(cells), "_id") \
        .select("_part", *groups, F.col("score").cast("double").alias("score"), "pos", "neg") \
        .repartition(cores, "_part", *groups).sortWithinPartitions("_part", *groups, "score")
    long = won_pairs(rows, keys, groups).select(
        "_part", *keys, F.posexplode(F.arrays_zip("wins", "pairs")).alias("_i", "_z")).groupBy(
        (F.col("_part") * REPLICATES + F.col("_i") - 1).alias("rep"), *keys).agg(
        F.sum("_z.wins").alias("_won"), F.sum("_z.pairs").alias("_pairs"))
    rep = F.when(F.col("rep") >= 0, F.col("rep") + first).otherwise(F.col("rep")).cast("int").alias("rep")
    return long.select(rep, *keys, F.when(F.col("_pairs") > 0, F.col("_won") / F.col("_pairs")).alias("value"))
