"""Statistics of all replicates at once from matrices rows x replicates inside the tasks.

Rows carry the replicate weights of their entity as one array `w`. A task reads its rows in order, turns a chunk of
them into a matrix and hands on a few rows: one carry per range for ranks, one list of sums per cell for a Newton
step, one state per cell for a statistic of the caller. No row is repeated per replicate. There is always a key: a
caller without one adds a constant (`keyed`).
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Matrix cells (rows x replicates) one task holds at a time.
CELLS_PER_CHUNK = 2_000_000
#: Bytes of carry rows that a broadcast may hold.
BROADCAST_CARRY = 64_000_000
#: Pieces of a cell that one call adds up; more are added in two rounds.
PIECES = 64


@dataclass
class Chunk:
    """Neighbouring rows of one cell: its key, the columns asked for and the weights."""

    key: tuple
    columns: dict[str, np.ndarray]
    weights: np.ndarray


def chunks(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[Chunk]:
    """Rows of one cell at a time, in order, as many as a matrix may hold."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = {c: batch.column(batch.schema.get_field_index(c)) for c in {*keys, *columns, "w"}}
        weights = col["w"].flatten().to_numpy().reshape(n, -1)
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            codes = col[k].dictionary_encode("encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        values = {c: col[c].to_numpy(zero_copy_only=False) for c in columns}
        starts = np.flatnonzero(new)
        step = max(1, CELLS_PER_CHUNK // weights.shape[1])
        for a, b in zip(starts, [*starts[1:], n]):
            key = tuple(col[k][int(a)].as_py() for k in keys)
            for lo in range(a, b, step):
                at = slice(lo, min(b, lo + step))
                yield Chunk(key, {c: v[at] for c, v in values.items()}, weights[at])


def keyed(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, by) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def key_schema(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def record(types: list, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def key_types(df: DataFrame, keys: list[str]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(df.schema[k].dataType) for k in keys]


# ---- ranks under every replicate: bins of equal mass ------------------------------------------------

RANGE, FIRST = "_range", "_first"


def tag_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the partition's number and a mark on the first row that each cell has in it; rows are in cell order."""
    schema = T.StructType([*rows.schema.fields, T.StructField(RANGE, T.IntegerType()), T.StructField(FIRST, T.BooleanType())])

    def run(batches):
        from pyspark import TaskContext

        last, here = None, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.zeros(batch.num_rows, bool)
            tuples = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys])) \
                or [()] * batch.num_rows
            for i, key in enumerate(tuples):
                if key != last:
                    marks[i], last = True, key
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, here, np.int32)), pa.array(marks)],
                names=[*batch.schema.names, RANGE, FIRST])

    return rows.mapInArrow(run, schema)


class _Edge:
    """What a range knows of one cell: its weight, and the score and weight of its first and last tie."""

    def __init__(self, key: tuple, width: int):
        self.key, self.first, self.last = key, None, None
        self.total, self.tie = np.zeros(width), np.zeros(width)

    def add(self, chunk: Chunk) -> None:
        score = chunk.columns["score"]
        mass = chunk.weights * (chunk.columns["pos"] + chunk.columns["neg"])[:, None]
        if self.first is None:
            self.first = score[0]
        end = score == score[-1]
        if score[-1] != self.last:
            self.last, self.tie = score[-1], np.zeros_like(self.tie)
        self.tie += mass[end].sum(axis=0)
        self.total += mass.sum(axis=0)


def range_carries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, range, base, before, total): replicate weights of the cell's earlier ranges, of all rows below the
    range's first score (a tie may have begun earlier), and of the whole cell. One row per cell and range."""
    head, types = key_schema(rows, keys), key_types(rows, keys)

    def edges(batches):
        now = here = None

        def out():
            return record([*types, pa.int32(), pa.float64(), pa.float64(), *[pa.list_(pa.float64())] * 2],
                          [*keys, RANGE, "first", "last", "mass", "tie"],
                          [(*now.key, int(here), float(now.first), float(now.last), now.total, now.tie)])

        for chunk in chunks(batches, [*keys, RANGE], ["score", "pos", "neg"]):
            if now is None or (*now.key, here) != chunk.key:
                if now is not None:
                    yield out()
                now, here = _Edge(chunk.key[:-1], chunk.weights.shape[1]), chunk.key[-1]
            now.add(chunk)
        if now is not None:
            yield out()

    pieces = rows.mapInArrow(edges, f"{head}{RANGE} int, first double, last double, mass array<double>, tie array<double>")

    def carried(table: pa.Table) -> pa.Table:
        table = table.sort_by(RANGE)
        n = table.num_rows
        mass = table.column("mass").combine_chunks().flatten().to_numpy().reshape(n, -1)
        tie = table.column("tie").combine_chunks().flatten().to_numpy().reshape(n, -1)
        first, last = table.column("first").to_numpy(), table.column("last").to_numpy()
        base = np.cumsum(mass, axis=0) - mass
        before = base.copy()
        for j in range(n):
            i = j - 1
            while i >= 0 and last[i] == first[j]:  # earlier parts of the tie
                before[j] -= tie[i]
                i -= 1
        lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (base, before, np.tile(mass.sum(axis=0), (n, 1)))]
        return pa.table([table.column(k) for k in keys] + [table.column(RANGE), *lists],
                        names=[*keys, RANGE, "base", "before", "total"])

    schema = f"{head}{RANGE} int, base array<double>, before array<double>, total array<double>"
    return pieces.groupBy(*keys).applyInArrow(carried, schema)


def mass_bin_sums(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, place, bin, n, pos, sp): sums in bins of equal mass that every replicate cuts for itself.

    `rows` holds (keys, score, pos, neg, w, base, before, total) in order of keys and score, the last three on the
    first row of each cell only. Tied scores share the bin of their first rank.
    """
    head, types = key_schema(rows, keys), key_types(rows, keys)

    def run(batches):
        key, acc = None, None
        base = total = seen = start = tie = None

        def results():
            bins, places = np.nonzero(acc[0])
            arrays = [pa.array([v] * len(bins), t) for v, t in zip(key, types)]
            arrays += [pa.array(places.astype(np.int32)), pa.array(bins.astype(np.int32))]
            arrays += [pa.array(a[bins, places]) for a in acc]
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, "place", "bin", "n", "pos", "sp"])

        for chunk in chunks(batches, keys, ["score", "pos", "neg", "base", "before", "total"]):
            width = chunk.weights.shape[1]
            if chunk.key != key or acc is None:
                if acc is not None:
                    yield results()
                key, acc = chunk.key, np.zeros((3, k, width))
                base, before, total = (np.asarray(chunk.columns[c][0], float) for c in ("base", "before", "total"))
                seen, start, tie = np.zeros(width), before, chunk.columns["score"][0]
            score = chunk.columns["score"]
            begins = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
            pos = np.add.reduceat(chunk.weights * chunk.columns["pos"][:, None], begins, axis=0)
            mass = pos + np.add.reduceat(chunk.weights * chunk.columns["neg"][:, None], begins, axis=0)
            at = score[begins]
            below = base + seen + np.cumsum(mass, axis=0) - mass
            if at[0] == tie:
                below[0] = start
            tie, start = at[-1], below[-1].copy()
            seen = seen + mass.sum(axis=0)
            place = np.ceil(k * (below + 1) / np.maximum(total, 1)) - 1
            flat = (np.clip(place, 0, k - 1) * width + np.arange(width)).astype(np.int64).ravel()
            for part, values in zip(acc, (mass, pos, mass * at[:, None])):
                part += np.bincount(flat, values.ravel(), k * width).reshape(k, width)
        if acc is not None:
            yield results()

    return rows.mapInArrow(run, f"{head}place int, bin int, n double, pos double, sp double") \
        .groupBy(*keys, "place", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "pos", "sp")])


def with_carries(rows: DataFrame, carries: DataFrame, keys: list[str], width: int) -> tuple[DataFrame, bool]:
    """Puts each carry on the first row of its cell and range; whether the rows kept their places."""
    small = carries.count() * width * 24 <= BROADCAST_CARRY
    right = carries.withColumnsRenamed({c: f"_c{c}" for c in (*keys, RANGE)})
    match: Column = F.col(FIRST) & (F.col(RANGE) == F.col(f"_c{RANGE}"))
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_c{key}"))
    joined = rows.join(F.broadcast(right) if small else right, match, "left")
    return joined.drop(*[f"_c{c}" for c in (*keys, RANGE)]), small


# ---- logistic fits of every replicate ---------------------------------------------------------------

#: Sums of one Newton pass: the offset fit's, then those of intercept and slope.
SUMS = 9


def newton_parts(x: np.ndarray, n: np.ndarray, pos: np.ndarray, a0: np.ndarray, a1: np.ndarray, b1: np.ndarray) -> list[np.ndarray]:
    """The sums of rows with logits x (a column) and counts n and pos (rows x replicates) at the given candidates."""
    found = []
    for eta in (a0 + x, a1 + b1 * x):
        e = np.exp(-np.abs(eta))
        mu = np.where(eta >= 0, 1.0, e) / (1.0 + e)
        r, c = pos - n * mu, n * mu * (1 - mu)
        found += [(pos * eta - n * (np.maximum(eta, 0) + np.log1p(e))).sum(axis=0), r.sum(axis=0), c.sum(axis=0)]
    return found + [(r * x).sum(axis=0), (c * x).sum(axis=0), (c * x * x).sum(axis=0)]


def newton_sums(rows: DataFrame, keys: list[str], state: dict[tuple, np.ndarray]) -> dict[tuple, np.ndarray]:
    """Per cell a matrix SUMS x replicates: likelihood, gradient and curvature at the candidates of `state`.

    state[key] holds rows offset a, full a, full b and a mask of replicates still at work; settled ones are not
    computed. Tasks add up their rows, pieces are added per cell, and one small matrix per cell reaches the driver.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(state)
    head, types = key_schema(rows, keys), key_types(rows, keys)

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for chunk in chunks(batches, keys, ["x", "n", "pos"]):
            if chunk.key not in shared.value:
                continue
            a0, a1, b1, live = shared.value[chunk.key]
            at = np.flatnonzero(live)
            if not len(at):
                continue
            w, x = chunk.weights[:, at].astype(float), chunk.columns["x"][:, None]
            n, pos = w * chunk.columns["n"][:, None], w * chunk.columns["pos"][:, None]
            found = newton_parts(x, n, pos, a0[at], a1[at], b1[at])
            total = sums.setdefault(chunk.key, np.zeros((SUMS, chunk.weights.shape[1])))
            total[:, at] += found
        for key, total in sums.items():
            yield record([*types, pa.list_(pa.float64())], [*keys, "v"], [(*key, total.ravel())])

    def added(table: pa.Table) -> pa.Table:
        lists = table.column("v").combine_chunks()
        total = lists.flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
        return pa.table([table.column(k).slice(0, 1) for k in keys] + [pa.array([total], pa.list_(pa.float64()))],
                        names=[*keys, "v"])

    pieces = rows.mapInArrow(run, f"{head}v array<double>")
    out = combined(pieces, keys, added).toArrow()
    shared.unpersist()
    columns = [out.column(k).to_pylist() for k in keys]
    values = out.column("v").to_pylist()
    return {tuple(c[i] for c in columns): np.array(v).reshape(SUMS, -1) for i, v in enumerate(values)}


def combined(pieces: DataFrame, keys: list[str], merge: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """One row per cell out of one per cell and task; a first round over groups of tasks where there are many."""
    if pieces.sparkSession.sparkContext.defaultParallelism > PIECES:
        pieces = pieces.groupBy(*keys, F.spark_partition_id() % PIECES).applyInArrow(merge, pieces.schema)
    return pieces.groupBy(*keys).applyInArrow(merge, pieces.schema)


class NewtonCell:
    """Damped Newton of both fits of one cell, for all replicates at once."""

    def __init__(self, width: int, sound: np.ndarray):
        self.at = np.zeros((3, width))  # offset a, full a, full b
        self.move = np.zeros((3, width))
        self.at[2] = 0.0
        self.like = np.full((2, width), -np.inf)
        self.done = np.tile(~sound, (2, 1))
        self.settled = np.zeros((2, width), bool)

    def candidates(self) -> np.ndarray:
        return np.concatenate([self.at + self.move, ~self.done.all(axis=0)[None]])

    def step(self, sums: np.ndarray, tol: float = 1e-8) -> None:
        """A candidate that gained is taken and gives the next move; otherwise the move is halved."""
        l0, g, h, l1, g0, h00, g1, h01, h11 = sums
        with np.errstate(divide="ignore", invalid="ignore"):
            det = h00 * h11 - h01 * h01
            moves = [np.where(h != 0, g / h, 0.0), np.where(det != 0, (h11 * g0 - h01 * g1) / det, 0.0),
                     np.where(det != 0, (h00 * g1 - h01 * g0) / det, 0.0)]
        for fit, (like, parts) in enumerate(((l0, (0,)), (l1, (1, 2)))):
            live = ~self.done[fit]
            # Near the optimum the likelihood only moves by rounding, which is not a loss.
            better = live & (like >= self.like[fit] - 1e-10 * np.abs(like))
            small = np.ones_like(live)
            for p in parts:
                self.at[p] = np.where(better, self.at[p] + self.move[p], self.at[p])
                self.move[p] = np.where(better, moves[p], np.where(live, self.move[p] / 2, 0.0))
                small &= np.abs(self.move[p]) < tol
            self.like[fit] = np.where(better, like, self.like[fit])
            self.settled[fit] |= better & small
            self.done[fit] |= better & small
            for p in parts:
                self.move[p] = np.where(self.done[fit], 0.0, self.move[p])


# ---- statistics of the caller -----------------------------------------------------------------------

@dataclass(frozen=True)
class Mergeable:
    """A statistic in plain Python that never sees a whole replicate at once.

    zero(width)               the state of no rows, for `width` replicates
    add(state, rows, weights) takes some rows (a dict of arrays) and their weights, rows x replicates
    merge(a, b)               joins the states of two lots of rows
    finish(state)             one value per replicate; NaN where it is undefined
    """

    zero: Callable[[int], Any]
    add: Callable[[Any, dict[str, np.ndarray], np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], np.ndarray]


def merged_values(rows: DataFrame, keys: list[str], columns: list[str], statistic: Mergeable) -> DataFrame:
    """(keys, place, value) of a mergeable statistic over rows with weights `w`.

    A task keeps one state per cell and hands it on pickled; states of a cell are merged in rounds.
    """
    head, types = key_schema(rows, keys), key_types(rows, keys)

    def run(batches):
        states: dict[tuple, Any] = {}
        for chunk in chunks(batches, keys, columns):
            state = states.get(chunk.key)
            if state is None:
                state = statistic.zero(chunk.weights.shape[1])
            states[chunk.key] = statistic.add(state, chunk.columns, chunk.weights)
        for key, state in states.items():
            yield record([*types, pa.binary()], [*keys, "state"], [(*key, pickle.dumps(state))])

    def merged(table: pa.Table) -> pa.Table:
        states = (pickle.loads(s.as_py()) for s in itertools.chain.from_iterable(table.column("state").chunks))
        whole = next(states)
        for other in states:
            whole = statistic.merge(whole, other)
        return pa.table([table.column(k).slice(0, 1) for k in keys] + [pa.array([pickle.dumps(whole)], pa.binary())],
                        names=[*keys, "state"])

    def finished(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                values = np.asarray(statistic.finish(pickle.loads(batch.column("state")[i].as_py())), float)
                arrays = [pa.array([batch.column(k)[i].as_py()] * len(values), t) for k, t in zip(keys, types)]
                arrays += [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values, mask=np.isnan(values))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "place", "value"])

    pieces = combined(rows.mapInArrow(run, f"{head}state binary"), keys, merged)
    return pieces.mapInArrow(finished, f"{head}place int, value double")
