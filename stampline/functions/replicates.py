"""Ranked-pair statistics for all replicates at once.

Multiplying rows by the replicates would multiply the shuffle too. Instead every histogram row
carries its entity's replicate weights as one small array, rows are range-partitioned and
sorted by (keys, stratum, score, entity), and each task runs a cumulative sum over a matrix
rows x replicates in NumPy. What leaves a task is a handful of rows:

* `done`  sums over groups that lie wholly inside the task,
* `tie`   the first and last score of the groups at its edges, which a neighbour may share,
* `block` the scores strictly between those two.

Ties with equal score are added up across tasks, pieces are put in score order, and negatives
below each piece are added once per piece. No group has to fit in one task: neither a huge
cell, nor a huge stratum, nor a single score held by a third of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Matrix cells (rows x replicates) one task holds at a time.
CELLS_PER_CHUNK = 2_000_000


class _Run:
    """One group as far as this task sees it: first tie, middle block, last tie."""

    def __init__(self, key: tuple, width: int):
        self.key = key
        self.first = self.last = None  # [score, pos, neg]
        self.block_at = None
        self.wins, self.pos, self.neg = np.zeros(width), np.zeros(width), np.zeros(width)

    def add(self, scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        """Take the next ties in score order."""
        if self.last is not None and scores[0] == self.last[0]:
            self.last[1] += pos[0]
            self.last[2] += neg[0]
            scores, pos, neg = scores[1:], pos[1:], neg[1:]
        if not len(scores):
            return
        if self.last is not None:
            if self.first is None:
                self.first = self.last
            else:
                self._absorb(self.last[:1], self.last[1][None], self.last[2][None])
        if len(scores) > 1:
            start = 0
            if self.first is None:
                self.first = [scores[0], pos[0].copy(), neg[0].copy()]
                start = 1
            self._absorb(scores[start:-1], pos[start:-1], neg[start:-1])
        self.last = [scores[-1], pos[-1].copy(), neg[-1].copy()]

    def _absorb(self, scores, pos, neg) -> None:
        if not len(scores):
            return
        if self.block_at is None:
            self.block_at = scores[0]
        below = np.cumsum(neg, axis=0)
        below += self.neg - 0.5 * neg
        self.wins += np.einsum("ij,ij->j", pos, below)
        self.pos += pos.sum(axis=0)
        self.neg += neg.sum(axis=0)

    def pieces(self) -> Iterator[tuple]:
        """(score, kind, wins, pos, neg) in score order."""
        none = np.zeros_like(self.wins)
        if self.first is not None:
            yield self.first[0], "tie", none, self.first[1], self.first[2]
        if self.block_at is not None:
            yield self.block_at, "block", self.wins, self.pos, self.neg
        yield self.last[0], "tie", none, self.last[1], self.last[2]

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """wins and pairs of a group that no other task shares."""
        wins, pos, neg = np.zeros_like(self.wins), np.zeros_like(self.wins), np.zeros_like(self.wins)
        for _, kind, w, p, n in self.pieces():
            wins += p * neg + (0.5 * p * n if kind == "tie" else w)
            pos, neg = pos + p, neg + n
        return wins, pos * neg


def _tie_sums(weights: np.ndarray, count: np.ndarray, tie_of: np.ndarray, n_ties: int) -> np.ndarray:
    """Replicate weight of one class per tie; most rows hold only one class."""
    out = np.zeros((n_ties, weights.shape[1]))
    rows = np.flatnonzero(count)
    if len(rows):
        part, ids = weights[rows], tie_of[rows]
        if (count[rows] != 1.0).any():
            part = part * count[rows, None]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        out[ids[starts]] = np.add.reduceat(part, starts, axis=0, dtype=np.float64)
    return out


def _piece_rows(batches: Iterator[pa.RecordBatch], groups: list[str], n_keys: int,
                schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    run: _Run | None = None
    leading = True
    cell, cell_wins, cell_pairs = None, None, None
    out: list[tuple] = []

    def flush_cell():
        nonlocal cell
        if cell is not None:
            pad = (None,) * (len(groups) - n_keys)
            zero = np.zeros_like(cell_wins)
            out.append((*cell, *pad, None, "done", cell_wins, zero, zero, cell_pairs))
            cell = None

    def emit(r: _Run):
        for score, kind, wins, pos, neg in r.pieces():
            out.append((*r.key, float(score), kind, wins, pos, neg, np.zeros_like(wins)))

    def close(r: _Run, at_edge: bool):
        nonlocal cell, cell_wins, cell_pairs
        if at_edge:
            emit(r)
            return
        wins, pairs = r.totals()
        if cell != r.key[:n_keys]:
            flush_cell()
            cell, cell_wins, cell_pairs = r.key[:n_keys], wins, pairs
        else:
            cell_wins += wins
            cell_pairs += pairs

    def drain():
        cols = list(zip(*out))
        out.clear()
        arrays = [pa.array([x.tolist() if isinstance(x, np.ndarray) else x for x in c], type=f.type)
                  for c, f in zip(cols, schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        codes = [batch.column(batch.schema.get_field_index(g)).dictionary_encode("encode").indices.to_numpy()
                 for g in groups]
        score = batch.column(batch.schema.get_field_index("score")).to_numpy()
        pos = batch.column(batch.schema.get_field_index("pos")).to_numpy()
        neg = batch.column(batch.schema.get_field_index("neg")).to_numpy()
        flat = batch.column(batch.schema.get_field_index("w")).flatten().to_numpy()
        weights = flat.reshape(n, -1)
        width = weights.shape[1]
        new_group = np.zeros(n, dtype=bool)
        new_group[0] = True
        for c in codes:
            new_group[1:] |= c[1:] != c[:-1]
        new_tie = new_group.copy()
        new_tie[1:] |= score[1:] != score[:-1]
        step = max(1, CELLS_PER_CHUNK // width)
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            first = new_tie[lo:hi].copy()
            first[0] = True
            ties, tie_of = np.flatnonzero(first), np.cumsum(first) - 1
            p = _tie_sums(weights[lo:hi], pos[lo:hi], tie_of, len(ties))
            q = _tie_sums(weights[lo:hi], neg[lo:hi], tie_of, len(ties))
            at = score[lo:hi][ties]
            starts = np.flatnonzero(new_group[lo:hi][ties])
            if not len(starts) or starts[0] != 0:
                starts = np.concatenate([[0], starts])
            for a, b in zip(starts, [*starts[1:], len(ties)]):
                row = lo + int(ties[a])
                key = tuple(batch.column(batch.schema.get_field_index(g))[row].as_py() for g in groups)
                if run is None or run.key != key:
                    if run is not None:
                        close(run, leading)
                        leading = False
                    run = _Run(key, width)
                run.add(at[a:b], p[a:b], q[a:b])
        if len(out) > 64:
            yield drain()
    if run is not None:
        flush_cell()
        emit(run)
    if out:
        yield drain()


def replicate_pairs(hist: DataFrame, keys: list[str], stratum: str | None = None) -> DataFrame:
    """(rep, keys, value): share of ordered pairs won, per replicate; NULL without a pair.

    `hist` is (keys, [stratum], score, pos, neg, w) with the dense weights `w`, partitioned and
    sorted by keys, stratum and score. Replicate numbers are array positions minus one.
    """
    groups = [*keys, *([stratum] if stratum else [])]
    fields = {f.name: f for f in hist.schema.fields}
    arrays = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [T.StructField(g, fields[g].dataType, True) for g in groups]
        + [T.StructField("score", T.DoubleType()), T.StructField("kind", T.StringType())]
        + [T.StructField(c, arrays) for c in ("wins", "pos", "neg", "pairs")])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(schema)
    n_keys = len(keys)

    def kernel(batches):
        yield from _piece_rows(batches, groups, n_keys, arrow_schema)

    pieces = hist.select(*groups, F.col("score").cast("double").alias("score"), "pos", "neg", "w") \
        .mapInArrow(kernel, schema)
    long = pieces.select(*groups, "score", "kind", F.posexplode(F.arrays_zip("wins", "pos", "neg", "pairs")).alias("_i", "_z")) \
        .select((F.col("_i") - 1).alias("rep"), *groups, "score", "kind", "_z.*")
    edge = long.groupBy("rep", *groups, "score", "kind").agg(
        *[F.sum(c).alias(c) for c in ("wins", "pos", "neg", "pairs")])
    local = F.when(F.col("kind") == "tie", 0.5 * F.col("pos") * F.col("neg")).otherwise(F.col("wins"))
    # At most four pieces per task and group, so this window is small.
    w = Window.partitionBy("rep", *groups).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(w), F.lit(0.0))
    per_group = edge.withColumn("_won", local + F.col("pos") * below).groupBy("rep", *groups).agg(
        F.sum("_won").alias("_won"), (F.sum("pos") * F.sum("neg") + F.sum("pairs")).alias("_pairs"))
    total = per_group.groupBy("rep", *keys).agg(F.sum("_won").alias("_won"), F.sum("_pairs").alias("_pairs")) \
        if stratum else per_group
    return total.select("rep", *keys, F.when(F.col("_pairs") > 0, F.col("_won") / F.col("_pairs")).alias("value"))
