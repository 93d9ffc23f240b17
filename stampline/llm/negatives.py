"""Hard negatives: per anchor the highest-scoring rows of other labels inside a band below each of its positives.

Vectors are quantised to integers and packed in blocks; each block stores the mean and the deviation (length of the
centred part) of every finest segment of its vectors. Of a segment of length L, mean products times L plus or minus
deviation products bound the inner product; sums over segments bound the score. Coarser segments follow from finer
ones. Bounds run from the coarsest level to the finest on the pairs that are left: a pair goes when its upper bound
is below what the anchor still needs (its fifth best so far, the least score of its bands) or its lower bound is
above all its bands. Survivors are scored exactly, as integers in floats wide enough, or as 64-bit integers.

Work is a grid of row parts and anchor groups: rows go to the task of their part once per anchor group, anchors once
per row part, both in packed blocks of bounded size; a task holds one anchor group and streams row blocks, keeping
five results per anchor and band. Labels play no part in the partitioning, so a hot label is no hot task.

Defined results: rows with a null label or vector, a null or non-finite component, or one of 2^20 and more after
scaling (scores might not fit a long) take no part, nor do rows without an id, which nothing could name. Vectors
meet those of equal length only. A row is its id: other rows of an anchor are those of another id; repeated
rows count as often as they stand, but equal anchors once. Fewer rows than asked for: all there are; empty vectors
score zero. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stampline.llm.texts import arrow_batches, written

#: Vectors of a packed block, of a row part, and of an anchor group.
BLOCK, PART, GROUP = 2048, 1 << 18, 1 << 15
#: Anchors scored against a block at once.
STRIP = 256
#: Segments per level, coarsest first; a level that the length does not allow is left out.
LEVELS = (1, 4, 16)
#: A level that keeps more than this share of the pairs before it is followed by exact scores at once.
POOR = 0.95
#: Below this share of pairs left, pairs are scored one by one instead of as a whole strip.
SPARSE = 0.02
#: Components that large after scaling do not take part: below, scores of 2^16 components stay under 2^56.
LIMIT = 1 << 20

_PACKED = ("dim int, n int, ids binary, keys binary, labels binary, vectors binary, width int, means binary, "
           "devs binary, scores binary")


def segments_of(dim: int) -> list[int]:
    return [s for s in LEVELS if s <= dim and dim % s == 0]


def summaries(vectors: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of each vector."""
    parts = vectors.reshape(len(vectors), segments, -1)
    mean = parts.mean(axis=2)
    return mean, np.sqrt(((parts - mean[..., None]) ** 2).sum(axis=2))


def coarser(mean: np.ndarray, dev: np.ndarray, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of `segments` segments from those of finer ones of `length` components."""
    m, d = mean.reshape(len(mean), segments, -1), dev.reshape(len(dev), segments, -1)
    top = m.mean(axis=2)
    return top, np.sqrt((d ** 2).sum(axis=2) + length * ((m - top[..., None]) ** 2).sum(axis=2))


def _pack(batches):
    """Rows (id, key, label, scores, vector of doubles without fractions) in blocks of one length each."""
    held: dict[int, list] = {}

    def block(dim: int, rows: list) -> tuple:
        ids, keys, labels, vectors, scores = (np.concatenate(x) for x in zip(*rows))
        kind = np.int16 if np.abs(vectors).max(initial=0) < 1 << 15 else np.int32
        segments = segments_of(dim)
        mean, dev = summaries(vectors.astype(float), segments[-1]) if segments else (np.zeros(0), np.zeros(0))
        return (dim, len(ids), ids.tobytes(), keys.tobytes(), labels.tobytes(), vectors.astype(kind).tobytes(),
                kind().itemsize, mean.astype(np.float32).tobytes(), dev.astype(np.float32).tobytes(), scores.tobytes())

    def drained(blocks):
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int32(), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks), types)],
                                          names=[p.split()[0] for p in _PACKED.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        column = {n: batch.column(batch.schema.get_field_index(n)) for n in ("id", "key", "label", "scores", "vector")}
        sizes = column["vector"].value_lengths().to_numpy()
        flat, starts = column["vector"].flatten().to_numpy(), np.append(0, np.cumsum(sizes))
        ids, keys, labels = (column[n].to_numpy() for n in ("id", "key", "label"))
        scores = column["scores"].flatten().to_numpy().reshape(len(ids), -1)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            vectors = flat[starts[at][:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0))
            rows = held.setdefault(int(dim), [])
            rows.append((ids[at], keys[at], labels[at], vectors, scores[at]))
            if sum(len(r[0]) for r in rows) >= BLOCK:
                yield drained([block(int(dim), rows)])
                rows.clear()
    left = [block(dim, rows) for dim, rows in held.items() if rows]
    if left:
        yield drained(left)


def packed(rows: DataFrame) -> DataFrame:
    """`rows` in blocks; a column `scores` of equally long lists goes with them."""
    scores = F.col("scores") if "scores" in rows.columns else F.array().cast("array<long>")
    return arrow_batches(rows.select("id", "key", "label", "vector", scores.alias("scores"))).mapInArrow(_pack, _PACKED)


class Block:
    """One packed block."""

    def __init__(self, row: dict):
        self.dim, n = row["dim"], row["n"]
        self.ids, self.keys = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["keys"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int16 if row["width"] == 2 else np.int32).reshape(n, self.dim)
        segments = segments_of(self.dim)
        self.levels = []
        if segments:
            mean, dev = (np.frombuffer(row[c], np.float32).astype(float).reshape(n, -1) for c in ("means", "devs"))
            self.levels = [(*coarser(mean, dev, self.dim // segments[-1], s), self.dim // s) for s in segments]
        self.norm = np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1))
        self.top = int(np.abs(self.vectors.astype(np.int64)).max(initial=0))


def exact(a: Block, at: slice, b: Block) -> np.ndarray:
    """Integer inner products of a strip with a block, in the narrowest type that holds every partial sum."""
    most = a.top * b.top * max(a.dim, 1)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (a.vectors[at].astype(kind) @ b.vectors.astype(kind).T).astype(np.int64)


def survivors(a: Block, at: slice, b: Block, left: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(anchor, row, score) of the pairs in `left` whose score may lie in [low, high] of the anchor, and more.

    `left` is a strip x block table of pairs; it is narrowed level by level in place.
    """
    count = int(left.sum())
    # Summaries are stored in single precision.
    slack = 1e-5 * np.outer(a.norm[at], b.norm) + 1e-3 if count else 0.0
    for (mean, dev, length), (other_mean, other_dev, _) in zip(a.levels, b.levels):
        if not count:
            break
        middle, reach = (length * mean[at]) @ other_mean.T, dev[at] @ other_dev.T + slack
        left &= (middle + reach >= low[:, None]) & (middle - reach <= high[:, None])
        before, count = count, int(left.sum())
        if count > POOR * before:
            break
    i, j = np.nonzero(left)
    if count < SPARSE * left.size:
        score = np.einsum("ij,ij->i", a.vectors[at][i].astype(np.int64), b.vectors[j].astype(np.int64))
    else:
        score = exact(a, at, b)[i, j]
    good = (score >= low[i]) & (score <= high[i])
    return i[good], j[good], score[good]


class Best:
    """The first k (score descending, id ascending) of each slot, and the score that a newcomer needs."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.need = np.full(slots, np.iinfo(np.int64).min)
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
        keep = place < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.need[slot[full]] = score[full]


LOWEST, HIGHEST = -(1 << 62), 1 << 62


class Anchors:
    """The blocks of one cell's anchor group, with what each anchor looks for and has found."""

    def __init__(self, k: int, share: tuple[int, int] | None):
        self.k, self.share, self.blocks = k, share, []

    def add(self, row: dict) -> None:
        a = Block(row)
        if self.share is None:
            self.blocks.append((a, None, Best(len(a.ids), self.k)))
            return
        scores = np.frombuffer(row["scores"], np.int64).reshape(len(a.ids), -1)
        used = scores > LOWEST
        over, under = self.share
        low = np.where(used, -((-over * scores) // under), HIGHEST)  # over * s <= under * n
        self.blocks.append((a, (np.where(used, low, HIGHEST), np.where(used, scores, LOWEST)),
                            Best(scores.size, self.k)))

    def meet(self, b: Block) -> None:
        for a, bands, best in self.blocks:
            if a.dim != b.dim:
                continue
            for begin in range(0, len(a.ids), STRIP):
                at = slice(begin, min(begin + STRIP, len(a.ids)))
                same = a.labels[at][:, None] == b.labels[None]
                if bands is None:
                    left = same & (a.ids[at][:, None] != b.ids[None])
                    i, j, score = survivors(a, at, b, left, best.need[at], np.full(at.stop - begin, HIGHEST))
                    best.add(begin + i, score, b.ids[j])
                    continue
                low, high = bands[0][at], bands[1][at]
                need = np.maximum(low, best.need.reshape(bands[0].shape)[at])
                reach = np.where(low <= high, need, HIGHEST).min(axis=1)
                i, j, score = survivors(a, at, b, ~same, reach, high.max(axis=1))
                for p in range(low.shape[1]):
                    fits = (need[i, p] <= score) & (score <= high[i, p])
                    best.add((begin + i[fits]) * low.shape[1] + p, score[fits], b.ids[j[fits]])

    def found(self):
        """(key, anchor, slot, id, score) of what every anchor keeps."""
        for a, bands, best in self.blocks:
            wide = 1 if bands is None else bands[0].shape[1]
            at = best.slot // wide
            yield a.keys[at], a.ids[at], best.slot % wide, best.id, best.score


_FOUND = "key long, anchor long, slot long, id long, score long"


def _meetings(k: int, share: tuple[int, int] | None):
    """A task's stream, sorted by (cell, side): the anchors of a cell come first, then its row blocks."""

    def run(batches):
        cell, anchors = None, None

        def results():
            for columns in anchors.found():
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 names=[c.split()[0] for c in _FOUND.split(", ")])

        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(c)[n].as_py() for c, name in enumerate(batch.schema.names)}
                if row["cell"] != cell:
                    if anchors is not None:
                        yield from results()
                    cell, anchors = row["cell"], Anchors(k, share)
                if row["side"] == 0:
                    anchors.add(row)
                else:
                    anchors.meet(Block(row))
        if anchors is not None:
            yield from results()

    return run


def _grid(anchors: DataFrame, rows: DataFrame, parts: int, groups: int, k: int,
          share: tuple[int, int] | None) -> DataFrame:
    """The first k of each (anchor, slot) over all row blocks."""
    def dealt(blocks, n):  # blocks of a file one after another to other parts
        at = F.monotonically_increasing_id()
        return blocks.withColumn("_", F.pmod(F.shiftright(at, 33) + at.bitwiseAND(F.lit((1 << 33) - 1)), F.lit(n)))

    cells = dealt(rows, parts).withColumnRenamed("_", "r").withColumns(
        {"side": F.lit(1), "g": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    heads = dealt(anchors, groups).withColumnRenamed("_", "g").withColumns(
        {"side": F.lit(0), "r": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    cell = (F.col("r") * groups + F.col("g")).cast("int")
    both = heads.unionByName(cells).withColumn("cell", cell).drop("r", "g")
    met = both.repartitionById(parts * groups, F.col("cell")).sortWithinPartitions("cell", "side") \
        .mapInArrow(_meetings(k, share), _FOUND)
    first = Window.partitionBy("key", "anchor", "slot").orderBy(F.desc("score"), "id")
    return met.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)


def usable(df: DataFrame, vec_id: str, vector: str, label: Column, scale: float) -> DataFrame:
    """(id, label, vector, key) of the rows that take part, the vector quantised; key tells equal ids apart."""
    whole = F.transform(df[vector], lambda x: F.floor(x.cast("double") * scale).cast("double"))
    known = F.forall(df[vector], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LIMIT - 1))
    return df.where(df[vec_id].isNotNull() & label.isNotNull() & df[vector].isNotNull() & known).select(
        df[vec_id].cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vector")) \
        .withColumn("key", F.xxhash64("id", "label", "vector"))


def hard_negatives(df: DataFrame, anchors: Column, label: Column | None = None, vec_id: str = "vec_id",
                   vector: str = "embedding", scale: float = 256.0, n_positives: int = 5, n_negatives: int = 5,
                   share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchors` is a condition over the columns id and label of the rows that take part. A negative n of a positive p
    fulfils share[0] * p <= share[1] * n and n <= p.
    """
    spark = df.sparkSession
    rows = usable(df, vec_id, vector, df["label"] if label is None else label, scale)
    blocks = written(packed(rows))
    mine = written(rows.where(anchors).dropDuplicates(["id", "label", "vector"]))
    n_rows, n_anchors = blocks.agg(F.sum("n")).first()[0] or 0, mine.count()
    cores = spark.sparkContext.defaultParallelism
    parts = max(math.ceil(n_rows / PART), min(cores, math.ceil(n_rows / BLOCK)), 1)
    groups = max(math.ceil(n_anchors / GROUP), 1)
    spread = mine.repartition(max(groups, math.ceil(n_anchors / BLOCK)), "key", "id")
    best = written(_grid(packed(spread), blocks, parts, groups, n_positives, None))
    missing = F.array_repeat(F.lit(LOWEST).cast("long"), n_positives)
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda x: x["score"])
    scores = best.groupBy("key", F.col("anchor").alias("id")).agg(ranked.alias("scores"))
    seeking = mine.join(scores, ["key", "id"]).withColumn(
        "scores", F.slice(F.concat("scores", missing), 1, n_positives))
    seeking = seeking.repartition(max(groups, math.ceil(n_anchors / BLOCK)), "key", "id")
    found = _grid(packed(seeking), blocks, parts, groups, n_negatives, share)
    positives = best.select("key", "anchor", (F.col("place") - 1).cast("long").alias("slot"),
                            F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(positives, ["key", "anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined_negatives(df: DataFrame) -> DataFrame:
    """The contract's anchors, labels and bands over `embeddings`."""
    label = F.when(df["vec_id"] % 7 == 0, (df["label"] + 1) % 10).otherwise(df["label"])
    return hard_negatives(df, F.col("id") % 100 == 0, label)
