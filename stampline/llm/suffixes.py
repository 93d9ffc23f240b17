"""Suffix-array dedup on bytes by bucket-pointer refinement.

Sorting every suffix of a corpus would move many times its size, so the initial q-gram buckets are opened at
anchors only: the smallest hashed q-gram among the width - q + 1 inside a string of `width` bytes, leftmost of
equal ones. Equal strings have the same anchor at the same place, so they meet in its bucket; a string's
bucket is never lost. Consecutive strings with one anchor are one run.

1. Buckets with one member go. Runs of equal bytes in a bucket are settled by their own hash: if there are
   two, all their strings are repeated. One of each such kind stays as a partner.
2. Buckets with several kinds of runs are refined. Their bytes are cut out of the texts, and the strings
   inside are sorted on bucket identifiers: buckets of width / 4 bytes, then on the pair (bucket, bucket a
   quarter later), and those new buckets again on the pair half a width apart. Buckets of one are left out.
3. A bucket with too many kinds of runs for one task is first dealt by finer buckets: half of the places
   relative to the anchor each, keyed by the bytes that all strings at those places share, again and again if
   need be, down to single places, where equal keys are equal strings.

Steps 1 and 3 rest on pairs of 64-bit hashes, step 2 on 64-bit hashes of quarters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampline.llm.texts import (Rolling, Slice, batch_of, bitmap, byte_values, cover, map_texts, mix, place,
                                 place_parts, ranges, shown, sliding_argmin, texts_of, with_spans, written)

#: As for other pre-filters: past so many repeated anchors the second pass goes without its bitmap.
FILTER_ROOM = 1 << 23
#: Kinds of runs that one task refines together.
BUCKET_ROOM = 2048
#: Bytes that a task refines at once, past the end of a bucket.
AT_ONCE = 1 << 21


class Runs:
    """Runs of strings with one anchor: `begin` (byte in the slice), `size` (strings), `anchor`, `text`."""

    def __init__(self, part: Slice, width: int, q: int):
        self.width, self.rolling = width, Rolling(byte_values(0)[part.buf], 0)
        self.part = part
        places = np.arange(max(0, len(part.buf) - q + 1))
        grams = mix(self.rolling.of(places, places + q))
        lowest = sliding_argmin((grams >> np.uint64(32)).astype(np.uint32), width - q + 1)
        n = len(lowest)
        inside = np.zeros(n + 1, np.int32)
        long = np.flatnonzero(np.diff(part.at) >= width)
        inside[part.at[long]] += 1
        inside[part.at[long + 1] - width + 1] -= 1
        valid = np.cumsum(inside)[:n] > 0
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (lowest[1:] != lowest[:-1])
        stop = valid.copy()
        stop[:-1] &= ~valid[1:] | new[1:]
        self.begin = np.flatnonzero(new)
        self.size = np.flatnonzero(stop) + 1 - self.begin
        self.anchor = lowest[self.begin]
        self.core = grams[self.anchor]
        self.text = np.searchsorted(part.at, self.begin, "right") - 1

    def kinds(self) -> np.ndarray:
        """A hash of all bytes of each run, with another base than the anchor's."""
        rolling = Rolling(byte_values(1)[self.part.buf], 1)
        return mix(rolling.of(self.begin, self.begin + self.size + self.width - 1))


def repeated_anchors(docs: DataFrame, width: int, q: int) -> DataFrame:
    def count(part):
        core, n = np.unique(Runs(part, width, q).core, return_counts=True)
        return batch_of(core=core.view(np.int64), n=n.astype(np.int64)) if len(core) else None

    counted = map_texts(docs, "text", count, "core long, n long")
    return counted.groupBy("core").agg(F.sum("n").alias("n")).where("n > 1").select("core")


#: Bits of a place for the strings of a run and for its anchor's offset.
RUN_BITS = 10


def candidate_runs(docs: DataFrame, width: int, q: int, holds) -> DataFrame:
    """Runs whose anchor may be repeated: id, th, core, kind, and at (`place` of the first string, with the number
    of strings and the anchor's offset)."""

    def emit(part):
        runs = Runs(part, width, q)
        kind = runs.kinds()
        keep = np.arange(len(kind)) if holds is None else np.flatnonzero(holds.value.may_hold(runs.core))
        if not len(keep):
            return None
        text, begin = runs.text[keep], runs.begin[keep]
        return batch_of(id=part.column("id")[text], th=part.column("th")[text], core=runs.core[keep].view(np.int64),
                        kind=kind[keep].view(np.int64),
                        at=place(begin - part.at[text], runs.size[keep] << RUN_BITS | runs.anchor[keep] - begin))

    return map_texts(docs, "text", emit, "id long, th long, core long, kind long, at long")


def run_parts() -> list:
    """begin, size, off of a run's `at`."""
    begin, low = place_parts()
    return [begin, F.shiftright(low, RUN_BITS).alias("size"),
            low.bitwiseAND(F.lit((1 << RUN_BITS) - 1)).alias("off")]


def cut_runs(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """The bytes of the runs in `places` (id, th, core, crowded, at), from one join with their texts."""
    listed = (places.select("id", "th", "core", "crowded", *run_parts()).groupBy("id", "th")
              .agg(F.collect_list(F.struct("core", "crowded", "begin", "size", "off")).alias("runs")))

    def cut(part):
        runs = part.batch.column("runs")
        flat = runs.flatten()
        text = np.repeat(np.arange(part.n), runs.value_lengths().to_numpy())
        begin, size = flat.field("begin").to_numpy(), flat.field("size").to_numpy()
        return batch_of(id=part.column("id")[text], th=part.column("th")[text],
                        key=flat.field("core"), crowded=flat.field("crowded"), begin=flat.field("begin"),
                        size=flat.field("size"), off=flat.field("off"),
                        bytes=stretches(part.buf, part.at[text] + begin, size + width - 1))

    joined = docs.join(listed, ["id", "th"])
    return map_texts(joined.select("id", "th", "text", "runs"), "text", cut,
                     "id long, th long, key long, crowded boolean, begin long, size long, off long, bytes binary")


def stretches(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Pieces of a byte array as binaries."""
    offsets = np.append(0, np.cumsum(length)).astype(np.int32)
    data = buf[np.repeat(start, length) + ranges(length)]
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def pairs_as_buckets(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense identifiers of pairs of identifiers."""
    return np.unique(first * (second.max() + 1) + second, return_inverse=True)[1]


def refine(table: pa.Table, width: int) -> pa.RecordBatch | None:
    """Spans of the strings that occur at two places of a table of runs: bucket-pointer refinement."""
    column = {name: table.column(name).combine_chunks() for name in ("id", "th", "begin", "size", "bytes")}
    th, begin = column["th"].to_numpy(), column["begin"].to_numpy()
    ids = column["id"].to_numpy()
    new = np.append(True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]) | (begin[1:] != begin[:-1]))
    if new.sum() < 2:
        return None
    buf, at = flat_bytes(column["bytes"])
    chosen = np.flatnonzero(new)  # a repeated row is no second place
    size = column["size"].to_numpy()[chosen]
    half = (width + 1) // 2
    quarter = (half + 1) // 2
    places = np.arange(len(buf) - quarter + 1)
    grams = mix(Rolling(byte_values(2)[buf], 2).of(places, places + quarter))
    bucket = np.unique(grams, return_inverse=True)[1]
    run = np.repeat(np.arange(len(size)), size)
    string = at[chosen][run] + ranges(size)
    live = np.arange(len(string))
    # A later bucket overlaps the one before where the lengths do not divide: the pair still spans both.
    wide = np.full(len(buf) + 1, -1)
    needed = np.unique(np.concatenate([string, string + width - half]))
    wide[needed] = pairs_as_buckets(bucket[needed], bucket[needed + half - quarter])
    for buckets, later in ((bucket, half - quarter), (wide, width - half)):
        full = pairs_as_buckets(buckets[string[live]], buckets[string[live] + later])
        live = live[np.bincount(full)[full] > 1]
        if not len(live):
            return None
    run, first = run[live], begin[chosen][run[live]] + (string - at[chosen][run])[live]
    starts = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (first[1:] != first[:-1] + 1)))
    rows = chosen[run[starts]]
    return batch_of(id=ids[rows], th=th[rows], begin=first[starts],
                    size=np.diff(np.append(starts, len(run))) + width - 1)


def refined(batches, width: int):
    """`refine` over whole keys of sorted batches, as many keys at once as fit."""
    held: list[pa.RecordBatch] = []
    weight = 0

    def flush(parts):
        table = pa.Table.from_batches(parts)
        out = refine(table, width)
        return [out] if out is not None else []

    for batch in batches:
        begin, key = 0, batch.column("key").to_numpy()
        if not len(key):
            continue
        if held and weight > AT_ONCE and key[0] != held[-1].column("key")[-1].as_py():
            yield from flush(held)
            held, weight = [], 0
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        sizes = np.cumsum(batch.column("size").to_numpy() + width)
        for end in ends.tolist():
            total = weight + int(sizes[end - 1] - (sizes[begin - 1] if begin else 0))
            if total > AT_ONCE and end < len(key):
                held.append(batch.slice(begin, end - begin))
                yield from flush(held)
                held, weight, begin = [], 0, end
        if begin < len(key):
            held.append(batch.slice(begin))
            weight += int(sizes[-1] - (sizes[begin - 1] if begin else 0))
    if held:
        yield from flush(held)


def halved(rows: DataFrame, low: int, high: int, width: int) -> DataFrame:
    """Rows for the two halves of the places low..high (begin - anchor), keyed by the bytes shared there."""
    middle = (low + high) // 2

    def split(batches):
        for batch in batches:
            if not len(batch):
                continue
            buf, at = flat_bytes(batch.column("bytes"))
            one, two = Rolling(byte_values(0)[buf], 0), Rolling(byte_values(1)[buf], 1)
            size, off = batch.column("size").to_numpy(), batch.column("off").to_numpy()
            for a, b in ((low, middle), (middle + 1, high)):
                first, last = np.maximum(a, -off), np.minimum(b, size - 1 - off)
                rows = np.flatnonzero(first <= last)
                if not len(rows):
                    continue
                skip, anchor = (first + off)[rows], at[rows] + off[rows]
                new, keep = (last - first + 1)[rows], at[rows] + (first + off)[rows]
                shared = one.of(anchor + b, anchor + a + width), two.of(anchor + b, anchor + a + width)
                take = pa.array(rows)
                yield batch_of(
                    id=batch.column("id").take(take), th=batch.column("th").take(take),
                    key=(mix(mix(shared[0]) ^ shared[1]) + np.uint64(a & 0xFFFF)).view(np.int64),
                    low=np.full(len(rows), a), high=np.full(len(rows), b),
                    begin=batch.column("begin").to_numpy()[rows] + skip, size=new, off=off[rows] - skip,
                    bytes=stretches(buf, keep, new + width - 1))

    return rows.mapInArrow(split, "id long, th long, key long, low long, high long, begin long, size long, "
                                  "off long, bytes binary")


SPAN = ["id", "th", "begin", "size"]


def crowded_spans(rows: DataFrame, width: int, q: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Deal crowded buckets by finer ones until they fit: (rows that fit, finished spans)."""
    fit, done = [], []
    spread = [(q - width, 0, rows)]
    where = F.struct("id", "th", "begin")
    while spread:
        low, high, rows = spread.pop()
        both = written(halved(rows, low, high, width))
        for a, b in ((low, (low + high) // 2), ((low + high) // 2 + 1, high)):
            half = both.where(F.col("low") == a)
            sizes = written(half.groupBy("key").agg(F.count("*").alias("n"), F.min(where).alias("first"),
                                                    F.max(where).alias("last"))
                            .where("first < last").select("key", "n"))
            counted = half.join(sizes, "key")
            if a == b:
                done.append(counted.select("id", "th", "begin", F.lit(width).cast("long").alias("size")))
                continue
            fit.append(counted.where(F.col("n") <= BUCKET_ROOM))
            if sizes.where(F.col("n") > BUCKET_ROOM).head(1):
                spread.append((a, b, written(counted.where(F.col("n") > BUCKET_ROOM).drop("n"))))
    return fit, done


def repeated_strings(docs: DataFrame, width: int = 400, q: int = 200) -> DataFrame:
    """`id`, `th`, `begin`, `size` (bytes): spans in which every string of `width` bytes also starts elsewhere."""
    if not 4 <= q < width or width - q >= (1 << RUN_BITS) - 1:
        raise ValueError("q must be below width, by less than 1023")
    anchors = written(repeated_anchors(docs, width, q))
    holds = bitmap(anchors, "core") if anchors.count() <= FILTER_ROOM else None
    found = candidate_runs(docs, width, q, holds)
    here = F.struct("id", "th", "at")
    kinds = written(found.groupBy("core", "kind").agg(F.min(here).alias("first"), F.max(here).alias("last"))
                    .select("core", "kind", "first", (F.col("first") < F.col("last")).alias("several")))
    twice = kinds.where("several").select("core", "kind")
    begin, size, _ = run_parts()
    equal = written(found.join(twice, ["core", "kind"])
                    .select("id", "th", begin, (size + F.lit(width - 1)).alias("size")))
    several = written(kinds.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"))
    opened = kinds.join(several, "core").select("first.*", "core", (F.col("n") > BUCKET_ROOM).alias("crowded"))
    cuts = written(cut_runs(docs, opened, width))
    fit, done = [cuts.where("not crowded")], []
    if cuts.where("crowded").head(1):
        more, done = crowded_spans(cuts.where("crowded").drop("crowded"), width, q)
        fit += more
    parts = [equal, *done]
    for rows in fit:
        dealt = rows.select("key", *SPAN, "bytes").repartition("key").sortWithinPartitions("key", "id", "th", "begin")
        parts.append(written(dealt.mapInArrow(lambda b: refined(b, width),
                                              "id long, th long, begin long, size long")))
    spans = parts[0]
    for more in parts[1:]:
        spans = spans.unionByName(more)
    return spans


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400,
                 q: int | None = None, bytes_kept: bool = False) -> DataFrame:
    """`id_col`, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of every text as UTF-8, and
    `kept` (the remaining bytes) if asked for.

    A byte goes if a string of `width` bytes around it also starts anywhere else, in the same text or another;
    strings are judged on the input and never cross texts. Null texts are empty: nothing to remove, the digest
    of nothing. Rows stay as many as they are: wholly repeated rows are one text, seen once; different texts
    with one id are different texts. Other columns are left behind. A text must fit a worker's memory some
    sixty times.
    """
    base = texts_of(docs, id_col, text_col)
    joined = with_spans(base, repeated_strings(base, width, q or width // 2))

    def digest(part):
        gone = cover(part, part.at[:-1], len(part.buf))
        ends = np.append(0, np.cumsum(gone))[part.at]
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        heads = part.at[:-1][part.at[1:] > part.at[:-1]]
        starts[heads] = gone[heads]
        spans = np.diff(np.append(0, np.cumsum(starts))[part.at])
        kept, bounds = part.buf[~gone].tobytes(), (part.at - ends).tolist()
        pieces = [kept[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        out = {"id": part.batch.column("id"), "n_bytes": np.diff(part.at), "n_removed": np.diff(ends),
               "n_spans": spans, "kept_sha256": [hashlib.sha256(p).hexdigest() for p in pieces]}
        if bytes_kept:
            out["kept"] = pa.array(pieces, pa.binary())
        return batch_of(**out)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * bytes_kept
    out = map_texts(joined.select("id", "text", "spans"), "text", digest, schema)
    return out.select(shown().alias(id_col), *out.columns[1:])
