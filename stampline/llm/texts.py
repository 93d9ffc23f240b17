"""Arrow batches of texts as flat byte arrays: word bounds, rolling hashes, sliding minima.

Words are found on UTF-8 bytes: both word classes in use exclude ASCII bytes only, so a byte table decides
them exactly. Null texts count as empty. A batch is cut into slices of about `SLICE` bytes (a longer text
is a slice of its own), so a worker's memory follows the slice and not the batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampline.session import ensure_checkpoint_dir, ship

SLICE = 1 << 19
#: Rows without an id share one; it is the smallest long, below any real id.
NO_ID = -(1 << 63)

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: `[^\x20\x09-\x0D]+`
PLAIN = ~_SPACES
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased
ALNUM = np.ones(256, bool)
ALNUM[:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _UPPER.lower())


def arrow_batches(df: DataFrame) -> DataFrame:
    """Smaller Arrow batches where the session has Spark's default, and the package for the Python workers."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) >= 10000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


class Slice:
    """Some texts of one batch: `ids`, flat bytes `buf`, and `at`, the bounds of the texts in it."""

    def __init__(self, batch: pa.RecordBatch, text: str):
        self.batch = batch
        col = batch.column(batch.schema.get_field_index(text))
        if col.null_count:
            col = col.fill_null("")
        if not pa.types.is_large_string(col.type):
            col = col.cast(pa.large_string())
        n = len(col)
        offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
        data = col.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.buf = data[offsets[0]:offsets[-1]]
        self.at = offsets - offsets[0]
        self.n = n

    def column(self, name: str) -> np.ndarray:
        return self.batch.column(self.batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

    def words(self, table: np.ndarray, lower: bool = False) -> Words:
        return Words(self, table, lower)


class Words:
    """Bounds of the words of a slice: `start`, `end` (bytes), and `first`, the bounds of each text's words."""

    def __init__(self, part: Slice, table: np.ndarray, lower: bool):
        buf = LOWER[part.buf] if lower else part.buf
        inside = table[buf]
        begins, ends = inside.copy(), inside.copy()
        if len(buf):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            full = part.at[1:] > part.at[:-1]
            head, tail = part.at[:-1][full], part.at[1:][full] - 1
            begins[head] = inside[head]
            ends[tail] = inside[tail]
        self.buf = buf
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, part.at)
        self.count = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def joined(self, chosen: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bytes of the texts with their (chosen) words joined by one space, and where each of those begins and ends."""
        start, end, text_of = self.start, self.end, self.text_of()
        if chosen is not None:
            start, end, text_of = start[chosen], end[chosen], text_of[chosen]
        depth = np.zeros(len(self.buf) + 2, np.int8)
        depth[start] = 1
        np.subtract.at(depth, end, 1)
        keep = np.cumsum(depth, dtype=np.int8)[:-1] > 0
        buf = np.append(self.buf, np.uint8(0x20))
        inner = end[:-1][text_of[1:] == text_of[:-1]]  # another word of the text follows
        keep[inner] = True
        buf[inner] = 0x20
        place = np.append(0, np.cumsum(keep))
        return buf[keep].tobytes(), place[start], place[end]

    def hashes(self, salt: int = 0) -> np.ndarray:
        return mix(Rolling(byte_values(salt)[self.buf], salt).of(self.start, self.end)
                   + (self.end - self.start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLES: dict[int, np.ndarray] = {}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xDA942042E4DD58B5)


def byte_values(salt: int) -> np.ndarray:
    if salt not in _TABLES:
        _TABLES[salt] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * salt))
    return _TABLES[salt]


def _powers(salt: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    known = _POWERS.get(salt)
    if known is None or len(known[0]) < n:
        base = _BASES[salt % len(_BASES)]
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, SLICE + 2), b, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        known = (pair[0], pair[1])
        if n <= 8 * SLICE:  # tables for one huge text are not kept
            _POWERS[salt] = known
    return known


class Rolling:
    """Hash of any stretch of `values` in O(1): a polynomial with an odd base, modulo 2^64."""

    def __init__(self, values: np.ndarray, salt: int = 0):
        power, self.inverse = _powers(salt, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[:len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each `width` neighbours, the leftmost of equal ones."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, have = values, np.arange(len(values), dtype=np.int32), 1

    def joined(step):
        a, b = best[:-step], best[step:]
        right = b < a
        return np.where(right, b, a), np.where(right, at[step:], at[:-step])

    while 2 * have <= width:
        best, at = joined(have)
        have *= 2
    if have < width:
        best, at = joined(width - have)
    return at[:n].astype(np.int64)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after another."""
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) - np.repeat(ends - counts, counts)


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[Slice]:
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if not len(col):
            continue
        size = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, begin = np.cumsum(size), 0
        while begin < len(col):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + SLICE, "right")))
            yield Slice(batch.slice(begin, end - begin), text)
            begin = end


def map_texts(df: DataFrame, text: str, fn: Callable[[Slice], pa.RecordBatch | None], schema: str,
              done: Callable[[], None] | None = None) -> DataFrame:
    """`fn` over slices of the texts; each gives a batch with the columns of `schema`, or None. `done` ends a
    partition: Python workers live on, and what they keep counts against the executor's memory."""

    def run(batches):
        try:
            for part in slices(batches, text):
                out = fn(part)
                if out is not None:
                    yield out
        finally:
            if done is not None:
                done()

    return arrow_batches(df).mapInArrow(run, schema)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()],
                                      names=list(columns))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id, with NO_ID for null, and the text; other columns stay behind."""
    return df.select(F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)).alias("id"), df[text_col].alias("text"))


def shown(col: str = "id") -> Column:
    return F.when(F.col(col) != NO_ID, F.col(col))


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`keyed`, and `th`, the text's 64-bit hash, so that different texts sharing an id stay apart."""
    return keyed(df, id_col, text_col).withColumn("th", text_mark(F.col("text")))


#: Columns that row-keeping operators add for a while; no table has these names.
ID, MARK = "__llm_id", "__llm_mark"


def marked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All columns of df, and the id and mark of `texts_of` under names of their own."""
    return df.withColumns({ID: F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)), MARK: text_mark(df[text_col])})


def text_mark(text: Column) -> Column:
    return F.xxhash64(text)  # of a null text the seed


def text_udf(fn: Callable[[Slice], pa.Array], kind: str, *names: str):
    """An Arrow UDF that runs `fn` on slices of its first argument; further arguments are columns `names`."""

    def run(text: pa.Array, *more: pa.Array) -> pa.Array:
        batch = batch_of(text=text, **dict(zip(names, more)))
        found = [fn(part) for part in slices([batch], "text")]
        return pa.concat_arrays(found) if found else fn(Slice(batch, "text"))

    if not names:
        def one(text: pa.Array) -> pa.Array:
            return run(text)

        return F.arrow_udf(one, kind)

    def two(text: pa.Array, other: pa.Array) -> pa.Array:
        return run(text, other)

    return F.arrow_udf(two, kind)


def place(begin, low=0):
    """One long for a place in a text: a position, and 20 bits more."""
    return begin << 20 | low


def place_parts(at: str = "at") -> tuple[Column, Column, Column]:
    """(begin, low) of `place`."""
    return F.shiftright(at, 20).alias("begin"), F.col(at).bitwiseAND(F.lit(0xFFFFF)).alias("low")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the set of their spans (id, th, begin, size); null where there are none. Equal rows each bring the
    spans of their text, which count once."""
    listed = spans.groupBy("id", "th").agg(F.collect_set(F.struct("begin", "size")).alias("spans"))
    return docs.join(listed, ["id", "th"], "left")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared checkpoint folder: smaller than a checkpoint of rows, and
    read column by column. Shuffle files behind it go at once, since nothing reads them again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cover(part: Slice, first: np.ndarray, total: int) -> np.ndarray:
    """Which of `total` units the `spans` of a slice cover; first: where each text's units begin."""
    spans = part.batch.column(part.batch.schema.get_field_index("spans"))
    counts = pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = spans.flatten()
    begin = flat.field("begin").to_numpy() + np.repeat(first, counts)
    depth = np.zeros(total + 1, np.int64)
    np.add.at(depth, begin, 1)
    np.add.at(depth, begin + flat.field("size").to_numpy(), -1)
    return np.cumsum(depth)[:total] > 0


class Bits:
    """A set of 64-bit hashes as a bitmap of fixed size: it may say yes wrongly, never no wrongly."""

    def __init__(self, words: np.ndarray, mask: int):
        self.words, self.mask = words, np.uint64(mask)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(7)) & self.mask
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def bitmap(df: DataFrame, col: str, log_bits: int = 26):
    """Broadcast bitmap of a long column: 2^log_bits bits whatever the rows (8 MB by default); the driver gets at
    most 2^(log_bits - 6) pre-aggregated words of 16 bytes with their numbers."""
    mask = (1 << log_bits) - 1
    slot = F.shiftrightunsigned(F.col(col), 7).bitwiseAND(F.lit(mask))
    got = (df.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"),
                     slot.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
           .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    words = np.zeros((mask + 1) >> 6, np.uint64)
    for part in got.to_batches():  # one by one, so no copy of the whole is made
        words[part.column("w").to_numpy()] = part.column("b").to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(Bits(words, mask))
