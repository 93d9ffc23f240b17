"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of `width` words (a shorter item is one window). A window is the ordered set of
its shingles of `shingle` words. A text that contains a window contains all of its shingles, so the necessary
prefix is one token: the shingle that is rarest over all texts. Frequencies of the benchmark's shingles are
counted over the whole corpus; a window with a shingle that never occurs cannot occur.

The texts are joined with the windows on that shingle alone. The bounds follow from the shingle's place: the
window must not begin before the text nor end after it. What is left is verified word by word against the
words around the shingle.

Texts send only places whose shingle may be in a bitmap of fixed size; the join itself is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampline.llm.texts import (ALNUM, ID, MARK, Rolling, Slice, Words, batch_of, bitmap, keyed, map_texts, marked, mix,
                                 ranges, shown, texts_of, written)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (words of the slice) and hashes of the shingles of one size that lie within a text."""
    n = max(0, len(words.start) - size + 1)
    text_of = words.text_of()
    at = np.flatnonzero(text_of[:n] == text_of[size - 1:size - 1 + n])
    rolling = Rolling(mix(words.hashes() + np.uint64(size)), 1)
    return at, mix(rolling.of(at, at + size))


def item_windows(items: DataFrame, width: int, shingle: int) -> DataFrame:
    """item, window (its words joined by a space), n (its words), shingles (hashes in order)."""

    def cut(part: Slice):
        words = part.words(ALNUM, lower=True)
        joined, begin, end = words.joined()
        n = np.minimum(words.count, width)
        counts = np.where(n > 0, words.count - n + 1, 0)
        text = np.repeat(np.arange(part.n), counts)
        first = words.first[text] + ranges(counts)
        size = np.minimum(n, shingle)
        rows = [joined[a:b].decode() for a, b in zip(begin[first], end[first + n[text] - 1])]
        lists = []
        known = {s: dict(zip(*(x.tolist() for x in shingles(words, s)))) for s in np.unique(size[n > 0]).tolist()}
        for w, t in zip(first.tolist(), text.tolist()):
            s = int(size[t])
            lists.append([known[s][w + i] for i in range(int(n[t]) - s + 1)])
        hashes = [np.array(x, np.uint64).view(np.int64) for x in lists]
        return batch_of(item=part.batch.column("id").take(pa.array(text)), window=pa.array(rows, pa.string()),
                        n=n[text].astype(np.int64), shingles=pa.array(hashes, pa.list_(pa.int64())))

    return map_texts(items, "text", cut, "item long, window string, n long, shingles array<long>")


def frequencies(docs: DataFrame, holds, sizes: list[int]) -> DataFrame:
    """shingle, n: how often shingles that may be in the bitmap occur, over all texts."""

    def count(part: Slice):
        words = part.words(ALNUM, lower=True)
        found = [hashes[holds.value.may_hold(hashes)] for _, hashes in (shingles(words, s) for s in sizes)]
        shingle, n = np.unique(np.concatenate(found), return_counts=True)
        return batch_of(shingle=shingle.view(np.int64), n=n) if len(n) else None

    return map_texts(docs, "text", count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, holds, sizes: list[int], width: int, shingle: int) -> DataFrame:
    """id and n_words of every text, with the places whose shingle may be a prefix: shingle, at (word), lead (words
    before it in `around`), around (the words within reach of a window)."""

    def probe(part: Slice):
        words = part.words(ALNUM, lower=True)
        found = [shingles(words, s) for s in sizes]
        at, hashes = (np.concatenate(x) for x in zip(*found))
        size = np.repeat(sizes, [len(places) for places, _ in found])
        mine = holds.value.may_hold(hashes)
        at, hashes, size = at[mine], hashes[mine], size[mine]
        text = np.searchsorted(words.first, at, "right") - 1
        order = np.argsort(text, kind="stable")
        at, hashes, text, size = at[order], hashes[order], text[order], size[order]
        # A shingle of the full size may lie anywhere in a window; a shorter one is the window.
        reach = np.where(size == shingle, width - size, 0)
        first = np.maximum(at - reach, words.first[text])
        last = np.minimum(at + size + reach, words.first[text + 1]) - 1
        joined, begin, end = words.joined() if len(at) else (b"", np.zeros(1, int), np.zeros(1, int))
        around = [joined[a:b].decode() for a, b in zip(begin[first], end[last])]
        flat = pa.StructArray.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(at - words.first[text]), pa.array(at - first),
             pa.array(around, pa.string())], ["shingle", "at", "lead", "around"])
        bounds = np.append(0, np.cumsum(np.bincount(text, minlength=part.n))).astype(np.int32)
        return batch_of(id=part.batch.column("id"), th=part.batch.column("th"), n_words=words.count.astype(np.int64),
                        places=pa.ListArray.from_arrays(pa.array(bounds), flat))

    return map_texts(docs, "text", probe, "id long, th long, n_words long, places array<struct<shingle:long, at:long, "
                                          "lead:long, around:string>>")


def hits(docs: DataFrame, items: DataFrame, width: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts: row, id, th, n_words), (hits: row, begin, n, window), (item, window).

    docs: id, th, text; items: id, text. `row` numbers the input rows.
    """
    pairs = written(item_windows(items, width, shingle))
    tokens = (pairs.select("window", "n", F.posexplode("shingles").alias("offset", "shingle"))
              .distinct())
    tokens = written(tokens)
    sizes = sorted({min(r[0], shingle) for r in tokens.select("n").distinct().collect()}) or [shingle]  # up to width
    counted = written(frequencies(docs, bitmap(tokens, "shingle"), sizes))
    # Windows of which some shingle never occurs go; the rarest shingle of the others is their prefix.
    ranked = tokens.join(counted.withColumnRenamed("n", "freq"), "shingle", "left").groupBy("window", "n").agg(
        F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "shingle", "offset")).alias("rarest"))
    prefix = written(ranked.where("rarest.freq > 0").select("window", "n", "rarest.shingle", "rarest.offset"))
    texts = written(candidates(docs, bitmap(prefix, "shingle"), sizes, width, shingle)
                    .withColumn("row", F.monotonically_increasing_id()))
    places = texts.select("row", "n_words", F.inline("places"))
    begin = F.col("at") - F.col("offset")
    found = (places.join(prefix, "shingle")
             .where((F.col("lead") >= F.col("offset")) & (begin + F.col("n") <= F.col("n_words")))
             .where(F.slice(F.split("around", " "), (F.col("lead") - F.col("offset") + 1).cast("int"),
                            F.col("n").cast("int")) == F.split("window", " "))
             .select("row", begin.alias("begin"), "n", "window"))
    return texts.select("row", "id", "th", "n_words"), written(found.distinct()), pairs.select("item", "window").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", width: int = 10, shingle: int = 4) -> DataFrame:
    """`id_col`, n_words, n_hit, n_items, items_sha256, contaminated for every text.

    Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased. n_hit counts words
    inside any occurrence of a window, n_items the items with such windows; items_sha256 is the digest of their
    ids, sorted as strings, comma-joined (of nothing without items). Null texts have no words, null or empty
    items no windows; items without an id count in n_hit alone. Rows stay as many as they are, repeated ids or
    rows included; equal items are all named. Other columns are left behind.
    """
    texts, found, pairs = hits(texts_of(docs, id_col, text_col), keyed(items, item_id, item_text), width, shingle)
    spans = F.array_sort(F.collect_set(F.struct("begin", (F.col("begin") + F.col("n")).alias("end"))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("total")),
        lambda acc, x: F.struct(F.greatest(acc["to"], x["end"]).alias("to"),
                                (acc["total"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["to"], x["begin"])))
                                .alias("total")), lambda acc: acc["total"])
    words = found.groupBy("row").agg(covered.alias("n_hit"))
    named = (found.select("row", "window").distinct().join(pairs, "window").select("row", shown("item").alias("item"))
             .where("item is not null").distinct().groupBy("row")
             .agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items")))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return (texts.join(words, "row", "left").join(named, "row", "left").select(
        shown().alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated")))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id: str = "item_id", item_text: str = "text", width: int = 10, shingle: int = 4) -> DataFrame:
    """The rows whose text holds no window of any item, with all their columns."""
    texts, found, _ = hits(texts_of(docs, id_col, text_col), keyed(items, item_id, item_text), width, shingle)
    bad = texts.join(found.select("row").distinct(), "row", "left_semi").select(
        F.col("id").alias(ID), F.col("th").alias(MARK)).distinct()
    return marked(docs, id_col, text_col).join(written(bad), [ID, MARK], "left_anti").select(docs.columns)
