"""Substring dedup by De Bruijn compaction.

A window of k words is an edge of the De Bruijn graph. Consecutive edges of a text that share their minimizer
(the smallest hashed m-gram of words in the window) form one path, so a path stands for several edges and
equal edges always lie in paths with the same minimizer. Minimizers seen once hold unique edges only and
go. Where all occurrences of a minimizer carry the same path, the path does not branch and is compacted into
one row: all occurrences but the first in source order are repeated spans. Paths that follow each other inside a
repeated stretch are first compared as one chain, so a passage that many texts hold costs each of them a few
rows, not one per path; only the first occurrence of a chain is opened into its paths. Where paths differ, the first
occurrence of each is opened into its edges, and the edges are compared one by one. Source coordinates
(document, word) decide what came first, and spans are put together per document.

Equality is that of a 64-bit minimizer hash and a 64-bit path or edge hash with another base, together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampline.llm.texts import (ID, MARK, PLAIN, Rolling, Slice, arrow_batches, batch_of, bitmap, cover, map_texts,
                                 marked, mix, place, place_parts, ranges, shown, sliding_argmin, text_udf, texts_of,
                                 with_spans, written)

#: A pre-filter's bitmap of 2^26 bits (8 MB) serves so many rows. More rows get a larger one, of up to 2^29 bits
#: (64 MB); still more only make it let more through, which has no part in the result.
FILTER_ROOM, FILTER_MOST = 1 << 23, 29
SPANS = "__llm_spans"


class Paths:
    """Paths of a slice's texts: `begin` (word in the slice), `size` (edges), `core` and `text` of each."""

    def __init__(self, part: Slice, k: int, m: int):
        self.words = part.words(PLAIN)
        self.hash = self.words.hashes()
        self.k = k
        grams = self.hash_of(0, m, np.arange(max(0, len(self.hash) - m + 1)))
        lowest = sliding_argmin(grams, k - m + 1)
        n = len(lowest)
        text_of = self.words.text_of()
        valid = text_of[:n] == text_of[k - 1:k - 1 + n]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (lowest[1:] != lowest[:-1])
        self.begin = np.flatnonzero(new)
        stop = valid.copy()
        stop[:-1] &= ~valid[1:] | new[1:]
        self.size = np.flatnonzero(stop) + 1 - self.begin
        self.core = grams[lowest[self.begin]]
        self.text = text_of[self.begin]

    def hash_of(self, salt: int, size, begin: np.ndarray) -> np.ndarray:
        rolling = Rolling(mix(self.hash + np.uint64(salt + 1)), salt)
        return mix(rolling.of(begin, begin + size))

    def take(self, keep: np.ndarray) -> None:
        self.begin, self.size, self.core, self.text = (
            x[keep] for x in (self.begin, self.size, self.core, self.text))


def filter_of(rows: DataFrame, col: str):
    """The bitmap of a table's column, with eight bits a row and more as long as `FILTER_MOST` allows."""
    n, log_bits = rows.count(), 26
    while n > FILTER_ROOM << (log_bits - 26) and log_bits < FILTER_MOST:
        log_bits += 1
    return bitmap(rows, col, log_bits)


def repeated_cores(docs: DataFrame, k: int, m: int) -> DataFrame:
    """Minimizer hashes that occur more than once, counted over all texts."""

    def count(part):
        core, n = np.unique(Paths(part, k, m).core, return_counts=True)
        return batch_of(core=core.view(np.int64), n=n.astype(np.int64)) if len(core) else None

    counted = map_texts(docs, "text", count, "core long, n long")
    return counted.groupBy("core").agg(F.sum("n").alias("n")).where("n > 1").select("core")


def kept_paths(part: Slice, k: int, m: int, holds) -> tuple[Paths, np.ndarray]:
    """Paths of a slice whose minimizer may be repeated, and their places."""
    paths = Paths(part, k, m)
    paths.take(holds.value.may_hold(paths.core))
    first = paths.begin - paths.words.first[paths.text]
    return paths, place(first, paths.size)


def tag(path, id, at):
    """What the bitmap of opened paths is keyed by; works on columns and arrays."""
    if isinstance(path, np.ndarray):
        return (path ^ id << 13 ^ at >> 7).view(np.uint64)
    return path.bitwiseXOR(F.shiftleft(id, 13)).bitwiseXOR(F.shiftright(at, 7))


#: A chain ends after a minimizer whose low bits are zero, so equal stretches are cut alike, or after so many paths.
CHAIN_END, CHAIN_MOST = np.uint64(7), 64


def chains_of(paths: Paths) -> tuple[np.ndarray, np.ndarray]:
    """(first path, number of paths) of each chain: two or more paths that follow each other, between two others.
    The outer ones of a stretch reach into what stands around it, which differs from copy to copy."""
    follows = np.zeros(len(paths.begin) + 1, bool)
    follows[1:-1] = (paths.text[1:] == paths.text[:-1]) & (paths.begin[1:] == (paths.begin + paths.size)[:-1])
    inner = follows[:-1] & follows[1:]
    new = inner.copy()
    new[1:] &= ~inner[:-1] | (paths.core[:-1] & CHAIN_END == 0)
    at = np.flatnonzero(inner)
    new[at] |= (at - np.flatnonzero(new)[np.cumsum(new)[at] - 1]) % CHAIN_MOST == 0
    head = np.flatnonzero(new)
    count = np.bincount(np.cumsum(new)[at] - 1, minlength=len(head))
    return head[count > 1], count[count > 1]


def candidate_paths(docs: DataFrame, k: int, m: int, holds) -> DataFrame:
    """id, th, core, path and at (`place` of the first word, and the number of edges) of paths and of chains. A chain
    has the core of its first path, and cores, paths and steps (their `at`, from its own first word) of all."""

    def emit(part):
        paths, at = kept_paths(part, k, m, holds)
        if not len(at):
            return None
        head, count = chains_of(paths)
        member, last = np.repeat(head, count) + ranges(count), head + count - 1
        alone = np.ones(len(at), bool)
        alone[member] = False
        rows = np.append(head, np.flatnonzero(alone))
        size = np.append(paths.begin[last] + paths.size[last] - paths.begin[head], paths.size[alone])
        hashes = paths.hash_of(1, np.append(size, paths.size[member]) + k - 1,
                               paths.begin[np.append(rows, member)]).view(np.int64)
        core, text = paths.core.view(np.int64), paths.text[rows]
        begin = at[rows] >> 20
        steps = place(paths.begin[member] - paths.begin[np.repeat(head, count)], paths.size[member])
        bounds = np.zeros(len(rows) + 1, np.int32)
        bounds[1:len(head) + 1] = count
        bounds = pa.array(np.cumsum(bounds, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (core[member], hashes[len(rows):], steps)]
        return batch_of(id=part.column("id")[text], th=part.column("th")[text], core=core[rows],
                        path=hashes[:len(rows)], at=place(begin, size), cores=lists[0], paths=lists[1], steps=lists[2])

    return map_texts(docs, "text", emit, "id long, th long, core long, path long, at long, "
                                         "cores array<long>, paths array<long>, steps array<long>")


def opened_chains(chains: DataFrame) -> DataFrame:
    """The paths of each chain's first occurrence, as rows of `candidate_paths`."""
    begin = F.col("first.at").bitwiseAND(F.lit(~0xFFFFF))
    return chains.select("first.id", "first.th", begin.alias("_begin"), F.inline(F.arrays_zip(
        F.col("chain.cores").alias("core"), F.col("chain.paths").alias("path"), F.col("chain.steps").alias("step")))
    ).select("id", "th", "core", "path", (F.col("_begin") + F.col("step")).alias("at"))


def edges_of(docs: DataFrame, k: int, m: int, holds, opened) -> DataFrame:
    """The edges of opened paths, each with its place; `holds` lets minimizers with several paths through. More than
    those do no harm: a further occurrence of a path is later than its first one in either comparison."""

    def emit(part):
        paths, at = kept_paths(part, k, m, holds)
        if not len(at):
            return None
        id = part.column("id")[paths.text]
        path = paths.hash_of(1, paths.size + k - 1, paths.begin).view(np.int64)
        mine = opened.value.may_hold(tag(path, id, at))
        paths.take(mine)
        id, at = id[mine], at[mine]
        size = paths.size
        step = ranges(size)
        edge = paths.hash_of(2, k, np.repeat(paths.begin, size) + step)
        return batch_of(id=np.repeat(id, size), th=np.repeat(part.column("th")[paths.text], size),
                        core=np.repeat(paths.core, size).view(np.int64),
                        edge=edge.view(np.int64), at=np.repeat(at & ~np.int64(0xFFFFF), size) + (step << 20) + k)

    return map_texts(docs, "text", emit, "id long, th long, core long, edge long, at long")


def later_places(rows: DataFrame, firsts: DataFrame, keys: list[str]) -> DataFrame:
    """Places after the first one with the same keys."""
    return rows.join(firsts.where("several").select(*keys, "first"), keys).where(
        F.struct("id", "th", "at") > F.col("first")).select("id", "th", "at")


def first_places(rows: DataFrame, keys: list[str], *same: Column) -> DataFrame:
    """keys, `first` (the first place), `several` (whether there is another one) and columns that follow the keys."""
    here = F.struct("id", "th", "at")
    return rows.groupBy(*keys).agg(F.min(here).alias("first"), F.max(here).alias("last"), *same).withColumn(
        "several", F.col("first") < F.col("last")).drop("last")


def repeated_spans(docs: DataFrame, k: int = 20, m: int = 8) -> DataFrame:
    """`id`, `th`, `begin`, `size` (words): spans whose every k-word window starts earlier somewhere else.

    docs: id, th (a mark of the text, so that texts sharing an id stay apart), text.
    """
    if not 0 < k - m < 1 << 10:
        raise ValueError("m must be below k")
    holds = filter_of(written(repeated_cores(docs, k, m)), "core")
    keys = ["core", "path"]
    found = written(candidate_paths(docs, k, m, holds))
    linked = found.where(F.size("cores") > 0)
    chains = written(first_places(linked, keys, F.first(F.struct("cores", "paths", "steps")).alias("chain")))
    # Later occurrences of a chain are repeated as a whole, and each of their paths also starts in the first one.
    rows = found.where(F.size("cores") == 0).select("id", "th", *keys, "at").unionByName(opened_chains(chains))
    paths = written(first_places(rows, keys))
    whole = written(later_places(linked, chains, keys)).unionByName(written(later_places(rows, paths, keys)))
    forks = written(paths.groupBy("core").count().where("count > 1").select("core"))
    opened = written(paths.select("core", tag(F.col("path"), F.col("first.id"), F.col("first.at")).alias("tag"))
                     .join(forks, "core", "left_semi").select("tag"))
    edges = written(edges_of(docs, k, m, filter_of(forks, "core"), filter_of(opened, "tag")))
    single = later_places(edges, written(first_places(edges, ["core", "edge"])), ["core", "edge"])
    begin, low = place_parts()
    return (whole.select("id", "th", begin, (low + F.lit(k - 1)).alias("size"))
            .unionByName(written(single).select("id", "th", begin, low.alias("size"))))


def kept_words(part: Slice) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words, removed words and the kept ones joined by one space, of each text with its `spans`."""
    words = part.words(PLAIN)
    gone = cover(part, words.first[:-1], len(words.start))
    stay, text_of = np.flatnonzero(~gone), words.text_of()
    joined, begin, end = words.joined(stay)
    bounds = np.searchsorted(stay, words.first)
    edges = [(begin[a], end[b - 1]) if b > a else (0, 0) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    removed = np.bincount(text_of[gone], minlength=part.n)
    return words.count, removed, [joined[a:b] for a, b in edges]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20,
                    m: int = 8) -> DataFrame:
    """All rows with all their columns; texts that lose words are their kept words, joined by one space, others
    stay as they are. A column n_chars follows the text."""
    spans = repeated_spans(texts_of(docs, id_col, text_col), k, m)
    listed = spans.groupBy("id", "th").agg(F.collect_set(F.struct("begin", "size")).alias(SPANS))
    rows = marked(docs, id_col, text_col).join(
        listed.withColumnsRenamed({"id": ID, "th": MARK}), [ID, MARK], "left")
    kept = text_udf(lambda part: pa.array(kept_words(part)[2], pa.binary()).cast(pa.string()), "string", "spans")
    text = F.when(F.col(SPANS).isNull(), F.col(text_col)).otherwise(kept(F.col(text_col), F.col(SPANS)))
    new = {text_col: text} | ({"n_chars": F.when(F.col(SPANS).isNull(), F.col("n_chars")).otherwise(
        F.length(text).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return arrow_batches(rows).withColumns(new).select(docs.columns)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20,
                    m: int = 8, texts: bool = False) -> DataFrame:
    """`id_col`, n_words, n_removed, kept_sha256 of every text, and `kept` (the remaining text) if asked for.

    A word goes if a window of k words around it also starts earlier: in a text with a smaller id, or before
    in the same text. Windows are judged on the input. Words are cut at white space and unchanged; kept words
    are joined by one space. Null texts and texts without words have no words and the digest of nothing. Rows
    stay as many as they are: wholly repeated rows are one text, seen once; different texts with one id are
    ordered by a hash of the text; a null id comes before all others. Other columns are left behind.
    """
    base = texts_of(docs, id_col, text_col)
    joined = with_spans(base, repeated_spans(base, k, m))

    def digest(part):
        count, removed, kept = kept_words(part)
        out = {"id": part.batch.column("id"), "n_words": count, "n_removed": removed,
               "kept_sha256": [hashlib.sha256(t).hexdigest() for t in kept]}
        if texts:
            out["kept"] = pa.array(kept, pa.binary()).cast(pa.string())
        return batch_of(**out)

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    out = map_texts(joined.select("id", "text", "spans"), "text", digest, schema)
    return out.select(shown().alias(id_col), *out.columns[1:])
