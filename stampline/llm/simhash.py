"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits within `radius` bits of each other agree, on one of `blocks` parts, up to
t = radius // blocks bits. On each part the anchors are a covering code: the Hamming code on 15 bits, all
words on the rest, covering radius 1. The anchor nearest to x lies within 1 of x and within 1 + t of any y
that is within t of x. So every distinct fingerprint is replicated to all anchors within 1 + t, is at home at
its nearest one, and each anchor compares its homes with all that came to it.

Copies share a fingerprint and are one row here. An anchor with many homes is cut into slices of homes, each
with its own copy of the replicas. An anchor passes on a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampline.llm.components import components
from stampline.llm.texts import ID, MARK, PLAIN, batch_of, map_texts, marked, mix, ranges, shown, texts_of
from stampline.session import pinned

#: Homes of one anchor that one slice compares.
HOMES = 4096
#: Pairs compared at once in a task.
PAIRS = 1 << 20
_CODE = 15


def shingle_hashes(part, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every k-word shingle (all words of a text that has fewer), and how many each text has."""
    words = part.words(PLAIN, lower=True)
    joined, begins, ends = words.joined()
    counts = np.where(words.count >= k, words.count - k + 1, np.minimum(words.count, 1))
    first = np.repeat(words.first[:-1], counts) + ranges(counts)
    last = np.minimum(first + k, np.repeat(words.first[1:], counts)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[b:e], seed) for b, e in zip(begins[first].tolist(), ends[last].tolist())]
    return np.array(hashes, np.uint64), counts


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text, the bits set in over half of its hashes; zero for a text without any."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        sums = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        over = (2 * sums > counts[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """id, th and `fp`, the fingerprint as a signed long. docs: id, th, text."""

    def digest(part):
        return batch_of(id=part.batch.column("id"), th=part.batch.column("th"),
                        fp=majority_bits(*shingle_hashes(part, k, seed)).view(np.int64))

    return map_texts(docs, "text", digest, "id long, th long, fp long")


class Cover:
    """Anchors around the parts of a fingerprint."""

    def __init__(self, radius: int, blocks: int):
        reach = 1 + radius // blocks
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        self.parts = list(zip(cuts, np.diff(cuts).tolist()))
        place = np.arange(1 << _CODE)
        self.syndrome = np.zeros(1 << _CODE, np.int64)
        for i in range(_CODE):
            self.syndrome ^= np.where(place >> i & 1, i + 1, 0)
        self.patterns = {n: self._patterns(n, reach) for n in {n for _, n in self.parts}}

    @staticmethod
    def _patterns(n: int, reach: int) -> list[np.ndarray]:
        """By syndrome: what to xor to a part of n bits to get each anchor within reach."""
        flips = lambda bits, w: [sum(1 << b for b in c) for c in combinations(bits, w)]
        found: list[list[int]] = [[] for _ in range(_CODE + 1)]
        for w in range(reach + 1):
            for c in combinations(range(_CODE), w):
                syndrome = 0
                for b in c:
                    syndrome ^= b + 1
                for rest in range(reach - w + 1):
                    found[syndrome] += [sum(1 << b for b in c) | r for r in flips(range(_CODE, n), rest)]
        return [np.array(f, np.int64) for f in found]

    def homes(self, fp: np.ndarray) -> np.ndarray:
        """The nearest anchor on each part: an array of (parts, fingerprints)."""
        out = []
        for i, (shift, n) in enumerate(self.parts):
            v = (fp >> np.uint64(shift)).astype(np.int64) & ((1 << n) - 1)
            s = self.syndrome[v & ((1 << _CODE) - 1)]
            out.append(i << 40 | v ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0))
        return np.array(out)

    def around(self, fp: np.ndarray):
        """(anchors, index of the fingerprint) for everything within reach, part by part and syndrome."""
        for i, (shift, n) in enumerate(self.parts):
            v = (fp >> np.uint64(shift)).astype(np.int64) & ((1 << n) - 1)
            syndrome = self.syndrome[v & ((1 << _CODE) - 1)]
            for s, patterns in enumerate(self.patterns[n]):
                mine = np.flatnonzero(syndrome == s)
                if len(mine) and len(patterns):
                    yield (i << 40 | v[mine, None] ^ patterns).ravel(), np.repeat(mine, len(patterns))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same components with at most one per node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib, label = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        la, lb = label[ia], label[ib]
        if (la == lb).all():
            break
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[tied], nodes[label[tied]]


def anchor_links(batches, radius: int):
    """Links of homes (role 0, first in each key) with all (role 1) that came to the key; sorted batches."""
    key_kept, fp_kept = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        key, role, fp = (batch.column(i).to_numpy() for i in range(3))
        if not len(key):
            continue
        fp = fp.view(np.uint64)
        home = role == 0
        home_key = np.concatenate([key_kept, key[home]])
        home_fp = np.concatenate([fp_kept, fp[home]])
        some_key, some_fp = key[~home], fp[~home]
        low, high = np.searchsorted(home_key, some_key), np.searchsorted(home_key, some_key, "right")
        total, begin, found = np.cumsum(high - low), 0, []
        while begin < len(some_key):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + PAIRS, "right")))
            counts = (high - low)[begin:end]
            x = np.repeat(some_fp[begin:end], counts)
            y = home_fp[np.repeat(low[begin:end], counts) + ranges(counts)]
            near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
            if near.any():
                found.append(forest(x[near], y[near]))
            begin = end
        if found:
            a, b = forest(*(np.concatenate(side) for side in zip(*found)))
            yield batch_of(a=a.view(np.int64), b=b.view(np.int64))
        last = home_key == key[-1]
        key_kept, fp_kept = home_key[last], home_fp[last]


def near_links(distinct: DataFrame, radius: int = 4, blocks: int = 3) -> DataFrame:
    """Edges `a`, `b` between distinct fingerprints (column fp) that join exactly those linked by `radius`."""
    cover = Cover(radius, blocks)

    def home_rows(batches):
        for batch in batches:
            yield batch_of(anchor=cover.homes(batch.column(0).to_numpy().view(np.uint64)).ravel())

    crowded = (distinct.select("fp").mapInArrow(home_rows, "anchor long").groupBy("anchor").count()
               .where(F.col("count") > HOMES).toArrow())  # at most the anchors of the code
    order = np.argsort(crowded.column("anchor").to_numpy())
    hot = crowded.column("anchor").to_numpy()[order]
    cuts = -(-crowded.column("count").to_numpy()[order] // HOMES)

    def slices_of(anchor):
        if not len(hot):
            return np.ones(len(anchor), np.int64)
        i = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
        return np.where(hot[i] == anchor, cuts[i], 1)

    def rows(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for home in cover.homes(fp):
                piece = (mix(fp) % slices_of(home).astype(np.uint64)).astype(np.int64)
                yield batch_of(key=piece << 44 | home, role=np.zeros(len(fp), np.int8), fp=fp.view(np.int64))
            for anchor, i in cover.around(fp):
                n = slices_of(anchor)
                yield batch_of(key=ranges(n) << 44 | np.repeat(anchor, n), role=np.ones(n.sum(), np.int8),
                               fp=np.repeat(fp[i], n).view(np.int64))

    dealt = distinct.select("fp").mapInArrow(rows, "key long, role byte, fp long")
    return (dealt.repartition("key").sortWithinPartitions("key", "role")
            .mapInArrow(lambda batches: anchor_links(batches, radius), "a long, b long"))


def grouped(docs: DataFrame, id_col: str, text_col: str, k: int, radius: int, blocks: int,
            seed: int) -> tuple[DataFrame, DataFrame]:
    """(id, th, fp) of every row, and (fp, root) with the component of every distinct fingerprint."""
    prints = pinned(fingerprints(texts_of(docs, id_col, text_col), k, seed))
    distinct = pinned(prints.select("fp").distinct())
    roots = components(near_links(distinct, radius, blocks), "a", "b")
    return prints, pinned(distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                    radius: int = 4, blocks: int = 3, seed: int = 42) -> DataFrame:
    """`id_col`, fingerprint (16 hex digits), component_id (smallest id in the component, itself included).

    Texts are lower-cased (A-Z), cut at white space and shingled by k words; null texts and texts without
    words have fingerprint zero and link like any other. One row per input row; repeated rows repeat. A null
    id stays null and is never a component_id unless all ids of the component are null. blocks: more parts
    mean fewer rows, larger anchors; radius // blocks of 0 or 1 is usual.
    """
    prints, rooted = grouped(docs, id_col, text_col, k, radius, blocks, seed)
    least = pinned(prints.groupBy("fp").agg(F.min(shown()).alias("least"))).join(rooted, "fp")
    lowest = pinned(least.groupBy("root").agg(F.min("least").alias("component_id")))
    named = pinned(rooted.join(lowest, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(
        shown().alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4,
               blocks: int = 3, seed: int = 42) -> DataFrame:
    """One row of each component with all its columns: that of the smallest id (then of the smallest mark of its
    text); of wholly repeated rows one stays."""
    prints, rooted = grouped(docs, id_col, text_col, k, radius, blocks, seed)
    first = F.min(F.struct("id", "th"))
    chosen = pinned(prints.groupBy("fp").agg(first.alias("first"))).join(rooted, "fp").groupBy("root").agg(
        F.min("first").alias("first")).select(F.col("first.id").alias(ID), F.col("first.th").alias(MARK))
    kept = marked(docs, id_col, text_col).join(pinned(chosen), [ID, MARK], "left_semi")
    return kept.dropDuplicates([ID, MARK]).select(docs.columns)
