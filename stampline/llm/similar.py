"""Near-duplicates by the Jaccard similarity of word shingles, found by anchor-point covering of several SimHashes.

A text has `PRINTS` fingerprints of 64 bits, each the majority bits of its distinct shingles under another hash. One
fingerprint after the other is covered by anchors (`simhash.Cover`); texts that meet at an anchor and whose prints
together differ in at most `DIFFER` bits are candidates, except those that cannot be similar: texts carry the parity of
their shingles on 256 places, and sets that differ in d shingles differ in at most d parities. An anchor does not pass
on all its candidate pairs but a spanning forest of the closest ones, so a large group of copies costs a few pairs a
member; each pair is checked on its exact shingle sets. A forest may leave out a similar pair whose way over a third text
then fails the check, so the texts with candidates meet once more: all candidate pairs between the groups found so far
are checked as well.

Texts with equal prints (256 bits) count as one. Texts of fewer than k words have one shingle, all their words; texts
without words have none and are one group. Long texts carry 8 bytes a word into the check, one pair at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampline.llm.components import components
from stampline.llm.simhash import HOMES, PAIRS, Cover, majority_bits, shingle_hashes
from stampline.llm.texts import ID, MARK, bitmap, map_texts, marked, mix, ranges, texts_of, written
from stampline.session import pinned

#: Fingerprints of a text, and bits of all of them in which candidates may differ: at 0.8 some 39 do, 64 hardly ever.
PRINTS, DIFFER = 4, 64
#: 64-bit words of parities.
ODD = 4
_SALT = 0x9E3779B97F4A7C15


def shingle_sets(part, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after another, and their numbers."""
    hashes, counts = shingle_hashes(part, k, seed)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(counts))


def parities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The number of shingles of each text, and ODD words: a bit is 1 if an odd number of shingles falls on its place."""
    place = mix(hashes + np.uint64(_SALT * PRINTS % (1 << 64))) >> np.uint64(64 - (64 * ODD).bit_length() + 1)
    words = np.zeros((len(counts), 1 + ODD), np.uint64)
    words[:, 0] = counts
    owner = np.repeat(np.arange(len(counts)), counts)
    np.bitwise_xor.at(words, (owner, 1 + (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    return words


def may_be_similar(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether pairs of texts with `parities` x and y may reach a Jaccard similarity of `least`; never false if they do."""
    n, m = x[:, 0].astype(np.int64), y[:, 0].astype(np.int64)
    apart = np.maximum(np.bitwise_count(x[:, 1:] ^ y[:, 1:]).sum(axis=1, dtype=np.int64), np.abs(n - m))
    return apart * (1 + least) <= (n + m) * (1 - least) + 1e-6


def prints_of(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """id, th, `prints`, the fingerprints as a list, and `odd`, the `parities`. docs: id, th, text."""

    def digest(part):
        hashes, counts = shingle_sets(part, k, seed)
        made = [majority_bits(mix(hashes + np.uint64(_SALT * i % (1 << 64))) if i else hashes, counts) for i in range(PRINTS)]
        flat = np.stack(made, axis=1).view(np.int64).ravel()
        lists = [pa.ListArray.from_arrays(np.arange(part.n + 1, dtype=np.int32) * width, values) for width, values in
                 ((PRINTS, flat), (1 + ODD, parities(hashes, counts).view(np.int64).ravel()))]
        return pa.RecordBatch.from_arrays([part.batch.column("id"), part.batch.column("th"), *lists],
                                          names=["id", "th", "prints", "odd"])

    return map_texts(docs, "text", digest, "id long, th long, prints array<long>, odd array<long>")


def closest_forest(ia: np.ndarray, ib: np.ndarray, distance: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the edges of a spanning forest of least distances over nodes 0..n-1 (Boruvka's rounds)."""
    key = distance.astype(np.int64) << 40 | np.arange(len(ia))
    label, kept, none = np.arange(n), [], np.iinfo(np.int64).max
    left = np.arange(len(ia))
    while len(left):
        la, lb = label[ia[left]], label[ib[left]]
        other = la != lb
        left, la, lb = left[other], la[other], lb[other]
        if not len(left):
            break
        best = np.full(n, none)
        np.minimum.at(best, la, key[left])
        np.minimum.at(best, lb, key[left])
        chosen = np.unique(best[best < none]) & ((1 << 40) - 1)
        kept.append(chosen)
        while True:
            la, lb = label[ia[chosen]], label[ib[chosen]]
            if (la == lb).all():
                break
            low = np.minimum(la, lb)
            for side in (la, lb):
                np.minimum.at(label, side, low)
            while (label[label] != label).any():
                label = label[label]
    return np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)


def _candidates(batches, differ: int, apart: bool, least: float | None):
    """Closest pairs of homes (role 0, first in each key) and all that came, or all pairs of different groups if
    `apart`, of these only such as may reach `least` where it is given; sorted batches."""
    names = ("key", "node", "group") if apart else ("key", "node")
    lists = {"prints": PRINTS} if least is None else {"odd": 1 + ODD, "prints": PRINTS}

    def columns(batch):
        flat = (batch.column(n).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1) for n in lists)
        return [*(batch.column(n).to_numpy() for n in names), *flat]

    kept = [*(np.zeros(0, np.int64) for _ in names), *(np.zeros((0, w), np.uint64) for w in lists.values())]
    for batch in batches:
        if not batch.num_rows:
            continue
        home = batch.column("role").to_numpy() == 0
        rows = columns(batch)
        homes = [np.concatenate([old, new[home]]) for old, new in zip(kept, rows)]
        key, node, *more, prints = (c[~home] for c in rows)
        low, high = np.searchsorted(homes[0], key), np.searchsorted(homes[0], key, "right")
        total, begin, found = np.cumsum(high - low), 0, []
        while begin < len(key):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + PAIRS // PRINTS, "right")))
            counts = (high - low)[begin:end]
            i = np.repeat(np.arange(begin, end), counts)
            j = np.repeat(low[begin:end], counts) + ranges(counts)
            # Both ways: one text may lie around the other's home and not the other way round.
            other = more[0][i] != homes[2][j] if apart else node[i] != homes[1][j]
            i, j = i[other], j[other]
            distance = np.bitwise_count(prints[i] ^ homes[-1][j]).sum(axis=1)
            near = np.flatnonzero(distance <= differ)
            if least is not None:
                near = near[may_be_similar(more[-1][i[near]], homes[-2][j[near]], least)]
            if apart and len(near):
                x, y = node[i[near]], homes[1][j[near]]
                met = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(met[0]), pa.array(met[1])], names=["a", "b"])
            elif len(near):
                i, j, distance = i[near], j[near], distance[near]
                known, at = np.unique(np.concatenate([node[begin:end], homes[1][j.min():j.max() + 1]]), return_inverse=True)
                keep = closest_forest(at[i - begin], at[end - begin + j - j.min()], distance, len(known))
                found.append((node[i][keep], homes[1][j][keep], distance[keep]))
            begin = end
        if found:
            a, b, distance = (np.concatenate(c) for c in zip(*found))
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            keep = closest_forest(at[:len(a)], at[len(a):], distance, len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], names=["a", "b"])
        last = homes[0] == key[-1] if len(key) else homes[0] == rows[0][-1]
        kept = [c[last] for c in homes]


def candidate_pairs(nodes: DataFrame, which: int, differ: int = DIFFER, apart: bool = False,
                    least: float | None = None) -> DataFrame:
    """Distinct pairs `a`, `b` of nodes (node, prints) that meet at an anchor of fingerprint `which`: of each task's
    anchors a spanning forest of the closest, or all pairs with different values of `group` if `apart`. With `least`,
    only pairs that may be as similar by the nodes' `odd`."""
    cover = Cover(3, 3)
    cols = ["node", *(["group"] if apart else []), *(["odd"] if least is not None else []), "prints"]

    def print_of(batch):
        return batch.column("prints").flatten().to_numpy().reshape(batch.num_rows, -1)[:, which].view(np.uint64)

    def home_rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(cover.homes(print_of(batch)).ravel())], names=["anchor"])

    crowded = (nodes.select("prints").mapInArrow(home_rows, "anchor long").groupBy("anchor").count()
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
        def out(batch, key, role, i):
            taken = batch.select(cols).take(pa.array(i))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(i), role, np.int8)), *taken.columns],
                                              names=["key", "role", *cols])

        for batch in batches:
            if not batch.num_rows:
                continue
            fp, node = print_of(batch), batch.column("node").to_numpy().view(np.uint64)
            for home in cover.homes(fp):
                piece = (mix(node) % slices_of(home).astype(np.uint64)).astype(np.int64)
                yield out(batch, piece << 44 | home, 0, np.arange(len(fp)))
            for anchor, i in cover.around(fp):
                n = slices_of(anchor)
                yield out(batch, ranges(n) << 44 | np.repeat(anchor, n), 1, np.repeat(i, n))

    dealt = nodes.select(*cols).mapInArrow(
        rows, f"key long, role byte, node long, {'group long, ' * apart}{'odd array<long>, ' * (least is not None)}prints array<long>")
    return (dealt.repartition("key").sortWithinPartitions("key", "role")
            .mapInArrow(lambda batches: _candidates(batches, differ, apart, least), "a long, b long").distinct())


def _jaccard(batches, least: float):
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist())):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= least * (len(x) + len(y) - both):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def similar_pairs(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, seed: int, least: float) -> DataFrame:
    """The pairs whose texts have shingle sets of a Jaccard similarity of at least `least`.

    Only texts of nodes in some pair are cut into shingles and shuffled: a bitmap of them is asked first.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    chosen = nodes.join(wanted, "node").select("node", F.xxhash64("id", "node").alias("row"))
    bits = bitmap(chosen, "row")

    def sets(part):
        at = np.flatnonzero(bits.value.may_hold(part.column("row").view(np.uint64)))
        if not len(at):
            return None
        hashes, counts = shingle_sets(part, k, seed)
        bounds = np.append(0, np.cumsum(counts))
        made = [hashes[bounds[i]:bounds[i + 1]].tobytes() for i in at]
        return pa.RecordBatch.from_arrays([part.batch.column("th").take(pa.array(at)), pa.array(made, pa.binary())],
                                          names=["node", "sh"])

    held = map_texts(texts.withColumn("row", F.xxhash64("id", "th")), "text", sets, "node long, sh binary")
    held = held.join(chosen.select("node"), "node", "left_semi").groupBy("node").agg(F.first("sh").alias("sh"))
    x = held.select(F.col("node").alias("a"), F.col("sh").alias("xs"))
    y = held.select(F.col("node").alias("b"), F.col("sh").alias("ys"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "xs", "ys") \
        .mapInArrow(lambda batches: _jaccard(batches, least), "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8,
                   seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(id, th, prints) of every row, and (prints, id, node, odd, group): the smallest row of each kind of text, and the
    group of kinds, named by one of them, that pairs of at least `least` connect."""
    texts = texts_of(docs, id_col, text_col)
    rows = written(prints_of(texts, k, seed))
    kinds = written(rows.groupBy("prints").agg(F.min(F.struct("id", "th", "odd")).alias("first")).select(
        "prints", F.col("first.id").alias("id"), F.col("first.th").alias("node"), F.col("first.odd").alias("odd")))
    rows = rows.drop("odd")

    def met(nodes: DataFrame, apart: bool) -> DataFrame:
        pairs = None
        for which in range(PRINTS):  # one after another: the replicas of one fingerprint are on disk at a time
            found = written(candidate_pairs(nodes, which, apart=apart, least=least))
            pairs = found if pairs is None else pairs.unionByName(found)
        return pairs.distinct()

    def grouped(links: DataFrame) -> DataFrame:
        roots = components(links, "a", "b")
        return written(kinds.join(roots, kinds["node"] == roots["node"], "left").select(
            kinds["*"], F.coalesce("root", kinds["node"]).alias("group")))

    near = pinned(met(kinds, False))
    links = written(similar_pairs(near, kinds, texts, k, seed, least))
    # A forest leaves no text without a pair that has candidates at all, so only texts with a pair meet again.
    paired = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    rest = pinned(met(written(grouped(links).join(paired, "node", "left_semi")), True).join(near, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return rows, grouped(links)
    return rows, grouped(written(links.unionByName(similar_pairs(rest, kinds, texts, k, seed, least))))


def keep_first_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                       least: float = 0.8, seed: int = 42) -> DataFrame:
    """One row of each group of near-duplicates with all its columns: that of the smallest id (then of the smallest
    mark of its text); of wholly repeated rows one stays. Null texts and those without words are one group."""
    _, nodes = similar_groups(docs, id_col, text_col, k, least, seed)
    chosen = pinned(nodes.groupBy("group").agg(F.min(F.struct("id", "node")).alias("first")).select(
        F.col("first.id").alias(ID), F.col("first.node").alias(MARK)))
    kept = marked(docs, id_col, text_col).join(chosen, [ID, MARK], "left_semi")
    return kept.dropDuplicates([ID, MARK]).select(docs.columns)
