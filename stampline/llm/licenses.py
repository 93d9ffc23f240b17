"""License scans by an exact set-similarity join.

A block is as many consecutive words of a text as a template has, line breaks or not, as the set of its words; every
start gives one, and a text of fewer words is one block. A template is in a block if at least `threshold` of the
template's words are. Tokens are ordered by how often they occur in all texts, rare ones first: of a template T with
least overlap a = ceil(threshold |T|), every such block holds a token among the first |T| - a + 1, so blocks and
templates of one size are joined on those prefix tokens. The length filter asks for a template words in the block, the
positional filter bounds the overlap by what stands before and after the shared token in both orders, and what is left
is counted exactly. Where a template fits inside a place that another one fits whose words include all of its own, the
larger one counts there alone.

Templates are a declared list; of a block only the words that occur in some template take part. Phrases
(consecutive words) give the base labels, templates add their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stampline.llm.texts import ALNUM, Slice, Words, batch_of, keyed, map_texts, ranges, shown, written

#: Phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Templates and their labels: how a text states a license, and how its header begins (fixed values).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("mit-notice", "released under the mit license"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in "
                   "compliance with the license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                   "general public license as published by the free software foundation"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                   "associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
THRESHOLD = 0.9
#: Numbers in the matrix of blocks that a task holds at once.
CELLS = 1 << 20


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    words = Slice(batch_of(text=pa.array(texts, pa.string())), "text").words(ALNUM, lower=True)
    return np.split(words.hashes(), words.first[1:-1])


class Vocabulary:
    """Hashes of the words of all templates, sorted; a word's token is its place here."""

    def __init__(self, templates: list[str]):
        split = word_hashes(templates)
        self.size = [len(h) for h in split]
        self.of_template = [np.unique(h) for h in split]
        self.hashes = np.unique(np.concatenate([*self.of_template, np.zeros(0, np.uint64)]))

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Token of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each token occurs in all texts."""

    def count(part: Slice):
        token = vocabulary.tokens(part.words(ALNUM, lower=True).hashes())
        n = np.bincount(token[token >= 0])
        some = np.flatnonzero(n)
        return batch_of(token=some, n=n[some]) if len(some) else None

    got = map_texts(docs, "text", count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary.hashes), np.int64)
    out[got.column("token").to_numpy()] = got.column("n").to_numpy()
    return out


def blocks_of(words: Words, ranks: np.ndarray, size: int, least: int, prefix: np.ndarray):
    """(text, start, ranks in order, how many) of the blocks of `size` words with `least` template words, one of them
    in `prefix`. ranks: of each word, -1 if in no template."""
    counts = np.where(words.count >= size, words.count - size + 1, np.minimum(words.count, 1))
    text = np.repeat(np.arange(len(counts)), counts)
    start = words.first[text] + ranges(counts)
    held = np.append(0, np.cumsum(ranks >= 0))
    some = held[np.minimum(start + size, words.first[text + 1])] - held[start] >= least
    text, start = text[some], start[some]
    out = []
    for i in range(0, len(start), max(1, CELLS // size)):
        t, s = text[i:i + CELLS // size], start[i:i + CELLS // size]
        at = s[:, None] + np.arange(size)
        inside = at < words.first[t + 1][:, None]
        found = np.sort(np.where(inside, ranks[np.minimum(at, len(ranks) - 1)], -1), axis=1)
        new = found >= 0
        new[:, 1:] &= found[:, 1:] != found[:, :-1]
        keep = (new.sum(axis=1) >= least) & (new & prefix[found]).any(axis=1)
        out.append((t[keep], s[keep] - words.first[t[keep]], found[keep][new[keep]], new[keep].sum(axis=1)))
    none = np.zeros(0, np.int64)
    return [np.concatenate(c) for c in zip(*out)] if out else [none] * 4


def scanned(docs: DataFrame, vocabulary: Vocabulary, rank: np.ndarray, sizes: dict[int, tuple[int, np.ndarray]],
            phrases: dict[str, str]) -> DataFrame:
    """One row per text: id, n_words, n_base, first_word, last_word, base (labels), and blocks (size, start, and the
    ranks of their template words, in order). sizes: of each template size the least overlap and the prefix tokens."""
    targets = list(zip(word_hashes(list(phrases)), phrases.values())) if phrases else []

    def scan(part: Slice):
        words = part.words(ALNUM, lower=True)
        hashes, text_of = words.hashes(), words.text_of()
        places, labels = [], []
        for wanted, label in targets:
            k = len(wanted)
            at = np.flatnonzero(hashes[:max(0, len(hashes) - k + 1)] == wanted[0])
            for i in range(1, k):
                at = at[hashes[at + i] == wanted[i]]
            at = at[text_of[at] == text_of[at + k - 1]]
            places.append(at)
            labels += [label] * len(at)
        at = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
        text = text_of[at]
        n_base = np.bincount(text, minlength=part.n)
        first, last = np.full(part.n, 1 << 62), np.full(part.n, -1)
        np.minimum.at(first, text, at - words.first[text])
        np.maximum.at(last, text, at - words.first[text])
        base = [set() for _ in range(part.n)]
        for t, label in zip(text.tolist(), labels):
            base[t].add(label)

        token = vocabulary.tokens(hashes)
        ranks = np.append(rank, -1)[token]
        found = [(size, *blocks_of(words, ranks, size, least, prefix)) for size, (least, prefix) in sizes.items()]
        none = np.zeros(0, np.int64)
        text, start, flat, length = (np.concatenate([none, *(f[i] for f in found)]) for i in range(1, 5))
        size = np.repeat([0, *(f[0] for f in found)], [0, *(len(f[1]) for f in found)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)),
                                         pa.array(flat.astype(np.int32)))
        order = np.argsort(text, kind="stable")
        made = pa.StructArray.from_arrays([pa.array(size.astype(np.int32)), pa.array(start), lists],
                                          names=["size", "start", "ranks"]).take(pa.array(order))
        bounds = np.searchsorted(text[order], np.arange(part.n + 1))
        return batch_of(
            id=part.batch.column("id"), n_words=words.count.astype(np.int64), n_base=n_base.astype(np.int64),
            first_word=pa.array(first, mask=n_base == 0), last_word=pa.array(last, mask=n_base == 0),
            base=pa.array([sorted(b) for b in base], pa.list_(pa.string())),
            blocks=pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), made))

    return map_texts(docs, "text", scan, "id long, n_words long, n_base long, first_word long, last_word long, "
                                         "base array<string>, blocks array<struct<size int, start long, ranks array<int>>>")


def largest_fits(fits: DataFrame, larger: list[tuple[int, int]]) -> DataFrame:
    """fits (row, start, end, template, ...) without those inside a fit of a larger template; larger: pairs of a
    template and one with all its words and more. A sorted sweep per text and pair carries the furthest end."""
    if not larger:
        return fits
    pairs = F.broadcast(fits.sparkSession.createDataFrame(
        [(t, a, b, t == b) for a, b in larger for t in (a, b)], "template int, a int, b int, large boolean"))
    sweep = Window.partitionBy("row", "a", "b").orderBy("start", F.desc("large")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = (fits.select("row", "start", "end", "template").join(pairs, "template")
              .withColumn("reach", F.max(F.when(F.col("large"), F.col("end"))).over(sweep))
              .where("not large and reach >= end").select("row", "start", "template"))
    return fits.join(inside, ["row", "start", "template"], "left_anti")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
                 phrases: dict[str, str] = PHRASES) -> DataFrame:
    """`id_col`, n_words, n_base, first_word, last_word, base_labels, labels, score of every text.

    Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased. n_base counts places
    of all phrases, first_word and last_word are their smallest and largest start. `labels` are the base labels
    and those of every template that fits some block, but for fits inside that of a larger template. score: 1 with
    a base label, else the largest share of a template's words in a block (of those at the threshold), else 0.
    Labels are distinct, sorted and comma-joined. Null texts are empty. Rows stay as many as they are; other columns
    are left behind. Templates without words are left out.
    """
    templates = [t for t, h in zip(templates, word_hashes([t for _, t in templates])) if len(h)] if templates else []
    vocabulary = Vocabulary([t for _, t in templates])
    base = keyed(docs, id_col, text_col)
    counts = token_counts(base, vocabulary)
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort([np.arange(len(counts)), counts])] = np.arange(len(counts))
    sizes: dict[int, tuple[int, np.ndarray]] = {}
    rows = []
    for number, ((label, _), size, hashes) in enumerate(zip(templates, vocabulary.size, vocabulary.of_template)):
        ranks = np.sort(rank[vocabulary.tokens(hashes)]).tolist()
        least = max(1, math.ceil(threshold * len(ranks) - 1e-9))
        lowest, prefix = sizes.get(size, (least, np.zeros(len(counts), bool)))
        prefix[ranks[:len(ranks) - least + 1]] = True
        sizes[size] = min(lowest, least), prefix
        rows += [(size, r, i, number, label, ranks, least) for i, r in enumerate(ranks[:len(ranks) - least + 1])]
    sets = [set(h.tolist()) for h in vocabulary.of_template]
    larger = [(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if x < y]
    wanted = docs.sparkSession.createDataFrame(
        rows, "size int, token int, i int, template int, label string, wanted array<int>, least int")
    texts = written(scanned(base, vocabulary, rank, sizes, phrases).withColumn("row", F.monotonically_increasing_id()))
    probes = (texts.select("row", F.explode("blocks").alias("block")).select("row", "block.*")
              .select("row", "size", "start", "ranks", F.posexplode("ranks").alias("j", "token")))
    before, after = F.least("i", "j"), F.least(F.size("wanted") - 1 - F.col("i"), F.size("ranks") - 1 - F.col("j"))
    fits = (probes.join(wanted, ["size", "token"])
            .where((F.size("ranks") >= F.col("least")) & (before + 1 + after >= F.col("least")))
            .withColumn("overlap", F.size(F.array_intersect("ranks", "wanted"))).where("overlap >= least")
            .select("row", "start", (F.col("start") + F.col("size")).alias("end"), "template", "label",
                    (F.col("overlap") / F.size("wanted")).alias("share")).distinct())
    found = largest_fits(fits, larger).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share"))
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return texts.join(found, "row", "left").select(
        shown().alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
