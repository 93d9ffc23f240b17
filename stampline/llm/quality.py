"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

Tokens are words and runs of marks. A text is the mean of its hashed n-grams: tokens, pairs of tokens, and pairs
of token shapes (kind, case, length); a token that repeats the one before it is one shape of its own. Training
runs on shards of a bounded labelled sample, each task making FTRL passes over its shard, and the weights of
the shards are averaged. A score is the sparse dot product of a text with the weights, through the sigmoid.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampline.llm.rules import labelled_sample
from stampline.llm.texts import (ALNUM, LOWER, Rolling, Slice, arrow_batches, batch_of, byte_values, keyed, map_texts,
                                 mix, shown, slices, text_udf)

#: Labelled texts that the classifier is trained on at most.
SAMPLE = 20_000
#: Weights.
LOG_SIZE = 18
SHARDS = 4
_WORD = ALNUM | np.isin(np.arange(256), list(range(0x41, 0x5B)))
_KIND = np.where(_WORD, 1, 2)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND = _KIND.astype(np.int8)
_CAPITAL = np.isin(np.arange(256), list(range(0x41, 0x5B)))


def hashed_ngrams(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of all texts in turn, and how many each text has."""
    buf, at = part.buf, part.at
    kind = _KIND[buf]
    change = np.ones(len(buf), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[at[:-1][at[1:] > at[:-1]]] = True
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], len(buf))[:len(begin)]
    word = kind[begin] > 0
    begin, end = begin[word], end[word]
    first = np.searchsorted(begin, at)
    text = np.repeat(np.arange(part.n), np.diff(first))
    size = end - begin
    token = mix(Rolling(byte_values(0)[LOWER[buf]], 0).of(begin, end) + size.astype(np.uint64))
    capitals = np.append(0, np.cumsum(_CAPITAL[buf]))
    upper = capitals[end] - capitals[begin]
    shape = (kind[begin] + 3 * np.minimum(upper, 2) + 9 * (upper == size) + 18 * np.minimum(size, 3)).astype(np.uint64)
    pair = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
    same = token[pair] == token[pair + 1]
    shape[pair[same] + 1] += np.uint64(100)
    tokens = token ^ np.uint64(1)
    pairs = mix(token[pair] * np.uint64(3) + token[pair + 1])
    shapes = mix(shape[pair] * np.uint64(1000) + shape[pair + 1] + np.uint64(1 << 40))
    slots = (np.concatenate([tokens, pairs, shapes]) >> np.uint64(64 - LOG_SIZE)).astype(np.int32)
    owner = np.concatenate([text, text[pair], text[pair]])
    order = np.argsort(owner, kind="stable")
    return slots[order], np.bincount(owner, minlength=part.n)


class Ftrl:
    """FTRL-proximal logistic regression over sparse rows."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last weight is the bias
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1)
                        / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


#: The share of an n-gram times this is its value.
SCALE = 10.0


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def train(sample: DataFrame, passes: int = 10) -> Model:
    """Averaged weights of FTRL on each shard of `sample` (id, text, y). Without rows all scores are 0.5."""
    size = 1 << LOG_SIZE

    def fit(batches):
        rows = []
        for batch in batches:
            for part in slices([batch], "text"):
                slots, counts = hashed_ngrams(part)
                y = part.column("y")
                for i, s in enumerate(np.split(slots, np.cumsum(counts)[:-1])):
                    at, n = np.unique(s, return_counts=True)
                    rows.append((np.append(at, size).astype(np.int32),
                                 np.append(SCALE * n / max(1, len(s)), 1.0).astype(np.float32), float(y[i])))
        if rows:
            model, draw = Ftrl(size), np.random.default_rng(7)
            for _ in range(passes):
                for i in draw.permutation(len(rows)):
                    model.update(*rows[i])
            w = model.weights(slice(None))
            at = np.flatnonzero(w)
            yield batch_of(at=np.append(at, -1), w=np.append(w[at], 1.0))  # -1 counts the shards

    weights = (sample.select("id", "text", "y").repartition(SHARDS, "id").sortWithinPartitions("id", "text")
               .mapInArrow(fit, "at long, w double").groupBy("at").agg(F.sum("w").alias("w")).toArrow())
    at, w = weights.column("at").to_numpy(), weights.column("w").to_numpy()
    out = np.zeros(size + 1)
    shards = w[at < 0].sum()
    out[at[at >= 0]] = w[at >= 0] / max(shards, 1)
    return Model(out[:size].astype(np.float32), float(out[size]))


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, folds: int = 3,
            hold: int = 1) -> Model:
    """Model from at most `sample` labelled texts outside the held-out fold. docs: id, text."""
    mine = labels.where(~held_out("doc_id", folds, hold))
    return train(labelled_sample(docs, mine, label, sample))


def held_out(id_col: str, folds: int, hold: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % folds == hold, F.lit(False))


def dot_products(part: Slice, model: Model) -> np.ndarray:
    """Scores of a slice's texts."""
    slots, counts = hashed_ngrams(part)
    sums = np.diff(np.append(0, np.cumsum(model.weights[slots], dtype=np.float64))[np.append(0, np.cumsum(counts))])
    return 1 / (1 + np.exp(-np.clip(SCALE * sums / np.maximum(counts, 1) + model.bias, -35, 35)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (NO_ID for null) and score (0 to 1, higher for label 1). Null and empty texts score the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^LOG_SIZE weights, 1 MB
    return map_texts(keyed(docs, id_col, text_col), "text", lambda part: batch_of(
        id=part.batch.column("id"), score=dot_products(part, shared.value)), "id long, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose text scores at least `least`, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = text_udf(lambda part: pa.array(dot_products(part, shared.value)), "double")
    return arrow_batches(docs).where(scored(docs[text_col]) >= least)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label: str = "quality", sample: int = SAMPLE, folds: int = 3, hold: int = 1) -> DataFrame:
    """`id_col`, held_out, score, predicted (1 if score >= 0.5, else 0) for every text.

    Labels (doc_id, `label`) of ids whose crc32 is `hold` modulo `folds` are never learned from; a null id is
    not held out and has no label. Labels other than 0 and 1 count as none; without any labels all scores are
    0.5. Rows stay as many as they are; other columns are neither read nor returned.
    """
    scored = score(docs, learned(keyed(docs, id_col, text_col), labels, label, sample, folds, hold), id_col, text_col)
    return scored.withColumn("id", shown()).select(
        F.col("id").alias(id_col), held_out("id", folds, hold).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
