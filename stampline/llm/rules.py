"""Quality rules: a decision list learned by sequential covering, applied as ordered conditional expressions.

Texts are reduced to statistics in one narrow pass. Rules that reject are learned from labelled statistics: a
rule grows condition by condition (the threshold with the largest information gain on the growing part) until
it covers no good text there, is pruned back (the end of it goes as long as that helps on the pruning part),
and what it covers is set aside before the next one. A rule that is wrong as often as right on the pruning
part ends the list. The list is a chain of `when(...)`.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampline.llm.texts import PLAIN, Rolling, Slice, batch_of, byte_values, keyed, map_texts, mix, shown

#: Labelled texts that rules are learned from at most.
SAMPLE = 20_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines",
         "n_distinct")
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(0x41, 0x5B)))
_MARKS = np.isin(np.arange(256), list(b"!?"))
_STARTS = (np.arange(256) & 0xC0) != 0x80


def repeated_in_text(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: how many equal keys its text has, and whether it is the first of them."""
    mixed = mix(keys ^ mix(text.astype(np.uint64)))
    _, first, inverse, counts = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(keys), bool)
    is_first[first] = True
    return counts[inverse], is_first


def text_statistics(part: Slice, window: int = 8) -> dict[str, np.ndarray]:
    words = part.words(PLAIN)
    buf, at, n = part.buf, part.at, part.n
    inside = PLAIN[buf]

    def per_text(mask):
        return np.diff(np.append(0, np.cumsum(mask))[at])

    breaks = np.flatnonzero(buf == 0x0A)
    begin = np.sort(np.concatenate([at[:-1], breaks + 1]))
    text = np.repeat(np.arange(n), 1 + np.diff(np.searchsorted(breaks, at)))
    end = np.append(begin[1:], len(buf))
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    end = np.where(last, at[text + 1], end - 1)
    filled = np.append(0, np.cumsum(inside))
    lined = np.flatnonzero(filled[end] > filled[begin])
    hashes = mix(Rolling(byte_values(0)[buf], 0).of(begin[lined], end[lined]) + (end - begin)[lined].astype(np.uint64))
    _, first = repeated_in_text(hashes, text[lined])

    word_hash, text_of = words.hashes(), words.text_of()
    m = max(0, len(word_hash) - window + 1)
    valid = np.flatnonzero(text_of[:m] == text_of[window - 1:window - 1 + m])
    grams = Rolling(mix(word_hash), 1).of(valid, valid + window)
    twice = valid[repeated_in_text(grams, text_of[valid])[0] > 1]
    depth = np.zeros(len(word_hash) + 1, np.int64)
    np.add.at(depth, twice, 1)
    np.subtract.at(depth, twice + window, 1)
    _, new = repeated_in_text(word_hash, text_of)
    counted = (words.count, per_text(inside & _STARTS[buf]), per_text(_SYMBOLS[buf]),
               np.bincount(text[lined][~first], minlength=n),
               np.bincount(text_of[np.cumsum(depth)[:-1] > 0], minlength=n), per_text(_UPPER[buf]),
               per_text(_MARKS[buf]), np.bincount(text[lined], minlength=n), np.bincount(text_of[new], minlength=n))
    return {name: x.astype(np.int64) for name, x in zip(STATS, counted)}


def statistics(docs: DataFrame, *more: str) -> DataFrame:
    """docs (id, text, and `more` columns of longs) with STATS instead of the text."""

    def count(part: Slice):
        kept = {c: part.batch.column(part.batch.schema.get_field_index(c)) for c in ("id", *more)}
        return batch_of(**kept, **text_statistics(part))

    return map_texts(docs, "text", count, ", ".join(f"{c} long" for c in ("id", *more, *STATS)))


def features() -> dict[str, Column]:
    """What conditions are about: sizes and shares."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    return {"n_words": F.col("n_words").cast("double"), "mean_length": F.col("word_chars") / words,
            "symbols_per_word": F.col("n_symbols") / words, "marks_per_word": F.col("n_marks") / words,
            "upper_share": F.col("n_upper") / chars, "repeat_share": F.col("n_repeat_words") / words,
            "dup_line_share": F.col("n_dup_lines") / lines, "distinct_share": F.col("n_distinct") / words,
            "words_per_line": F.col("n_words") / lines}


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.threshold if self.above else value < self.threshold


Rule = list[Condition]


def _hits(x: dict[str, np.ndarray], rule: Rule) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= x[c.feature] >= c.threshold if c.above else x[c.feature] < c.threshold
    return out


def _grown(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int) -> Rule:
    rule: Rule = []
    while True:
        mine = _hits(x, rule)
        p, n = int(bad[mine].sum()), int((~bad[mine]).sum())
        if not p or not n or len(rule) == 6:
            return rule
        best, gain = None, 1e-9
        for name, values in x.items():
            v, b = values[mine], bad[mine]
            steps = np.linspace(0, 1, cuts)
            for t in np.unique(np.concatenate([np.quantile(v[b], steps), np.quantile(v[~b], steps)])):
                above = v >= t
                for up, chosen in ((True, above), (False, ~above)):
                    p1, n1 = int(b[chosen].sum()), int((~b[chosen]).sum())
                    if p1:
                        g = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if g > gain:
                            best, gain = Condition(name, up, float(t)), g
        if best is None:
            return rule
        rule = [*rule, best]


def _worth(x: dict[str, np.ndarray], bad: np.ndarray, rule: Rule) -> float:
    mine = _hits(x, rule)
    p, n = int(bad[mine].sum()), int((~bad[mine]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int = 48, most: int = 24, seed: int = 7) -> list[Rule]:
    """Ordered rules that reject. x: features of labelled texts; bad: which of them are to be rejected."""
    rules: list[Rule] = []
    if not len(bad):
        return rules
    order = np.random.default_rng(seed).permutation(len(bad))
    x, bad = {k: v[order] for k, v in x.items()}, bad[order]
    while len(rules) < most and bad.any():
        grow = np.arange(len(bad)) % 3 > 0
        gx, px = ({k: v[m] for k, v in x.items()} for m in (grow, ~grow))
        rule = _grown(gx, bad[grow], cuts)
        if not rule:
            break
        rule = max((rule[:i] for i in range(len(rule), 0, -1)), key=lambda r: _worth(px, bad[~grow], r))
        if _worth(px, bad[~grow], rule) <= 0:
            break
        rules.append(rule)
        left = ~_hits(x, rule)
        x, bad = {k: v[left] for k, v in x.items()}, bad[left]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects: the ordered conditional expression."""
    chain = None
    for rule in rules:
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        chain = F.when(holds, F.lit(False)) if chain is None else chain.when(holds, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int) -> DataFrame:
    """docs (id, text) with a 0/1 label `y`: at most `size` of them, the smallest by a hash of the id.

    Labels other than 0 and 1 count as none; of several labels of one id the smallest holds.
    """
    few = (labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("id"))
           .agg(F.min(label).cast("long").alias("y")).where("id is not null")
           .orderBy(F.xxhash64("id"), "id").limit(size))
    return docs.join(F.broadcast(few), "id")  # `size` rows at most


def quality_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most `sample` labelled texts; only their statistics come to the driver."""
    table = (statistics(labelled_sample(docs, labels, label, sample), "y")
             .select("y", *[c.alias(n) for n, c in features().items()]).orderBy("id", "y").toArrow())
    x = {name: table.column(name).to_numpy() for name in features()}
    return learn_rules(x, table.column("y").to_numpy() == 0)


def apply_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the other
    statistics.

    Words are cut at white space. Null texts and texts without words have zero everywhere and fail the base
    (n_words < 20, or over 30 % of words in repeated 8-word windows). `kept` is false for them, else the
    verdict of the rules; without rules all others are kept. Rows stay as many as they are; other columns are
    left behind.
    """
    stats = statistics(keyed(docs, id_col, text_col))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.select(shown().alias(id_col), *STATS[:5], failed.alias("base_failed"),
                        (~failed & verdict(rules)).alias("kept"), *STATS[5:])
