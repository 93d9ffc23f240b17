"""Language identification: scripts narrow the candidates, Viterbi labels spans of mixed-language text.

A word is a run of letters. Its script comes from code point ranges and leaves the languages learned with that
script as candidates; their score for the word is a sum of log probabilities of hashed byte trigrams. A path
through the words of a text picks a language per word and pays a penalty at each switch; the best one labels
the spans. Where every stretch of a text gains less than half the penalty for another language over the best
overall, no stretches pay for their switches: that one language is the best path, and the dynamic programme is
skipped.

Trigram counts come from a bounded sample of labelled texts, summed over the tasks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampline.llm.texts import Slice, batch_of, keyed, map_texts, shown

#: Labelled texts that profiles are learned from at most.
SAMPLE = 20_000
#: Slots of trigrams per language.
LOG_SLOTS = 16
#: Cost of a switch, in nats; a word of another language gains a few.
SWITCH = 25.0
#: A language is learned with a script if that has at least this share of its words.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"

#: First code points of ranges and the script each belongs to (fixed values; "" has no letters of interest).
SCRIPTS = [(0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
           (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"),
           (0x0B80, "Tamil"), (0x0C00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"),
           (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
           (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x3040, "Kana"),
           (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"),
           (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"),
           (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"),
           (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x323B0, "Other")]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([first for first, _ in SCRIPTS])
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])
_PLANE: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters (Unicode category L); built once per worker."""
    global _PLANE
    if _PLANE is None:
        import unicodedata

        _PLANE = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])
    return _PLANE


class WordBytes:
    """Words (runs of letters, lower-cased) of a slice: `first` bounds per text, `size` (letters), `script`, and
    `slots` of their byte trigrams, with `bounds` per word. A word's edges count as a byte each."""

    def __init__(self, part: Slice):
        texts = [t.lower() if t else "" for t in part.batch.column("text").to_pylist()]
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(t) for t in texts], np.int64)
        at = np.append(0, np.cumsum(lengths + 1))
        inside = letters()[points]
        step = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.first = np.searchsorted(start, at)
        self.size = end - start
        self.script = _SCRIPT_OF[np.searchsorted(_STARTS, points[start], "right") - 1]
        # Words as bytes between zero bytes: letters by the low and, past one byte, the high part of their point.
        keep = np.append(inside, False)
        keep[end] = True  # the character after a word stands for its edge
        kept = np.where(inside, points, 0) if len(points) else points
        kept = np.append(kept, 0)[keep].astype(np.uint64)
        value = kept * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        padded = np.concatenate([[np.uint64(0)], value])
        one, two, three = padded[:-1], value, np.append(value[1:], np.uint64(0))
        hashed = (one * np.uint64(0xD1342543DE82EF95) + two) * np.uint64(0xDA942042E4DD58B5) + three
        self.slots = ((hashed ^ (hashed >> np.uint64(31))) >> np.uint64(64 - LOG_SLOTS - 8)
                      & np.uint64((1 << LOG_SLOTS) - 1)).astype(np.int32)
        self.bounds = np.append(0, np.cumsum(self.size + 1))  # the last trigram of a word is centred on its edge


class Profiles(NamedTuple):
    languages: list[str]
    logs: np.ndarray       # slots x languages
    scripts: np.ndarray    # scripts x languages: learned with it


def learn_profiles(sample: DataFrame) -> Profiles:
    """Profiles from `sample` (id, text, lang). The driver gets at most 2^LOG_SLOTS counts a language."""
    slots = 1 << LOG_SLOTS

    def count(part: Slice):
        words = WordBytes(part)
        langs, code = np.unique(part.column("lang").astype(str), return_inverse=True)
        text_of_word = np.repeat(np.arange(part.n), np.diff(words.first))
        owner = code[text_of_word] if len(text_of_word) else np.zeros(0, np.int64)
        per_gram = np.repeat(owner, words.size + 1).astype(np.int64)
        keys = np.concatenate([per_gram * slots * 2 + words.slots, owner * slots * 2 + slots + words.script])
        key, n = np.unique(keys, return_counts=True)
        return batch_of(lang=pa.array(langs[key // (2 * slots)], pa.string()), slot=key % (2 * slots), n=n)

    got = (map_texts(sample.select("id", "text", "lang"), "text", count, "lang string, slot long, n long")
           .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow())
    names = np.array(got.column("lang").to_pylist(), object)
    languages = sorted(set(names.tolist()))
    table = np.zeros((2 * slots, len(languages)))
    for i, lang in enumerate(languages):
        mine = names == lang
        table[got.column("slot").to_numpy()[mine], i] = got.column("n").to_numpy()[mine]
    grams, scripts = table[:slots] + 0.5, table[slots:slots + len(SCRIPT_NAMES)]
    logs = np.log(grams / grams.sum(axis=0)) if languages else grams
    if languages:
        logs -= logs.mean(axis=1, keepdims=True)
    return Profiles(languages, logs.astype(np.float32), scripts >= SCRIPT_SHARE * scripts.sum(axis=0) + 1e-9)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Language per word of each text: the best path, all texts in step. Ties go to the smaller index and to
    staying."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, length = first[:-1][order], lengths[order]
    back = np.zeros(scores.shape, np.int8 if scores.shape[1] < 128 else np.int32)
    best = np.zeros((len(order), scores.shape[1]))
    here = np.arange(scores.shape[1])
    for t in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -t, "left"))
        now = best[:live]
        if t:
            top = now.argmax(axis=1)
            jump = now[np.arange(live), top] - penalty
            switch = jump[:, None] > now
            back[begin[:live] + t] = np.where(switch, top[:, None], here)
            now = np.where(switch, jump[:, None], now)
        best[:live] = now + scores[begin[:live] + t]
    path = np.zeros(len(scores), np.int64)
    state = best.argmax(axis=1)
    for t in range(int(length[0]) - 1 if len(length) else -1, -1, -1):
        live = int(np.searchsorted(-length, -t, "left"))
        at = begin[:live] + t
        path[at] = state[:live]
        state[:live] = back[at, state[:live]]
    return path


def word_scores(words: WordBytes, profiles: Profiles) -> np.ndarray:
    """Score of each candidate language for each word; far below all where the script rules it out."""
    sums = np.zeros((len(words.slots) + 1, len(profiles.languages)))
    np.cumsum(profiles.logs[words.slots], axis=0, dtype=np.float64, out=sums[1:])
    scores = sums[words.bounds[1:]] - sums[words.bounds[:-1]]
    fits = profiles.scripts[words.script]
    fits |= ~fits.any(axis=1, keepdims=True)
    return np.where(fits, scores, scores.min(axis=1, keepdims=True) - 4 * SWITCH if len(scores) else scores)


def label_words(words: WordBytes, profiles: Profiles, penalty: float) -> np.ndarray:
    """Language index of every word."""
    scores, first = word_scores(words, profiles), words.first
    path, open_texts = np.zeros(len(scores), np.int64), []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if a == b:
            continue
        mine = scores[a:b]
        best = int(mine.sum(axis=0).argmax())
        gains = np.cumsum(mine - mine[:, best:best + 1], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros((1, gains.shape[1])), gains[:-1]]), axis=0)
        # m stretches in other languages gain at most m times this, and pay for m - 1 switches or more.
        if (gains - low).max() >= penalty / 2:
            open_texts.append(i)
        else:
            path[a:b] = best
    if open_texts:
        chosen = np.array(open_texts)
        counts = np.diff(first)[chosen]
        rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in open_texts])
        path[rows] = viterbi(scores[rows], np.append(0, np.cumsum(counts)), penalty)
    return path


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text",
             penalty: float = SWITCH) -> DataFrame:
    """`id_col`, lang_pred, score (share of the letters in its spans), n_spans of every text.

    `und`, 0 and 0 spans for null texts, texts without a letter, and without any learned language. Of languages
    with as many letters the first by name is taken. Rows stay as many as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # 2^LOG_SLOTS floats a language

    def predict(part: Slice):
        words, known = WordBytes(part), shared.value
        n = max(1, len(known.languages))
        path = label_words(words, known, penalty) if known.languages else np.zeros(len(words.size), np.int64)
        text = np.repeat(np.arange(part.n), np.diff(words.first))
        size = np.bincount(text * n + path, weights=words.size, minlength=part.n * n).reshape(part.n, n)
        total, best = size.sum(axis=1), size.argmax(axis=1)
        found = (total > 0) & bool(known.languages)
        new = np.append(True, (text[1:] != text[:-1]) | (path[1:] != path[:-1]))[:len(text)]
        names = np.array([*known.languages, UNKNOWN], object)
        return batch_of(
            id=part.batch.column("id"), lang_pred=pa.array(names[np.where(found, best, len(names) - 1)], pa.string()),
            score=np.where(found, size[np.arange(part.n), best] / np.maximum(total, 1), 0.0),
            n_spans=np.where(found, np.bincount(text[new], minlength=part.n), 0).astype(np.int64))

    out = map_texts(keyed(docs, id_col, text_col), "text", predict,
                    "id long, lang_pred string, score double, n_spans long")
    return out.select(shown().alias(id_col), "lang_pred", "score", "n_spans")


def language_spans(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text",
                   penalty: float = SWITCH) -> DataFrame:
    """`id_col`, first_word, n_words, lang: the spans of every text in order; none where there is no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def label(part: Slice):
        words, known = WordBytes(part), shared.value
        if not known.languages or not len(words.size):
            return None
        path = label_words(words, known, penalty)
        text = np.repeat(np.arange(part.n), np.diff(words.first))
        starts = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (path[1:] != path[:-1])))
        return batch_of(id=part.batch.column("id").take(pa.array(text[starts])),
                        first_word=starts - words.first[text[starts]], n_words=np.diff(np.append(starts, len(path))),
                        lang=pa.array(np.array(known.languages, object)[path[starts]], pa.string()))

    out = map_texts(keyed(docs, id_col, text_col), "text", label, "id long, first_word long, n_words long, lang string")
    return out.select(shown().alias(id_col), "first_word", "n_words", "lang")


def language_predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                         sample: int = SAMPLE, folds: int = 4, hold: int = 2) -> DataFrame:
    """`id_col`, held_out, lang_pred, score, n_spans for every text of `docs`.

    Profiles come from at most `sample` rows with a text, a language and an id whose crc32 is not `hold` modulo
    `folds`, the smallest by a hash of the id. A null id is not held out and not learned from.
    """
    def held(c):
        return F.coalesce(F.crc32(c.cast("long").cast("string")) % folds == hold, F.lit(False))

    usable = docs.where(docs[id_col].isNotNull() & docs[text_col].isNotNull() & docs[lang_col].isNotNull()
                        & ~held(docs[id_col]))
    few = (usable.select(docs[id_col].cast("long").alias("id")).orderBy(F.xxhash64("id"), "id").limit(sample)
           .distinct())
    rows = usable.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"),
                         docs[lang_col].alias("lang")).join(F.broadcast(few), "id")  # `sample` ids at most
    out = identify(docs, learn_profiles(rows), id_col, text_col)
    return out.select(id_col, held(F.col(id_col)).alias("held_out"), "lang_pred", "score", "n_spans")
