"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton reads tokens: a sequence of tokens has a path exactly if it is the encoding of its own bytes.
It starts as one state with an arc for every base symbol. Each merge (u, v) -> w, in order of rank, is one
gadget: the state that u leads to is copied without its v-arc, u then leads to the copy, and every state that
has a u-arc gets a w-arc to where v led. So each merge adds one state, all arcs with one label lead to one
state, and a state differs from the one it was copied from by the one arc it lost. A merge whose u-state has no v-arc adds nothing.

The table therefore keeps, per token, the state it leads to, and per state its parent, the label it lost and
when. States form a tree; "has state q lost label v before time m" asks for an ancestor of q, which intervals
of a depth-first numbering answer. Whether q has a t-arc follows t's left parts back through the gadgets that
made them. Answers are kept in a bounded transition table.

A prefix of a word has one encoding, hence one state; encoding goes through the word and finds, at each
place, the one token that ends there and has an arc from the state reached before it. Decoding emits labels.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stampline.llm.texts import batch_of, keyed, map_texts, shown

#: Stands for an end-of-word suffix inside the automaton.
END = "\uffff"
#: Words whose encoding a worker keeps, and transitions it keeps; past that it starts anew.
KEPT_WORDS, KEPT_ARCS = 200_000, 200_000
#: Unicode's White_Space characters, fixed.
WHITE = r"\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    return [chr(rest.get(b, b)) for b in range(256)]


class Automaton:
    """Token automaton of ordered merges over base symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.reach: dict[str, int] = {}  # first four characters -> longest token that begins so
        for label in vocab:
            if len(label) > 3:
                self.reach[label[:4]] = max(len(label), self.reach.get(label[:4], 3))
        self.to: dict[int, int] = {}           # token -> state its arcs lead to
        self.made: dict[int, tuple[int, int]] = {}  # token -> (its left part, when it was made)
        parent = [-1]
        lost: dict[int, list[tuple[int, int]]] = {}  # label -> (state that lost it, when)
        gadgets: dict[tuple[int, int], int] = {}
        ends_with: dict[int, int] = {}  # token -> its right part
        for when, (left, right) in enumerate(merges, 1):
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            if w in self.made or not self._follows(u, v, gadgets, ends_with):
                continue
            gadgets[u, v], ends_with[w] = when, v
            target = self.to.get(v, 0)
            parent.append(self.to.get(u, 0))
            lost.setdefault(v, []).append((len(parent) - 1, when))
            self.to[u] = len(parent) - 1
            self.to[w] = target
            self.made[w] = (u, when)
        self.never = {vocab[a + b] for a, b in merges} - self.made.keys()  # no path makes these
        self._number(parent)
        self.spans = {label: self._nested(states) for label, states in lost.items()}
        self.arcs: dict[int, bool] = {}

    def _follows(self, u: int, v: int, gadgets: dict[tuple[int, int], int], ends_with: dict[int, int]) -> bool:
        """Whether the state after u has a v-arc so far. It lost those of the gadgets of u, and of u's right
        parts from before they became parts."""
        label, until = v, 1 << 60
        while True:
            token, before = u, 1 << 60
            while True:
                lost = gadgets.get((token, label), 1 << 61)
                if lost < before and lost <= until:
                    return False
                if token not in ends_with:
                    break
                token, before = ends_with[token], self.made[token][1]
            if label not in self.made:
                return True
            label, until = self.made[label]

    def _number(self, parent: list[int]) -> None:
        below: list[list[int]] = [[] for _ in parent]
        for state, p in enumerate(parent[1:], 1):
            below[p].append(state)
        self.enter, self.leave, clock = [0] * len(parent), [0] * len(parent), 0
        stack = [(0, iter(below[0]))]
        while stack:
            state, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                self.leave[state] = clock
                stack.pop()
            else:
                clock += 1
                self.enter[child] = clock
                stack.append((child, iter(below[child])))

    def _nested(self, states: list[tuple[int, int]]) -> tuple[list[int], list[int], list[int]]:
        """Sorted bounds of the subtrees that lost a label, and from each bound on the earliest time (0: kept)."""
        events = sorted([(self.enter[s], 1, t) for s, t in states] + [(self.leave[s] + 1, 0, t) for s, t in states])
        bounds, first, open_times = [], [], []
        for at, opens, when in events:
            if opens:
                open_times.append(when)
            else:
                open_times.remove(when)
            if bounds and bounds[-1] == at:
                first[-1] = min(open_times, default=0)
            else:
                bounds.append(at)
                first.append(min(open_times, default=0))
        return bounds, first

    def lost_at(self, state: int, label: int) -> int:
        """When `state` (or what it was copied from) lost the arc; 0 if it never did."""
        span = self.spans.get(label)
        if span is None:
            return 0
        i = bisect_right(span[0], self.enter[state]) - 1
        return span[1][i] if i >= 0 else 0

    def has_arc(self, state: int, token: int) -> bool:
        key = state << 20 | token
        known = self.arcs.get(key)
        if known is None:
            known, label, until = token not in self.never, token, 1 << 60
            while known:
                lost = self.lost_at(state, label)
                if lost and lost <= until:  # equal: u = v, the copy has no u-arc and so gets no w-arc
                    known = False
                    break
                if label not in self.made:
                    break
                label, until = self.made[label]
            if len(self.arcs) >= KEPT_ARCS:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def encode(self, text: str) -> list[int]:
        """Token ids of one pre-split word, given as its base symbols joined: the path through the automaton.

        Longer arcs are tried first. A place from which no path goes on is tried once: whatever path led
        there, its state is the same.
        """
        n, at, state = len(text), 0, 0
        tokens: list[int] = []
        trail: list[tuple[int, int, int]] = []
        dead: set[int] = set()
        vocab, arcs, reach, to = self.vocab, self.arcs, self.reach, self.to
        size = min(n, reach.get(text[:4], 3))
        while at < n:
            while size:
                token = vocab.get(text[at:at + size])
                if token is not None and at + size not in dead:
                    known = arcs.get(state << 20 | token)
                    if known or known is None and self.has_arc(state, token):
                        break
                size -= 1
            if size:
                trail.append((at, state, size))
                tokens.append(token)
                state = to.get(token, 0)
                at += size
                size = min(n - at, reach.get(text[at:at + 4], 3))
            elif trail:
                dead.add(at)
                at, state, size = trail.pop()
                tokens.pop()
                size -= 1
            else:
                raise ValueError(f"no path for {text!r}")
        return tokens


class Kept(dict):
    """Words and what they encode to; what is missing is made, and past `room` words it starts anew."""

    def __init__(self, make, room: int):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, word):
        if len(self) >= self.room:
            self.clear()
        self[word] = out = self.make(word)
        return out


class WordTokenizer:
    """Lower-casing word tokenizer of a `tokenizers` JSON file: NFC, white space, letters or digits or others
    as words, bytes as symbols, an end-of-word suffix; special tokens are cut out of the raw text first."""

    def __init__(self, source: dict):
        model = source["model"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        # The suffix is one character that no symbol has, so that it isn't cut.
        suffix = model["end_of_word_suffix"] or ""
        marked = (lambda t: t[:-len(suffix)] + END if suffix and t.endswith(suffix) else t)
        vocab = {marked(t): i for t, i in model["vocab"].items()}
        self.automaton = Automaton(vocab, [(marked(a), marked(b)) for a, b in pairs])
        self.end = END if suffix else ""
        self.special = {t["content"]: t["id"] for t in source["added_tokens"]}
        self.labels = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.word = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
        self.symbols = byte_symbols()
        self.kept = Kept(self._word, KEPT_WORDS)

    def forget(self) -> None:
        """Drop the kept words and transitions; the automaton stays."""
        self.kept.clear()
        self.automaton.arcs.clear()

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def _word(self, word: str) -> tuple[bytes, str]:
        """Ids as little-endian bytes, and their labels joined by a space."""
        text = word if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, word.encode()))
        ids = self.automaton.encode(text + self.end)
        return array("I", ids).tobytes(), " ".join([self.labels[i] for i in ids])

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """Of every word in turn; special tokens are words too. White space only parts words."""
        out: list[tuple[bytes, str]] = []
        for k, part in enumerate(self.cut.split(text) if self.cut and "<" in text else [text]):
            if k % 2:
                out.append((array("I", [self.special[part]]).tobytes(), part))
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # each character is lowered by itself
            kept = self.kept
            out += [kept[word] for word in self.word.findall(part.lower())]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(p[0] for p in self.pieces(text)), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.labels[i] for i in ids)


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One automaton per worker and file; building takes about a second."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer.load(path)
    return _LOADED[path]


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                tokens: bool = False) -> DataFrame:
    """`id_col`, n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256 of every text, and with
    `tokens` also `ids` (array of int) and `decoded`.

    path: a tokenizer file that every worker can open, installed with its package. A null text is empty: no
    tokens, digests of nothing. Rows stay as many as they are; equal rows give equal digests; other columns
    are left behind. One narrow pass without a shuffle.
    """

    def digest(part):
        t = tokenizer(path)
        ids, texts = [], []
        for text in part.batch.column("text").to_pylist():
            pieces = t.pieces(text) if text else []
            ids.append(b"".join([p[0] for p in pieces]))
            texts.append(" ".join([p[1] for p in pieces]))
        sizes = [len(x) // 4 for x in ids]
        out = {"id": part.batch.column("id"), "n_tokens": pa.array(sizes, pa.int64()),
               "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
               "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in texts]}
        if tokens:
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            out |= {"ids": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), flat),
                    "decoded": pa.array(texts, pa.string())}
        return batch_of(**out)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = map_texts(keyed(docs, id_col, text_col), "text", digest,
                    schema + ", ids array<int>, decoded string" * tokens, done=lambda: tokenizer(path).forget())
    return out.select(shown().alias(id_col), *out.columns[1:])
