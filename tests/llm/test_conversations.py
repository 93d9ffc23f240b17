"""Conversation repair: the search against dynamic programming, digests against a plain version, slices, edges."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from stampline.llm import conversations as C

from . import brute

SCHEMA = "conv_id long, turn long, role string, text string"


def least(codes):
    """(cost, audit) by dynamic programming over whole prefixes."""
    def inserted(best):
        for _ in range(2):
            for s, (cost, audit) in list(best.items()):
                new = (cost + 3, audit + "I")
                best[C.FITS[s]] = min(best.get(C.FITS[s], new), new)
        return best

    best = inserted({C.START: (0, "")})
    for code in codes:
        after = {}
        for s, (cost, audit) in best.items():
            for e, c, t in C.EDITS[code][s]:
                after[t] = min(after.get(t, (1 << 50, "")), (cost + c, audit + e))
        best = inserted(after)
    return min(v for s, v in best.items() if s in (C.START, C.ANSWERED))


def found(codes):
    cost, audit, end = C.search(codes)
    return cost, audit + C.TAIL[end]


def some_codes(rng, n, calm=0.5):
    return bytes((1 + i % 2 if rng.random() < calm else rng.randrange(4)) + 4 * (0 if rng.random() < calm else
                 rng.randrange(4)) for i in range(n))


@pytest.mark.parametrize("n", [0, 1, 2, 5, 9, 33, 64, 200])
def test_search_finds_the_least_cost_and_audit(n):
    rng = random.Random(n)
    for i in range(60 if n < 60 else 8):
        codes = some_codes(rng, n, rng.choice([0.1, 0.5, 0.9]))
        assert found(codes) == least(codes), codes
    assert found(bytes([1]) * n) == least(bytes([1]) * n)


def test_search_by_every_sequence_of_edits():
    """The smallest (cost, audit) over all edit strings of short conversations."""
    def every(codes, state, cost, audit, inserts):
        if not codes:
            yield cost + C.ENDS[state], audit + C.TAIL[state]
            return
        for e, c, t, read in C.CHILDREN[codes[0]][state]:
            if read or inserts < 4:
                yield from every(codes[read:], t, cost + c, audit + e, inserts + (not read))

    rng = random.Random(7)
    for _ in range(40):
        codes = some_codes(rng, rng.randrange(5), 0.3)
        assert found(codes) == min(every(codes, C.START, 0, "", 0))


def test_bounds_never_exceed_the_cost():
    rng = random.Random(3)
    for _ in range(20):
        codes = some_codes(rng, 100)
        low = C.bounds(codes, C.ENDS)
        for i in range(0, 101, 7):
            for s in range(4):
                assert low[i][s] <= C.search(codes[i:], s)[0]


def plain(rows):
    """The contract's rows of (conv_id, turn, role, text), unlike ordered ties left out."""
    out, kept = {}, {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, hit = role if role is not None else " ", text if text is not None else " ", zlib.crc32(name.encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if hit == 4:
            role = "user"
        kept[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(hit, 1)
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, codes, faults = set(), [], []
        for turn, role, text in rows:
            bare = text.rstrip(C.SPACES)
            fault = C.BLANK if not bare else C.DUPLICATE if (role, text) in seen else \
                C.NO_FAULT if bare[-1] in ".!?" else C.TRUNCATED
            seen.add((role, text))
            faults.append(fault)
            codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + 4 * fault)
        cost, audit = least(codes)
        state, lines, i = C.START, [], 0
        for e in audit:
            role, text = ("", "") if e == "I" else rows[i][1:]
            i += e != "I"
            if e == "D":
                continue
            state = C.KEPT[codes[i - 1] & 3, state] if e == "K" else C.FITS[state]
            lines.append(f"{role if e == 'K' else C.ROLE[state]}:{text}")
        turns = [t for t, *_ in rows if t is not None]
        starts = [r[1][:1] for r in rows]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in
                     (C.BLANK, C.DUPLICATE, C.TRUNCATED)], sum(a + b not in ("su", "ua", "au") for a, b in
                     zip(starts, starts[1:])), cost, audit, brute.sha("\n".join(lines)))
    return out


def test_classes_of_the_plain_version():
    assert (C.SYS, C.USR, C.ASS, C.OTHER) == (1, 2, 3, 0)


def some_rows(seed, conversations, turns):
    rng, out = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randrange(turns)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ["user", "assistant"][turn % 2]
            role = rng.choice([role] * 9 + ["system", "tool", "", None])
            out.append((conv, turn * rng.choice([1, 1, 1, 2]), role, rng.choice(
                ["Yes.", "No", "a b?", " ", "", None, "é!\n", f"text {turn}.", f"Text {conv} {turn}!  "])))
    distinct = {}
    for r in out:
        distinct[r[:2]] = r
    return list(distinct.values())


def digests(df):
    return {r.conv_id: tuple(r)[1:] for r in C.conversation_repair(df).collect()}


def test_digests_match_the_plain_version(spark):
    rows = some_rows(1, 60, 12) + [(None, t, r, x) for t, r, x in ((1, "user", "A?"), (2, "assistant", "B."))] \
        + [(900, None, "user", "Q?"), (901, 4, None, None), (902, 1, "user", "x " * 100_000 + ".")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {n: F.lit(None).cast("string") if n < "d" else F.lit(7) for n in ("k", "a", "hi", "kind", "n", "code", "conv", "place")})
    assert digests(df) == plain(rows)


@pytest.mark.parametrize("size", [1, 7])
def test_a_conversation_in_many_slices(spark, monkeypatch, size):
    """Small slices give what one slice gives."""
    rows = some_rows(2, 2, 150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    cut = C._cut

    def small(batches):
        C.ROWS = size
        yield from cut(batches)

    monkeypatch.setattr(C, "_cut", small)
    assert digests(df) == plain(rows)


def test_many_equal_rows_and_tied_turns(spark):
    rows = [(1, 5, "user", "same?")] * 3000 + [(1, 6, "assistant", "answer.")]
    got = C.repair_digests(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got.duplicate, got.cost, got.audit) == (2999, 4 * 2999, "K" + "D" * 2999 + "K")
    tied = [(1, 1, "user", "b?"), (1, 1, "assistant", "a."), (1, 1, "user", "b?")]
    got = [C.repair_digests(spark.createDataFrame(r, SCHEMA)).first() for r in (tied, tied[::-1])]
    assert got[0] == got[1] and got[0].duplicate == 1


def test_repaired_turns_are_what_the_digest_hashes(spark):
    rows = some_rows(5, 30, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    turns = {}
    for r in sorted(C.repaired_turns(df).collect()):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in C.repair_digests(df).collect():
        assert brute.sha("\n".join(turns.get(r.conv_id, []))) == r.repaired_sha256


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.conversation_repair(none).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = C.conversation_repair(spark.createDataFrame([(gone, 0, "user", "x")], SCHEMA)).first()
    assert tuple(got) == (gone, 0, 0, 0, 0, 0, 0, "", brute.sha(""))
