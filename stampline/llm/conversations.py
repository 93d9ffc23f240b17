"""Conversation repair: the cheapest edits that give each conversation the roles `(s?(ua)+)?`.

Depth-first branch and bound with an explicit stack. A node is (rows read, state); its children are the edits
Delete, Insert, Keep and Rerole in this (ASCII) order. A prefix goes when its cost and a lower bound of the rest
exceed the incumbent (cost, audit), or when the dominance table knows a prefix of the same node that costs no more:
prefixes are met in the order of their audits, so that one is also the smaller. The bound of a suffix is the exact
cost up to the end of its block of `BLOCK` rows, and the least cost of each later block whatever the states between.

Rows of one conversation never gather in one place. Rows are first reduced to a byte (role initial and fault); equal
ones carry a count. Range partitions in conversation and turn order are cut into slices of at most `ROWS` bytes. A
conversation in several slices gets one 4 x 4 matrix of costs per slice; running through these from its end gives
each slice the exact cost of what follows, and slices are searched on their own. Texts pass once, in order, through
the task that writes or hashes them: a digest of a conversation is sequential, memory is not.

Defined results: nulls in role and text count as one space; a null conversation is one conversation of its own; rows
without a turn come first; rows of equal turns are ordered by role, then by a hash of the text; an empty role has no
initial and is never kept; repeated rows are duplicates; other columns are ignored; no rows, no result.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampline.llm.texts import arrow_batches
from stampline.session import pinned

#: Rows of one searched slice, and of one block inside which the bound is exact.
ROWS, BLOCK = 1024, 32
SPACES = " \t\n\x0b\x0c\r"

#: Where the roles written so far stand: none, a system turn, an open user turn, an assistant turn.
START, SYSTEM, USER, ANSWERED = range(4)
OTHER, SYS, USR, ASS = range(4)
NO_FAULT, TRUNCATED, DUPLICATE, BLANK = range(4)
KEPT = {(SYS, START): SYSTEM, (USR, START): USER, (USR, SYSTEM): USER, (USR, ANSWERED): USER, (ASS, USER): ANSWERED}
#: The state after the user or assistant turn that fits a state.
FITS = (USER, USER, ANSWERED, USER)
ROLE = {USER: "user", ANSWERED: "assistant"}
#: Inserts that end a conversation, and what they cost.
TAIL = ("", "II", "I", "")
ENDS = (0, 6, 3, 0)
FAR = 1 << 40


def _edits(code: int, state: int) -> tuple:
    """(letter, cost, next state) of the edits that read a row, in ASCII order."""
    kind, fault = code & 3, code >> 2
    out = [("D", 4, state)]
    if fault < DUPLICATE:
        more = 3 if fault == TRUNCATED else 0
        if (kind, state) in KEPT:
            out.append(("K", more, KEPT[kind, state]))
        out.append(("R", 3 + more, FITS[state]))
    return tuple(out)


EDITS = tuple(tuple(_edits(code, state) for state in range(4)) for code in range(16))
#: Children in ASCII order: (letter, cost, next state, rows read).
CHILDREN = tuple(tuple(tuple(sorted([(e, c, t, 1) for e, c, t in EDITS[code][s]] + [("I", 3, FITS[s], 0)]))
                       for s in range(4)) for code in range(16))

_BACK: dict[tuple, tuple] = {}


def back(code: int, after: tuple) -> tuple:
    """Least costs from each state before a row, given those after it; inserts may come before the row."""
    low = min(after)
    key = (code, *[min(a - low, FAR) for a in after])
    if key not in _BACK:
        read = [min(c + key[1 + t] for _, c, t in EDITS[code][s]) for s in range(4)]
        _BACK[key] = tuple(min(read[s], 3 + read[FITS[s]], 6 + read[FITS[FITS[s]]]) for s in range(4))
    return tuple(min(x + low, FAR) for x in _BACK[key])


def bounds(codes: bytes, ends: tuple) -> list[tuple]:
    """A lower bound of the cost from every (row, state) on."""
    out = [ends] * (len(codes) + 1)
    for i in range(len(codes) - 1, -1, -1):
        after = out[i + 1]
        if (i + 1) % BLOCK == 0 and i + 1 < len(codes):
            after = (min(after),) * 4
        out[i] = back(codes[i], after)
    return out


def matrix(codes: bytes) -> list[int]:
    """Least costs from each state before the slice to each state after it."""
    columns = []
    for end in range(4):
        now = tuple(0 if t == end else FAR for t in range(4))
        for code in reversed(codes):
            now = back(code, now)
        columns.append(now)
    return [columns[t][s] for s in range(4) for t in range(4)]


def _dive(codes: bytes, start: int, ends: tuple, low: list[tuple]) -> tuple[int, str, int]:
    """A first incumbent: always the child with the smallest bound."""
    i, state, cost, audit, inserts = 0, start, 0, [], 0
    while i < len(codes):
        options = [(cost + c + low[i + n][t], e, c, t, n) for e, c, t, n in CHILDREN[codes[i]][state]
                   if n or inserts < 2]
        _, e, c, state, n = min(options)
        inserts = 0 if n else inserts + 1
        i, cost = i + n, cost + c
        audit.append(e)
    return cost + ends[state], "".join(audit), state


def search(codes: bytes, start: int = START, ends: tuple = ENDS) -> tuple[int, str, int]:
    """(cost with what follows, audit of these rows, state after them), the smallest (cost, audit)."""
    n, low = len(codes), bounds(codes, ends)
    best, audit, end = _dive(codes, start, ends, low)
    known = [FAR] * (4 * (n + 1))  # dominance: the least cost so far of each node
    path: list[str] = []
    stack = [(0, start, 0, 0, "")]
    while stack:
        i, state, cost, depth, letter = stack.pop()
        del path[depth:]
        if cost + low[i][state] > best or known[4 * i + state] <= cost:
            continue
        if letter:
            path[depth - 1:] = letter
        known[4 * i + state] = cost
        if i == n:
            found = (cost + ends[state], "".join(path))
            if found < (best, audit):
                best, audit, end = *found, state
            continue
        for e, c, t, read in reversed(CHILDREN[codes[i]][state]):
            if cost + c + low[i + read][t] <= best:
                stack.append((i + read, t, cost + c, depth + 1, e))
    return best, audit, end


# Rows to slices ------------------------------------------------------------------------------------

def conversation_key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """k, conv, hi (0 without a turn), a (the turn), role, text and the text's hashes, under these names only."""
    return rows.select(
        conversation_key(rows[conv]).alias("k"), rows[conv].alias("conv"),
        F.when(rows[turn].isNull(), 0).otherwise(1).alias("hi"),
        F.coalesce(rows[turn].cast("long"), F.lit(0)).alias("a"),
        F.coalesce(rows[role], F.lit(" ")).alias("role"), F.coalesce(rows[text], F.lit(" ")).alias("text"),
    ).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def _codes(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number `n` and the byte of the first one, `code`; the others are duplicates."""
    end = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYS).when(initial == "u", USR).when(initial == "a", ASS).otherwise(OTHER)
    fault = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), NO_FAULT).otherwise(TRUNCATED)
    same = ["k", "role", "h1", "h2"]
    each = rows.select(*same, "hi", "a", kind.alias("kind"), fault.alias("fault")) \
        .groupBy(*same, "hi", "a", "kind", "fault").agg(F.count("*").alias("n"))
    first = each.groupBy(*same).agg(F.min(F.struct("hi", "a")).alias("first"))
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("first") < F.struct("hi", "a"), DUPLICATE) \
        .otherwise(F.col("fault"))
    return each.join(first, same).withColumn("fault", fault) \
        .select("k", "hi", "a", "role", "h1", "h2", "n", (F.col("kind") + 4 * F.col("fault")).cast("int").alias("code"))


_SLICES = "k string, place long, whole boolean, codes binary"


def _cut(batches):
    """Slices of sorted rows: (k, place, whole, codes); `whole` if the conversation surely has no other slice."""
    from pyspark import TaskContext

    base, number = TaskContext.get().partitionId() << 40, 0
    out: list[tuple] = []
    key, codes, opened = None, bytearray(), False

    def put(end: bool) -> None:
        nonlocal codes, opened, number
        if codes:
            out.append((key, base + number, end and opened, bytes(codes)))
            number += 1
        codes, opened = bytearray(), end

    def drained():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        out.clear()
        return batch

    names, types = ["k", "place", "whole", "codes"], [pa.string(), pa.int64(), pa.bool_(), pa.binary()]
    for batch in batches:
        for k, n, code in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k", "n", "code")]):
            if k != key:
                put(key is not None)
                key = k
            twin = code if code >> 2 == BLANK else code & 3 | DUPLICATE << 2
            left = n
            while left:
                if len(codes) >= ROWS:
                    put(False)
                take = min(left, ROWS - len(codes))
                codes += bytes([code if left == n else twin]) + bytes([twin]) * (take - 1)
                left -= take
                if len(out) >= 500:
                    yield drained()
    put(False)
    if out:
        yield drained()


def _matrices(batches):
    for batch in batches:
        costs = [matrix(c) for c in batch.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("place"), pa.array(costs, pa.list_(pa.int64()))],
                                         names=["k", "place", "m"])


def _ends(batches):
    """From matrices in (k, place descending) order: the cost of all that follows each slice."""
    key, now = None, ENDS
    for batch in batches:
        out = []
        for k, m in zip(batch.column("k").to_pylist(), batch.column("m").to_pylist()):
            last = k != key
            if last:
                key, now = k, ENDS
            out.append((now, last))
            now = tuple(min(FAR, *[m[4 * s + t] + now[t] for t in range(4)]) for s in range(4))
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), batch.column("place"), pa.array([list(e) for e, _ in out], pa.list_(pa.int64())),
             pa.array([x for _, x in out], pa.bool_())], names=["k", "place", "ends", "last"])


def _searched(batches):
    """Each slice searched from every state it may begin in."""
    for batch in batches:
        out = []
        for k, place, codes, ends, last, whole in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist()
                                                        for c in ("k", "place", "codes", "ends", "last", "whole")]):
            ends, pieces, exits = tuple(ends), [], []
            for start in ([START] if whole else range(4)):
                _, audit, end = search(codes, start, ends)
                pieces.append(audit + (TAIL[end] if last else ""))
                exits.append(end)
            kinds, faults = [c & 3 for c in codes], [c >> 2 for c in codes]
            legal = {(SYS, USR), (USR, ASS), (ASS, USR)}
            illegal = sum(pair not in legal for pair in itertools.pairwise(kinds))
            out.append((k, place, pieces, [*exits, *([0] * (4 - len(exits))), kinds[0], kinds[-1], illegal,
                                           *[faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]]))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.list_(pa.string()),
                                                            pa.list_(pa.int64())))],
                names=["k", "place", "pieces", "nums"])


def searched_slices(rows: DataFrame) -> DataFrame:
    """(k, place, pieces, nums): the audits of each slice by the state it begins in, and its counts."""
    order = ["k", "hi", "a", "role", "h1", "h2"]
    spread = _codes(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    cut = pinned(arrow_batches(spread).select("k", "n", "code").mapInArrow(_cut, _SLICES))
    parts = cut.where("not whole")
    each = parts.select("k", "place", "codes").mapInArrow(_matrices, "k string, place long, m array<long>") \
        .repartition("k").sortWithinPartitions("k", F.desc("place")) \
        .mapInArrow(_ends, "k string, place long, ends array<long>, last boolean")
    ready = parts.join(each, ["k", "place"]).select(*cut.columns, "ends", "last").unionByName(
        cut.where("whole").withColumns({"ends": F.array(*[F.lit(e).cast("long") for e in ENDS]), "last": F.lit(True)}))
    return ready.mapInArrow(_searched, "k string, place long, pieces array<string>, nums array<long>")


# Slices and texts to results -----------------------------------------------------------------------

class _Conversation:
    """One conversation as its slices and then its rows pass by."""

    def __init__(self, conv):
        self.conv, self.state, self.audit, self.kind = conv, START, [], None
        self.counts = [0, 0, 0, 0]  # illegal, blank, duplicate, truncated
        self.turns = [None, None, 0]  # first, last, distinct
        self.letters, self.at, self.cost, self.lost = None, 0, 0, 0

    def slice(self, pieces, nums) -> None:
        at = self.state if len(pieces) > 1 else 0
        self.audit.append(pieces[at])
        self.state = nums[at]
        first, last, *counts = nums[4:]
        if self.kind is not None and (self.kind, first) not in {(SYS, USR), (USR, ASS), (ASS, USR)}:
            self.counts[0] += 1
        self.kind = last
        self.counts = [a + b for a, b in zip(self.counts, counts)]

    def edits(self, role: str | None, text: str | None):
        """(edit, role, text) of the inserts before a row and of the row itself; of those left without a row."""
        if self.letters is None:
            self.letters, self.state = "".join(self.audit), START
        while self.at < len(self.letters):
            e = self.letters[self.at]
            if e != "I" and role is None:
                break
            self.at += 1
            if e == "D":
                yield e, None, None
            elif e == "K":
                initial = {"s": SYS, "u": USR, "a": ASS}[role[0]]
                self.state = KEPT[initial, self.state]
                yield e, role, text
            else:
                self.state = FITS[self.state]
                yield e, ROLE[self.state], "" if e == "I" else text
            if e != "I":
                return

    def turn(self, known: bool, turn: int) -> None:
        if known and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]

    @property
    def gaps(self) -> int:
        first, last, distinct = self.turns
        return 0 if first is None else last - first + 1 - distinct


_COST = {"D": 4, "I": 3, "K": 0, "R": 3}
_STREAM = ["k", "kind", "hi", "a", "role", "h1", "h2"]


def _stream(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """Per conversation a marker, its searched slices in order, and its rows in order, in one task's stream."""
    empty = {"pieces": F.lit(None).cast("array<string>"), "nums": F.lit(None).cast("array<long>")}
    texts = rows.withColumn("kind", F.lit(2)).withColumns(empty)
    blank = {"hi": F.lit(0), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"),
             "h1": F.lit(None).cast("long"), "h2": F.lit(None).cast("long")}
    marks = originals.distinct().withColumns({"kind": F.lit(0), "a": F.lit(0).cast("long")} | blank | empty)
    heads = searched_slices(rows).withColumns({"kind": F.lit(1), "a": F.col("place")} | blank) \
        .withColumn("conv", F.lit(None).cast(rows.schema["conv"].dataType)).drop("place")
    both = texts.unionByName(heads).unionByName(marks)
    return arrow_batches(both.repartition("k").sortWithinPartitions(*_STREAM)
                         .select("k", "conv", "kind", "hi", "a", "role", "text", "pieces", "nums"))


def _walk(batches, begin, row, done):
    """Feeds a stream's conversations to the three functions; yields after each batch and at the end."""
    now, key = None, None
    for batch in batches:
        for k, conv, kind, hi, a, role, text, pieces, nums in zip(*[c.to_pylist() for c in batch.columns]):
            if k != key or now is None:
                if now is not None:
                    done(now)
                key, now = k, begin(conv)
            if kind == 1:
                now.slice(pieces, nums)
            elif kind == 2:
                now.turn(bool(hi), a)
                row(now, role, text)
        yield
    if now is not None:
        done(now)
    yield


def repair_digests(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text", originals: DataFrame | None = None) -> DataFrame:
    """One row per conversation: faults, cost, audit and the hash of the repaired turns.

    `originals` (with the column `conv`) names conversations to report even without rows.
    """
    prepared = _prepared(rows, conv, turn, role, text)
    named = rows if originals is None else originals
    marks = named.select(conversation_key(named[conv]).alias("k"), named[conv].alias("conv"))
    kind = rows.schema[conv].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = f"`{conv}` {kind}, " + ", ".join(f"{c} long" for c in names[:6]) + ", audit string, repaired_sha256 string"

    def run(batches):
        out, conv_type = [], None

        def begin(c):
            one = _Conversation(c)
            one.hash = hashlib.sha256()
            return one

        def put(one, role_, text_):
            for e, r, t in one.edits(role_, text_):
                one.cost += _COST[e]
                if r is not None:
                    one.hash.update(("\n" if one.lost else "").encode() + f"{r}:{t}".encode())
                    one.lost = 1
                    if e != "I":
                        end = t.rstrip(SPACES)[-1:]
                        one.cost += 3 * (end not in (".", "!", "?"))

        def done(one):
            put(one, None, None)
            illegal, blank, duplicate, truncated = one.counts
            out.append((one.conv, one.gaps, blank, duplicate, truncated, illegal, one.cost, one.letters,
                        one.hash.hexdigest()))

        def counted():
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field("conv").type
                yield batch

        for _ in _walk(counted(), begin, put, done):
            if out:
                kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[conv, *names])
                out.clear()

    return _stream(prepared, marks).mapInArrow(run, schema)


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """The repaired conversations: conv, position (from 0), edit (I, K or R), role, text. Deleted rows are gone."""
    prepared = _prepared(rows, conv, turn, role, text)
    kind = rows.schema[conv].dataType.simpleString()
    schema = f"`{conv}` {kind}, position long, edit string, role string, text string"

    def run(batches):
        out, conv_type = [], None

        def put(one, role_, text_):
            for e, r, t in one.edits(role_, text_):
                if r is not None:
                    out.append((one.conv, one.lost, e, r, t))
                    one.lost += 1

        def counted():
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field("conv").type
                yield batch

        for _ in _walk(counted(), _Conversation, put, lambda one: put(one, None, None)):
            if out:
                kinds = [conv_type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                 names=[conv, "position", "edit", "role", "text"])
                out.clear()

    return _stream(prepared, prepared.select("k", "conv")).mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to (conv_id, turn, role, text), decided by a checksum of `conv_id:turn`."""
    named = F.concat(F.coalesce(rows["conv_id"].cast("string"), F.lit(" ")), F.lit(":"),
                     F.coalesce(rows["turn"].cast("string"), F.lit(" ")))
    hit = F.crc32(named) % 20
    role, text = F.coalesce(rows["role"], F.lit(" ")), F.coalesce(rows["text"], F.lit(" "))
    out = rows.select(
        rows["conv_id"].alias("conv_id"), rows["turn"].alias("turn"),
        F.when(hit == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(hit == 1, F.lit("")).when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"))
    return out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))) \
        .drop("copies", "copy")


def conversation_repair(rows: DataFrame) -> DataFrame:
    """The digests of the damaged conversations, one row per original conv_id."""
    return repair_digests(damaged(rows), originals=rows)
