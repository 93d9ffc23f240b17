"""Multinomial draws by recursive binomial splitting.

A replicate draws G times from G entities. Instead of one row per draw, a tree over the dense index halves the
entities again and again: of the c draws of a node, the left half gets a binomial share, the right half the rest.
The share comes from a hash of (seed, replicate, node), so whoever asks about a range of entities walks from the
root to that range alone and finds what every other task finds; the draws of a replicate add up to G exactly.

Nodes are numbered as in a heap: 1 is [0, G), and [lo, hi) splits at lo + (hi - lo) // 2 into nodes 2i and 2i + 1.
All replicates and all nodes of a level that are asked for are split in one matrix operation, since a level has at
most two different node sizes.
"""

from __future__ import annotations

import math

import numpy as np

MASK = (1 << 64) - 1
#: Odd constants that spread replicates and nodes over 64 bits, and those of the mixer.
REPLICATE, NODE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
FIRST, SECOND = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Half width, in deviations, outside of which a binomial's mass (below 1e-30) is not tabulated.
REACH = 12
#: Entries of the distribution tables held at once, and node sizes whose tables are kept.
TABLE, KEPT = 2_000_000, 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
    return x ^ (x >> np.uint64(31))


def seed_key(seed: int) -> int:
    return int(mixed(np.array([seed & MASK], np.uint64))[0])


def replicate_keys(seed: int, first: int, n: int) -> np.ndarray:
    reps = np.arange(first, first + n, dtype=np.uint64)
    return mixed(reps * np.uint64(REPLICATE) + np.uint64(seed_key(seed)))


def uniforms(keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """nodes x replicates draws in [0, 1) with 53 bits."""
    return (mixed(keys[None, :] + (nodes.astype(np.uint64) * np.uint64(NODE))[:, None]) >> np.uint64(11)) * 2.0 ** -53


_TABLES: dict[tuple[int, int, int], tuple[int, np.ndarray]] = {}


def distribution(c: int, left: int, size: int) -> tuple[int, np.ndarray]:
    """(k0, P(X <= k) for k = k0, k0 + 1, ...) of Binomial(c, left / size), up to the largest k below c that matters."""
    known = _TABLES.get((c, left, size))
    if known is not None:
        return known
    p = left / size
    sd = math.sqrt(c * p * (1 - p))
    k0 = max(0, math.floor(c * p - REACH * (sd + 1)))
    k1 = min(c, math.ceil(c * p + REACH * (sd + 1)))
    if k1 <= k0:
        return k0, np.zeros(0)
    k = np.arange(k0, k1, dtype=float)
    log = np.empty(len(k))
    log[0] = math.lgamma(c + 1) - math.lgamma(k0 + 1) - math.lgamma(c - k0 + 1) \
        + k0 * math.log(p) + (c - k0) * math.log(1 - p)
    log[1:] = np.log((c - k[1:] + 1) / k[1:]) + math.log(left / (size - left))
    table = k0, np.minimum(np.cumsum(np.exp(np.cumsum(log))), 1.0)
    if size <= KEPT:
        _TABLES[c, left, size] = table
    return table


def shares(u: np.ndarray, c: np.ndarray, left: int, size: int) -> np.ndarray:
    """Binomial(c, left / size) by inversion of the uniforms u: how many values k have P(X <= k) <= u."""
    out = np.empty(c.shape, np.int64)
    values = np.unique(c)
    begin = 0
    while begin < len(values):
        tables, held, end = [], 0, begin
        while end < len(values) and (not tables or held < TABLE):
            tables.append(distribution(int(values[end]), left, size))
            held += len(tables[-1][1])
            end += 1
        part = values[begin:end]
        here = slice(None) if end - begin == len(values) else (c >= part[0]) & (c <= part[-1])
        at = np.searchsorted(part, c[here])
        lengths = np.array([len(t) for _, t in tables])
        starts = np.append(0, np.cumsum(lengths))[:-1]
        flat = np.concatenate([t + j for j, (_, t) in enumerate(tables)]) if held else np.zeros(0)
        below = np.searchsorted(flat, u[here] + at, "right") - starts[at]
        low = np.array([k for k, _ in tables])
        out[here] = low[at] + np.clip(below, 0, lengths[at])
        begin = end
    return out


class Tree:
    """Draws of `size` draws from `size` entities in each replicate of `keys`.

    The path to the last range stays, so neighbouring ranges do not start at the root again.
    """

    def __init__(self, size: int, keys: np.ndarray):
        self.keys = keys
        self.path = [(1, 0, size, np.full(len(keys), size, np.int64))]

    def counts(self, begin: int, end: int) -> np.ndarray:
        """Draws of the entities begin..end-1 (rows) in each replicate (columns)."""
        while not (self.path[-1][1] <= begin and end <= self.path[-1][2]):
            self.path.pop()
        nodes, lo, hi, drawn = (np.array([x]) for x in self.path[-1])
        while (hi - lo > 1).any():
            width = hi - lo
            left = drawn.copy()  # a single entity keeps its draws
            for m in np.unique(width[width > 1]):
                rows = np.flatnonzero(width == m)
                left[rows] = shares(uniforms(self.keys, nodes[rows]), drawn[rows], int(m) // 2, int(m))
            inner = width > 1
            mid = lo + width // 2
            nodes = np.concatenate([np.where(inner, 2 * nodes, nodes), 2 * nodes[inner] + 1])
            new_lo = np.concatenate([lo, mid[inner]])
            hi = np.concatenate([np.where(inner, mid, hi), hi[inner]])
            drawn = np.concatenate([left, (drawn - left)[inner]])
            keep = np.flatnonzero((hi > begin) & (new_lo < end))
            keep = keep[np.argsort(new_lo[keep], kind="stable")]
            nodes, lo, hi, drawn = nodes[keep], new_lo[keep], hi[keep], drawn[keep]
            if len(nodes) == 1:
                self.path.append((int(nodes[0]), int(lo[0]), int(hi[0]), drawn[0]))
        return drawn


def splitting_sql(name: str, seed: int, n_boot: int, levels: int = 14) -> str:
    """CTE `{name}_leaf` (rep, idx, w) over `{name}_g` (g): the same splits for at most 2^levels entities."""
    def step(select: str, source: str, shift: int, times: int) -> str:
        return f"select {select}, ((xor(z, z >> {shift})::uhugeint * {times}) % 18446744073709551616)::ubigint as z from ({source})"

    def mix(select: str, source: str) -> str:
        return f"select {select}, xor(z, z >> 31) as z from ({step(select, step(select, source, 30, FIRST), 27, SECOND)})"

    def add(key: str, number: str, times: int) -> str:
        return f"(({key}::uhugeint + {number}::uhugeint * {times}) % 18446744073709551616)::ubigint as z"

    keys = mix("rep", f"select range::int as rep, {add(str(seed_key(seed)), 'range', REPLICATE)} from range({n_boot})")
    out = [f"""
{name}_0 as materialized (select rep, z as key, 1::bigint as node, 0::bigint as lo, g as hi, g as c
  from ({keys}), {name}_g where g > 0)"""]
    for i in range(levels):
        cols = "rep, key, node, lo, hi, c"
        drawn = mix(cols, f"select {cols}, {add('key', 'node', NODE)} from {name}_{i} where hi - lo > 1")
        out.append(f"""
{name}_d{i} as (select c, m, k, sum(exp(lgamma(c + 1) - lgamma(k + 1) - lgamma(c - k + 1) + k * ln((m // 2) / m)
    + (c - k) * ln(1 - (m // 2) / m))) over (partition by c, m order by k) as cum
  from (select c, m, unnest(range(c)) as k from (select distinct c, hi - lo as m from {name}_{i} where hi - lo > 1))),
{name}_s{i} as materialized (select t.*, coalesce(k + 1, 0) as l from (
    select {cols}, hi - lo as m, (z >> 11)::double / 9007199254740992.0::double as u from ({drawn})) t
  asof left join {name}_d{i} d on d.c = t.c and d.m = t.m and t.u >= d.cum),
{name}_{i + 1} as materialized (
  select {cols} from {name}_{i} where hi - lo = 1
  union all select rep, key, 2 * node, lo, lo + m // 2, l from {name}_s{i}
  union all select rep, key, 2 * node + 1, lo + m // 2, hi, c - l from {name}_s{i})""")
    out.append(f"""
{name}_leaf as (select rep, lo as idx, c::int as w from {name}_{levels} where c > 0)""")
    return ",".join(out)
