"""Plain versions of what the operators compute."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

PLAIN = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text, pattern=PLAIN, lower=False):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def substrings(rows, k=20):
    """{(id, n_words, n_removed, kept_sha256)} of (id, text) with distinct ids."""
    first, out = {}, []
    for d, text in sorted(rows):
        w = words(text)
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i:i + k]), (d, i))
    for d, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < (d, i):
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), sha(kept)))
    return sorted(out)


def suffixes(rows, width=400):
    places = defaultdict(set)
    for d, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - width + 1):
            places[b[i:i + width]].add((d, i))
    out = []
    for d, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if len(places[b[i:i + width]]) > 1:
                gone[i:i + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def fingerprint(text, k=4, seed=42):
    w = words(text, lower=True)
    shingles = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows, radius=4):
    prints = [(d, fingerprint(t)) for d, t in rows]
    label = {p: p for _, p in prints}
    changed = True
    while changed:
        changed = False
        for p in label:
            low = min(label[q] for q in label if (p ^ q).bit_count() <= radius)
            changed |= low != label[p]
            label[p] = low
    least = {}
    for d, p in prints:
        least[label[p]] = min(d, least.get(label[p], d))
    return sorted((d, f"{p:016x}", least[label[p]]) for d, p in prints)


def statistics(text, window=8):
    w, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if PLAIN.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    covered = {j for i in range(len(w) - window + 1) if grams[tuple(w[i:i + window])] > 1
               for j in range(i, i + window)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def contamination(rows, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text, ALNUM, True)
        n = min(len(w), width)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for d, text in rows:
        w, hit, named = words(text, ALNUM, True), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found:
                    hit.update(range(i, i + n))
                    named |= found
        named = sorted(str(x) for x in named if x is not None)
        out.append((d, len(w), len(hit), len(named), sha(",".join(named)), bool(hit)))
    return sorted(out)


def shingles(text, k=5):
    w = words(text, lower=True)
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def similar_pairs(texts, least=0.8, k=5):
    """Pairs i < j of texts whose shingle sets differ and have a Jaccard similarity of at least `least`."""
    sets, at = [shingles(t, k) for t in texts], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    both = Counter((i, j) for ids in at.values() for n, i in enumerate(ids) for j in ids[n + 1:])
    return {(i, j) for (i, j), n in both.items() if sets[i] != sets[j] and n >= least * (len(sets[i]) + len(sets[j]) - n)}


def similar_groups(rows, least=0.8, k=5):
    """{row number: smallest row number of its group} of (id, text) rows; equal shingle sets are one."""
    rows = list(rows)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    first, links = {}, similar_pairs([t for _, t in rows], least, k)
    for i, (_, t) in enumerate(rows):
        links.add((first.setdefault(shingles(t, k), i), i))
    for i, j in links:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    return {i: top(i) for i in range(len(rows))}
