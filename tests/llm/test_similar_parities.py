"""Candidates that cannot be similar are told from parities of their shingles; no similar pair is."""

import random

import numpy as np

from stampline.llm import similar as S


def test_parities_lose_no_similar_pair():
    rng = np.random.default_rng(5)
    kept, seen = {True: 0, False: 0}, {True: 0, False: 0}
    for _ in range(2000):
        n, gone, new = int(rng.integers(1, 400)), *rng.random(2) * 0.25
        x = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
        y = np.unique(np.append(x[rng.random(len(x)) > gone], rng.integers(0, 2 ** 63, int(n * new), dtype=np.uint64)))
        both = len(np.intersect1d(x, y))
        similar = both >= 0.8 * (len(x) + len(y) - both)
        odd = S.parities(np.append(x, y), np.array([len(x), len(y)]))
        seen[similar] += 1
        kept[similar] += bool(S.may_be_similar(odd[:1], odd[1:], 0.8)[0])
    assert seen[True] > 500 and seen[False] > 500
    assert kept[True] == seen[True] and kept[False] < 0.4 * seen[False]


def test_sets_without_shingles():
    odd = S.parities(np.zeros(0, np.uint64), np.array([0, 0]))
    assert odd.shape == (2, 1 + S.ODD) and not odd.any()
    assert S.may_be_similar(odd[:1], odd[1:], 0.8).all()


def test_near_copies_that_are_not_similar_cost_few_checks(spark, monkeypatch):
    """All pairs of a group of near copies below the threshold were joined with their sets: the square of its size."""
    rng, n = random.Random(8), 240
    hub = [f"w{rng.randrange(10 ** 6)}" for _ in range(200)]
    texts = []
    for i in range(n):
        words = list(hub)
        for at in rng.sample(range(200), 5):
            words[at] = f"x{i}y{at}"
        texts.append((i, " ".join(words)))
    checked, whole = [], S.similar_pairs
    monkeypatch.setattr(S, "similar_pairs", lambda pairs, *rest: checked.append(pairs.count()) or whole(pairs, *rest))
    S.similar_groups(spark.createDataFrame(texts, "doc_id long, text string"))[1].count()
    assert sum(checked) < 40 * n < n * (n - 1) / 4
