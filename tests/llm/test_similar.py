"""Near-duplicates at five words and a similarity of 0.8: recall and false joins against brute force, hubs, edges."""

import random

import numpy as np
import pytest

from stampline.llm import similar as S
from stampline.llm.substrings import substring_dedup
from stampline.llm.suffixes import suffix_dedup
from stampline.llm.texts import texts_of, with_spans

from . import brute


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10 ** 6)}" for w in text.split())


@pytest.fixture(scope="module")
def family(prose):
    """Bases with copies at many distances, some around the threshold, and a hub with hundreds of copies."""
    rng, out = random.Random(3), []
    for b in range(40):
        base = prose(b, rng.randrange(30, 400))
        out += [edited(rng, base, s) for s in (0, 0, 0.004, 0.01, 0.02, 0.03, 0.05, 0.2)]
    hub = prose(999, 300)
    out += [edited(rng, hub, rng.choice([0.003, 0.01])) for _ in range(300)]
    out += [prose(5000 + i, rng.randrange(3, 60)) for i in range(200)]
    return [(i, t) for i, t in enumerate(out)]


def groups_of(df):
    rows, nodes = S.similar_groups(df)
    group = {tuple(r.prints): r.group for r in nodes.collect()}
    return {r.id: group[tuple(r.prints)] for r in rows.collect()}


def test_recall_and_no_false_joins(documents, family):
    got = groups_of(documents(family).repartition(5))
    want = brute.similar_groups(family)
    pairs = brute.similar_pairs([t for _, t in family])
    assert len(pairs) > 500
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs)
    mixed = {}
    for i in want:
        mixed.setdefault(got[i], set()).add(want[i])
    assert all(len(roots) == 1 for roots in mixed.values())


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    got, want = groups_of(docs), brute.similar_groups(texts)
    pairs = brute.similar_pairs([t for _, t in texts])
    assert pairs and sum(got[texts[i][0]] == got[texts[j][0]] for i, j in pairs) >= 0.9 * len(pairs)
    assert len(set(got.values())) == len(set(want.values()))


def test_a_hub_costs_a_pair_a_member(documents, family, monkeypatch):
    hub = family[320:620]
    rows = S.prints_of(texts_of(documents(hub), "doc_id", "text"), 5, 42)
    nodes = rows.selectExpr("th as node", "prints").distinct()
    n = nodes.count()
    assert S.candidate_pairs(nodes.coalesce(1), 0).count() <= 40 * n < n * n / 4


def test_closest_forest_is_minimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = 30
        a, b, d = rng.integers(0, 12, n), rng.integers(0, 12, n), rng.integers(0, 9, n)
        keep = S.closest_forest(a, b, d, 12)
        root = list(range(12))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        cost = 0
        for e in sorted(range(n), key=lambda e: d[e]):  # Kruskal
            x, y = top(a[e]), top(b[e])
            if x != y:
                root[x], cost = y, cost + d[e]
        assert d[keep].sum() == cost


def test_stage_on_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "a b c d"), (None, "a b c d"), (7, "w " * 30_000),
            (8, "w " * 20_000), (9, "same text of some words here"), (9, "same text of some words here")]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in S.keep_first_similar(documents(rows)).collect())
    assert [(d, t) for _, d, t in got] == [(0, "a b c d"), (1, None), (4, "one"), (7, "w " * 30_000), (9, rows[-1][1])]
    assert S.keep_first_similar(documents([])).collect() == []


def test_spans_of_equal_rows_stay_linear(spark, documents):
    """Rows without an id that are equal share one set of spans."""
    text = " ".join(f"w{i}" for i in range(200))
    sizes = []
    for n in (30, 300):
        base = texts_of(documents([(None, text)] * n), "doc_id", "text")
        spans = base.selectExpr("id", "th", "explode(array(0, 5, 9)) begin", "4 size")
        sizes.append(sum(len(r.spans) for r in with_spans(base, spans).select("spans").collect()))
    assert sizes == [90, 900]


def test_three_thousand_equal_rows_without_an_id(documents):
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(1, "x " + text + " y")] + [(None, text)] * 3000
    assert {(r.n_removed, r.n_words) for r in substring_dedup(documents(rows)).where("doc_id is null").collect()} == {(0, 120)}
    gone = [r for r in suffix_dedup(documents(rows)).collect() if r.doc_id is None]
    assert len(gone) == 3000 and {r.n_removed for r in gone} == {len(text)}
