"""Near-duplicates and repeated passages against plain versions, and the edges of their inputs."""

import random

import numpy as np
import pytest

from stampline.llm import decontaminate, simhash, substrings, suffixes
from stampline.llm.components import components
from stampline.llm.texts import PLAIN, Slice, batch_of, sliding_argmin

from . import brute


def changed(text, rng, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "changed"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows(prose):
    rng = random.Random(3)
    base = [prose(i, 150) for i in range(6)]
    passage = prose(99, 70)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10 + i, changed(base[i % 3], rng, 1 + i % 3)) for i in range(14)]
    rows += [(30 + i, prose(200 + i, 40) + "\n" + passage + "\t" + prose(300 + i, 30)) for i in range(9)]
    rows += [(50, base[0]), (51, base[0]), (52, "same " * 60), (53, ("ab " * 300).strip()), (54, ""), (55, "  \n"),
             (56, "two words"), (57, None), (58, passage + " " + passage), (59, "é" * 500), (60, "é" * 500)]
    return rows


def test_substrings_match_brute_force(documents, rows):
    got = sorted(map(tuple, substrings.substring_dedup(documents(rows)).collect()))
    assert got == brute.substrings(rows)


def test_substrings_without_the_pre_filter(documents, rows, monkeypatch):
    monkeypatch.setattr(substrings, "FILTER_ROOM", -1)
    got = sorted(map(tuple, substrings.substring_dedup(documents(rows)).collect()))
    assert got == brute.substrings(rows)


@pytest.mark.parametrize("room", [substrings.FILTER_ROOM, -1])
def test_a_common_passage_costs_a_few_rows_per_text(documents, prose, monkeypatch, room):
    passage = prose(7, 300)
    rows = [(i, f"{prose(1000 + i, 30)} {passage} {prose(2000 + i, 30)}") for i in range(30)]
    rows += [(40, passage), (41, passage.replace(" ", "  ")), (42, passage + " " + passage), (43, "ab " * 3000),
             (44, "ab " * 2000 + passage), (45, prose(1005, 30)), (46, passage)]
    made, later = [], substrings.later_places

    def counted(rows, firsts, keys):
        out = later(rows, firsts, keys)
        if "path" in keys:
            made.append(out.where("id between 1 and 29").count())
        return out

    monkeypatch.setattr(substrings, "FILTER_ROOM", room)
    monkeypatch.setattr(substrings, "later_places", counted)
    got = sorted(map(tuple, substrings.substring_dedup(documents(rows)).collect()))
    assert got == brute.substrings(rows)
    assert 29 <= sum(made) < 29 * (12 if room > 0 else 32)  # a row for each path would be some 42 a text


@pytest.mark.parametrize("room", [substrings.FILTER_ROOM, 1])
def test_many_minimizers_do_not_end_the_pre_filter(documents, prose, monkeypatch, room):
    """Paths and edges of texts without repeats stay out, however many repeated minimizers there are."""
    passage, made = prose(7, 80), {}
    rows = [(i, prose(5000 + i, 300)) for i in range(40)]
    rows += [(100 + i, f"{prose(6000 + i, 30)} {passage} {prose(7000 + i, 30)}") for i in range(5)]

    def counted(name):
        make = getattr(substrings, name)

        def run(*args):
            out = make(*args)
            made[name] = out.count()
            return out

        monkeypatch.setattr(substrings, name, run)

    monkeypatch.setattr(substrings, "FILTER_ROOM", room)
    counted("candidate_paths")
    counted("edges_of")
    got = sorted(map(tuple, substrings.substring_dedup(documents(rows)).collect()))
    assert got == brute.substrings(rows)
    assert 0 < made["candidate_paths"] < 100 and 0 < made["edges_of"] < 300  # of some 11,900 edges


def test_the_pre_filter_grows_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "bitmap", lambda rows, col, log_bits: log_bits)
    for room, bits in ((100, 26), (99, 27), (25, 28), (1, 29)):
        monkeypatch.setattr(substrings, "FILTER_ROOM", room)
        assert substrings.filter_of(spark.range(100), "id") == bits


def test_chains_lie_between_outer_paths_and_end_alike():
    class Line:
        core = np.array([1, 3, 5, 16, 7, 9, 11, 1, 3, 5, 5, 5], np.uint64)
        text = np.array([0] * 8 + [1] * 4)
        begin = np.array([0, 2, 4, 6, 8, 10, 13, 20, 30, 32, 34, 36])
        size = np.full(12, 2)

    assert [x.tolist() for x in substrings.chains_of(Line)] == [[1, 9], [3, 2]]


def test_kept_text_and_other_columns(documents, rows):
    df = documents(rows)
    kept = {r.doc_id: r.text for r in substrings.without_repeats(df).collect()}
    digests = {r.doc_id: r for r in substrings.substring_dedup(df, texts=True).collect()}
    for d, text in rows:
        assert kept[d] == (digests[d].kept if digests[d].n_removed else text)
    assert substrings.without_repeats(df).columns == df.columns


def test_suffixes_match_brute_force(documents, rows):
    got = sorted(map(tuple, suffixes.suffix_dedup(documents(rows)).collect()))
    assert got == brute.suffixes(rows)


@pytest.mark.parametrize("width,q", [(60, 30), (50, 20), (7, 4)])
def test_suffixes_with_crowded_buckets(documents, prose, monkeypatch, width, q):
    """Every bucket with more than two kinds of runs is dealt by finer ones."""
    monkeypatch.setattr(suffixes, "BUCKET_ROOM", 2)
    line = prose(5, 9)
    rows = [(i, prose(400 + i, 6) + " " + line + " " + prose(500 + i % 4, 6)) for i in range(12)]
    got = sorted(map(tuple, suffixes.suffix_dedup(documents(rows), width=width, q=q).collect()))
    assert got == brute.suffixes(rows, width)


def test_near_duplicates_match_brute_force(documents, rows):
    got = sorted(map(tuple, simhash.near_duplicates(documents(rows)).collect()))
    assert got == brute.near_duplicates(rows)


@pytest.mark.parametrize("blocks", [2, 3, 5])
def test_links_are_exact_in_crowded_anchors(spark, monkeypatch, blocks):
    """Random fingerprints with neighbours at every distance, anchors cut into slices of two homes."""
    monkeypatch.setattr(simhash, "HOMES", 2)
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:20]:
        for flips in range(1, 8):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), flips)))
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), blocks=blocks)
    got = {r.node: r.root for r in components(links, "a", "b").collect()}
    array = np.array([s for s, in signed], np.int64).view(np.uint64)
    near = np.bitwise_count(array[:, None] ^ array[None]) <= 4
    label = np.arange(len(array))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    same = lambda labels: {frozenset(np.flatnonzero(labels == x).tolist()) for x in set(labels.tolist())}
    roots = np.array([got.get(s, s) for s, in signed])
    assert same(roots) == same(label)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}


def test_one_row_of_each_component_stays(documents, rows):
    df = documents([*rows, rows[0]])
    kept = [r.doc_id for r in simhash.keep_first(df).collect()]
    assert sorted(kept) == sorted({c for *_, c in brute.near_duplicates(rows)})
    assert simhash.keep_first(df).columns == df.columns


@pytest.mark.parametrize("operator", [substrings.substring_dedup, suffixes.suffix_dedup, simhash.near_duplicates,
                                      substrings.without_repeats, simhash.keep_first])
def test_empty_tables_and_null_ids(documents, operator):
    assert operator(documents([])).collect() == []
    text = " ".join(f"w{i}" for i in range(200))
    got = operator(documents([(None, text), (1, text), (2, None)])).collect()
    assert {r.doc_id for r in got} >= {2}


def test_repeated_rows_are_one_text(documents):
    """A row seen twice is not a second place; different texts with one id are."""
    text, other = " ".join(f"w{i}" for i in range(200)), " ".join(f"v{i}" for i in range(200))
    for operator in (substrings.substring_dedup, suffixes.suffix_dedup):
        assert [r.n_removed for r in operator(documents([(1, text), (1, text), (1, other)])).collect()] == [0, 0, 0]
    got = suffixes.suffix_dedup(documents([(1, text + " x"), (1, text)])).collect()
    assert all(r.n_removed for r in got)


def test_a_very_long_text(documents, prose):
    text = prose(1, 200_000)
    w = text.split(" ")
    rows = [(1, text), (2, " ".join(w[:900])), (3, " ".join(w[-900:]))]
    got = {r.doc_id: r for r in suffixes.suffix_dedup(documents(rows)).collect()}
    assert got[2].n_removed == got[2].n_bytes and got[1].n_spans == 2
    got = {r.doc_id: r for r in substrings.substring_dedup(documents(rows)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == got[2].n_words


def test_sliding_argmin_is_the_leftmost():
    rng = np.random.default_rng(2)
    for width in (1, 2, 5, 13, 64):
        values = rng.integers(0, 9, 300)
        want = [i + int(np.argmin(values[i:i + width])) for i in range(300 - width + 1)]
        assert sliding_argmin(values, width).tolist() == want
    assert not len(sliding_argmin(np.arange(3), 5))


def test_words_of_slices():
    import pyarrow as pa

    texts = ["", " a  bé\tc", None, "d", "\n", "e f"]
    part = Slice(batch_of(text=pa.array(texts)).slice(1, 5), "text")
    w = part.words(PLAIN)
    assert w.count.tolist() == [3, 0, 1, 0, 2]
    joined, begin, end = w.joined()
    assert [joined[a:b].decode() for a, b in zip(begin, end)] == ["a", "bé", "c", "d", "e", "f"]
    assert joined.decode() == "a bé cde f"


def test_many_texts_without_an_id_stay_apart(documents, spark):
    """5,000 different texts share the null id; three of them share a passage, one of those a benchmark's."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    texts = [" ".join(word() for _ in range(60)) for _ in range(5000)]
    passage = " ".join(word() for _ in range(60))
    texts[:3] = [t + " " + passage for t in texts[:3]]
    df = documents([(None, t) for t in texts])
    assert sorted(r.text for r in simhash.keep_first(df).collect()) == sorted(texts)
    cut = [r.n_removed for r in substrings.substring_dedup(df).collect() if r.n_removed]
    assert cut == [60, 60]
    stay = [r.text for r in substrings.without_repeats(df).collect()]
    assert len(stay) == 5000 and len(set(stay) - set(texts)) == 2 and set(texts[3:]) <= set(stay)
    cut = [r.n_removed for r in suffixes.suffix_dedup(df).collect() if r.n_removed]
    assert cut == [len(passage) + 1] * 3  # and the space before it
    items = spark.createDataFrame([(1, " ".join(texts[0].split(" ")[:12]))], "item_id long, text string")
    assert sorted(r.text for r in decontaminate.keep_clean(df, items).collect()) == sorted(texts[1:])
