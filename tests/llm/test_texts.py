"""Classifier, rules, languages, tokens, licenses, urls and contamination: plain versions, accuracy, edges."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stampline.llm import bpe, decontaminate, languages, licenses, quality, queries, rules, url_filters
from stampline.llm.texts import Slice, batch_of, keyed

from . import brute

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "!!! 123"), (None, "null id text"), (5, "x" * 3000), (6, "a\n\n\nb\nb\nb")]


# Quality -------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def graded(prose):
    rng = random.Random(1)
    good = [(100 + i, prose(i, 60) + ".") for i in range(150)]
    bad = [(1000 + i, " ".join(w + rng.choice(["***", "$$$", "###"]) for w in prose(5000 + i, 60).split()))
           for i in range(75)]
    bad += [(2000 + i, " ".join(w for w in prose(7000 + i, 6).split() for _ in range(10))) for i in range(75)]
    return good, bad


def labels_of(spark, good, bad):
    rows = [(d, 1) for d, _ in good] + [(d, 0) for d, _ in bad]
    return spark.createDataFrame([*rows, (None, 1), (good[0][0], 1), (99999, 0)], "doc_id long, quality int")


def test_classifier_on_held_out_texts(spark, documents, graded):
    good, bad = graded
    got = quality.quality_scores(documents([*good, *bad, *EDGES]), labels_of(spark, good, bad)).collect()
    truth = {d: 1 for d, _ in good} | {d: 0 for d, _ in bad}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60
    wrong = [(r.doc_id, r.score) for r in held if r.predicted != truth[r.doc_id]]
    assert len(wrong) < 0.05 * len(held), wrong
    assert len(got) == len(good) + len(bad) + len(EDGES)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_held_out_labels_do_not_matter(spark, documents, graded):
    good, bad = graded
    df, labels = documents([*good, *bad]), labels_of(spark, good, bad)
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id", 3, 1), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    scores = [sorted((r.doc_id, r.score) for r in quality.quality_scores(df, x).collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_classifier_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_scores(documents(EDGES), none).collect()
    assert [r.score for r in got] == [0.5] * len(EDGES)
    assert quality.quality_scores(documents([]), none).collect() == []


def test_ftrl_separates():
    model, rng = quality.Ftrl(4, l1=0.0), np.random.default_rng(0)
    for _ in range(400):
        y = int(rng.integers(2))
        model.update(np.array([0 if y else 1, 4]), np.array([1.0, 1.0]), float(y))
    w = model.weights(slice(None))
    assert w[0] > 1 and w[1] < -1 and w[2] == w[3] == 0


def test_statistics_match_brute_force(documents, prose):
    rng = random.Random(4)
    rows = [*EDGES]
    for i in range(40):
        lines = [prose(rng.randrange(5), rng.randrange(0, 12)) + rng.choice(["", "#", " <|> "]) for _ in range(8)]
        rows.append((100 + i, "\n".join(lines)))
    got = {r.doc_id: tuple(r)[1:6] for r in rules.apply_rules(documents(rows), []).collect()}
    assert got == {d: brute.statistics(t) for d, t in rows}


def test_rules_reject_what_they_learned(spark, documents, graded):
    good, bad = graded
    df = documents([*good, *bad])
    learned = rules.quality_rules(keyed(df, "doc_id", "text"), labels_of(spark, good, bad))
    assert learned and all(rule for rule in learned)
    kept = {r.doc_id: r.kept for r in rules.apply_rules(df, learned).collect()}
    assert np.mean([kept[d] for d, _ in good]) > 0.97
    assert np.mean([not kept[d] for d, _ in bad]) > 0.95


def test_base_rules_hold_without_learned_ones(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(1, "w " * 19), (2, " ".join(f"w{i}" for i in range(20))), (3, "a b c d e f g h " * 5), *EDGES[:3]]
    df = documents(rows)
    learned = rules.quality_rules(keyed(df, "doc_id", "text"), none)
    assert learned == []
    got = {(r.doc_id, r.base_failed, r.kept) for r in rules.apply_rules(df, learned).collect()}
    assert {(1, True, False), (2, False, True), (3, True, False)} <= got
    assert rules.apply_rules(documents([]), []).collect() == []


def test_a_rule_list_is_an_ordered_conditional():
    x = {"a": np.array([1.0, 1, 5, 5, 9, 9] * 20), "b": np.arange(120.0)}
    learned = rules.learn_rules(x, x["a"] == 5)
    hits = np.zeros(120, bool)
    for rule in learned:
        hits |= rules._hits(x, rule)
    assert (hits == (x["a"] == 5)).all()


# Languages -----------------------------------------------------------------------------------------

def test_the_shortcut_around_viterbi_is_exact(monkeypatch):
    """Also where two languages, each for a part, beat the best overall language that no path needs."""
    from types import SimpleNamespace

    rng = np.random.default_rng(12)
    texts = [np.array([[20.0, -30, 0], [-30, 20, 0]])] + [rng.normal(0, 10, (rng.integers(1, 12), 3)) for _ in range(400)]
    scores, first = np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts]))
    monkeypatch.setattr(languages, "word_scores", lambda words, profiles: scores)
    short = languages.label_words(SimpleNamespace(first=first), None, languages.SWITCH)
    assert short[:2].tolist() == [0, 1]
    assert (short == languages.viterbi(scores, first, languages.SWITCH)).all()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(60):
        first = np.append(0, np.cumsum(rng.integers(0, 6, 4)))
        scores = rng.normal(0, 3, (first[-1], 3))
        path = languages.viterbi(scores, first, 2.0)

        def value(q, a, scores=scores):
            return sum(scores[a + i, k] for i, k in enumerate(q)) - 2.0 * sum(x != y for x, y in zip(q, q[1:]))

        for a, b in zip(first[:-1], first[1:]):
            best = max(value(q, a) for q in itertools.product(range(3), repeat=b - a))
            assert abs(value(path[a:b], a) - best) < 1e-9


def test_the_shortcut_agrees_with_the_programme(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = languages.learn_profiles(docs.select(F.col("doc_id").alias("id"), "text", "lang").limit(300))
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    texts += [texts[0][:300] + " " + texts[5][:300] + " " + texts[9][:300]]
    words = languages.WordBytes(Slice(batch_of(text=pa.array(texts)), "text"))
    scores = languages.word_scores(words, profiles)
    short = languages.label_words(words, profiles, languages.SWITCH)

    def value(path):
        steps = (path[1:] != path[:-1]) & (np.repeat(np.arange(len(texts)), np.diff(words.first))[1:]
                                           == np.repeat(np.arange(len(texts)), np.diff(words.first))[:-1])
        return scores[np.arange(len(path)), path].sum() - languages.SWITCH * steps.sum()

    assert abs(value(short) - value(languages.viterbi(scores, words.first, languages.SWITCH))) < 1e-6


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = languages.language_predictions(docs).join(docs.select("doc_id", "lang", "text"), "doc_id")
    held = got.where("held_out and length(text) > 60").collect()
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_mixed_text_and_scripts(spark):
    rows = [(i, t, lang) for i in range(40) for t, lang in (
        ("the house and the garden with that thing", "en"), ("το σπίτι και ο κήπος με αυτό", "el"),
        ("дом и сад с этой вещью", "ru"), ("der garten und das haus mit dem ding", "de"))]
    rows = [(n, t, lang) for n, (_, t, lang) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    profiles = languages.learn_profiles(docs)
    mixed = spark.createDataFrame(
        [(1, "the house and the garden " * 3 + "дом и сад с этой вещью " * 3), (2, "123 !"), (3, None), (4, "κήπος"),
         (5, "漢字")], "doc_id long, text string")
    got = {r.doc_id: r for r in languages.identify(mixed, profiles).collect()}
    assert (got[1].lang_pred, got[1].n_spans) == ("en", 2) and 0.4 < got[1].score < 0.7
    assert [got[i].lang_pred for i in (2, 3)] == ["und", "und"] and got[2].score == 0
    assert got[4].lang_pred == "el" and got[5].lang_pred in profiles.languages
    spans = languages.language_spans(mixed.where("doc_id = 1"), profiles).orderBy("first_word").collect()
    assert [(s.lang, s.n_words) for s in spans] == [("en", 15), ("ru", 18)]


def test_no_language_learned(spark):
    rows = [(1, "some text", None), (2, None, "en"), (None, "text", "en")]
    got = languages.language_predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [r.lang_pred for r in got] == ["und"] * 3
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert languages.language_predictions(empty).collect() == []


# Tokens --------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_tokens_equal_the_library(library):
    mine, rng = bpe.tokenizer(queries.tokenizer_path()), random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz'0123 ÉéßΣσǅİ\u0085\x1c\n\t-<|>.!中文カ\u0301ﬁ€😀"
    texts = ["", " ", "<|endoftext|>", "a<|startoftext|><|endoftext|>b", "<|ENDOFTEXT|>", "eeeee aaaaaaa iiih", "Σας ΟΔΟΣ"]
    texts += ["".join(rng.choice(letters if i % 2 else "aeihtns ") for _ in range(rng.randrange(40))) for i in range(3000)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == want, text
        assert mine.decode(want) == library.decode(want, skip_special_tokens=False)


def test_token_digests(documents, library):
    rows = [*EDGES, (7, "Hello wörld, it's 2024! <|endoftext|>"), (7, "Hello wörld, it's 2024! <|endoftext|>")]
    got = bpe.bpe_digests(documents(rows), queries.tokenizer_path(), tokens=True).collect()
    seen = {r.doc_id: r for r in got}
    for d, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = seen[d]
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, decoded)
        assert r.ids_sha256 == brute.sha(np.array(ids, "<u4").tobytes()) and r.decoded_sha256 == brute.sha(decoded)
    assert len(got) == len(rows)


def test_automaton_of_few_merges():
    """Every word over a small alphabet, against merging by rank."""
    merges = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "a"), ("aa", "aa"), ("b", "ab"), ("ba", "ba")]
    vocab = {t: i for i, t in enumerate(["a", "b", *(x + y for x, y in merges)])}
    automaton, rank = bpe.Automaton(vocab, merges), {m: i for i, m in enumerate(merges)}

    def merged(word):
        parts = list(word)
        while True:
            best = min(((rank.get(p, 99), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(99, 0))
            if best[0] == 99:
                return [vocab[p] for p in parts]
            parts[best[1]:best[1] + 2] = ["".join(parts[best[1]:best[1] + 2])]

    for n in range(1, 11):
        for word in map("".join, itertools.product("ab", repeat=n)):
            assert automaton.encode(word) == merged(word), word


# Licenses, urls, contamination ---------------------------------------------------------------------

def test_licenses_in_lines(documents):
    rows = [*EDGES, (10, "Licensed under CC BY-NC 4.0."), (11, "code\nLicensed under the\nApache License, Version 2.0"),
            (12, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
            (13, "Redistribution and use in source and binary forms, with or without modification, are allowed"),
            (14, "GNU General Public License version 3 mit license MIT LICENSE"), (15, "CC BY"), (15, "CC BY")]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.license_scan(documents(rows)).collect()}
    assert got[10] == (7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc-4.0", 1.0)
    assert got[11][4:] == ("apache", "apache,apache-2.0", 1.0)
    assert got[12][4:] == ("apache,mit", "apache,apache-2.0,mit,mit-notice", 1.0)
    assert got[13][4:6] == ("", "bsd") and 0.9 <= got[13][6] < 1
    assert got[14][:4] == (10, 3, 0, 8) and got[14][5] == "gpl,gpl-3.0,mit"
    assert got[1] == (0, 0, None, None, "", "", 0.0)


def test_license_labels_as_meant(documents):
    """Labels from what was written, not from sets of words: variants apart, wrapped notices whole."""
    bsd = "Redistribution and use in source and binary forms,\nwith or without modification, are permitted"
    meant = {
        "Licensed under CC BY 4.0.": "cc-by,cc-by-4.0", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "licensed under CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
        "Code: Licensed under CC BY 4.0. Pictures: Licensed under CC BY-NC 4.0.": "cc-by,cc-by-4.0,cc-by-nc-4.0",
        "Licensed under CC BY 4.0, NC": "cc-by,cc-by-nc-4.0",  # the larger one at the same place
        bsd: "bsd", f"a b c\n{bsd}\nd e": "bsd",
        "public here, version there, gnu and 3, general words, a license": "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and "
        "associated documentation files": "mit-notice",
        "Released under\nthe MIT\nLicense": "mit,mit-notice"}
    rows = list(enumerate(meant))
    got = {r.doc_id: r.labels for r in licenses.license_scan(documents(rows)).collect()}
    assert got == dict(enumerate(meant.values()))


def test_license_long_text_of_one_notice(documents):
    notice = "GNU General Public License version 3. "
    rows = [(1, notice * 20_000), (2, "word " * 200_000 + notice)]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.license_scan(documents(rows)).collect()}
    assert got[1] == (120_000, 20_000, 0, 119_994, "gpl", "gpl,gpl-3.0", 1.0)
    assert got[2] == (200_006, 1, 200_000, 200_000, "gpl", "gpl,gpl-3.0", 1.0)


def test_license_join_is_exact(documents):
    """Filters lose no pair: every template and block over a small vocabulary."""
    rng = random.Random(8)
    templates = [(f"t{i}", " ".join(rng.choices("abcdefgh", k=rng.randint(1, 6)))) for i in range(8)]
    rows = [(i, "\n".join(" ".join(rng.choices("abcdefghxyz", k=rng.randint(0, 9))) for _ in range(3)))
            for i in range(60)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(
        documents(rows), templates=templates, threshold=0.6, phrases={}).collect()}
    for d, text in rows:
        words, fits = text.split(), []
        for label, template in templates:
            want, size = set(template.split()), len(template.split())
            for s in range(max(len(words) - size, 0) + 1):
                share = len(want & set(words[s:s + size])) / len(want)
                if share >= 0.6 - 1e-9:
                    fits.append((label, want, s, s + size, share))
        fits = [f for f in fits if not any(f[1] < g[1] and g[2] <= f[2] and g[3] >= f[3] for g in fits)]
        assert got[d] == (",".join(sorted({f[0] for f in fits})), max([f[4] for f in fits], default=0.0)), text
    none = licenses.license_scan(documents(rows), templates=[], phrases={}).collect()
    assert {(r.labels, r.score) for r in none} == {("", 0.0)}
    assert licenses.license_scan(documents([])).collect() == []


URLS = [None, "", "no scheme", "http://", "http://com/", "http://a.com", "HTTP://WWW.Example.COM/en/1",
        "http://example.com/en/x?y#z", "http://x.www.example.com/en/", "http://example.com/EN/", "http://a.net/es/1",
        "http://net/fr/", "http://a.net?es/", "http://evilexample.com/en/", "http://a.com:80/en/", "x://y.net#/es/",
        "http://a://b.com/en/", "//a.net/es/", "http://.com/", "http://example.com/en", "http://a.net/es/\nb"]


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:cut].translate(brute.LOWER), rest[cut:]
        path = tail[:min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [(len(h) + len(p), len(h), a, h + p) for h, p, a in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, default)


def test_urls_match_brute_force(spark):
    rng = random.Random(2)
    urls = URLS + ["http://" + ".".join(rng.choices(["a", "b", "c-d", "com"], k=rng.randint(1, 4)))
                   + rng.choice(["", "/", "/x", "/x/y", "?q"]) for _ in range(300)]
    rules = queries.URL_RULES + [("a.b", "/", "block"), ("b", "/x", "block"), ("a.b", "/x/", "allow"),
                                 ("c-d.a.b", "/x", "block"), ("com", "/x/y", "block"), ("com", "/x/y", "allow")]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    got = {r.page_id: tuple(r)[1:] for r in url_filters.url_verdicts(pages, table).collect()}
    assert got == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}


def test_urls_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    got = url_filters.url_verdicts(pages, none, default="block").collect()
    assert sorted(tuple(r)[1:] for r in got) == [("", "", None, "block"), *[("a.com", "/", None, "block")] * 2]
    assert url_filters.url_verdicts(pages.limit(0), none).collect() == []


@pytest.fixture(scope="module")
def items(spark, prose):
    rows = [(i, prose(900 + i, 25)) for i in range(5)] + [(5, "Short Item here"), (6, "one"), (7, ""), (8, None),
            (9, prose(900, 25)), (None, prose(903, 25)), (10, "the the the the"), (11, prose(911, 9))]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, id int")


def test_contamination_matches_brute_force(documents, items, prose):
    rows = [*EDGES]
    for i in range(40):
        w = prose(950 + i, 30).split()
        source = (items[0][i % 12][1] or "").upper().split()
        a = i % 7
        w[10:10] = source[a:a + 8 + i % 6]
        rows.append((100 + i, ", ".join(w)))
    rows += [(300, "The, THE the. the the"), (301, "short item HERE short item here"), (301, "clean")]
    got = sorted(map(tuple, decontaminate.decontaminate(documents(rows), items[1]).collect()), key=str)
    assert got == sorted([x for row in rows for x in brute.contamination([row], items[0])], key=str)
    clean = decontaminate.keep_clean(documents(rows), items[1])
    bad = {(x[0], x[4]) for x in got if x[5]}
    assert clean.count() == sum(not x[5] for x in got) and bad
    assert clean.columns == documents(rows).columns


def test_nothing_to_contaminate(documents, items):
    assert decontaminate.decontaminate(documents([]), items[1]).collect() == []
    got = decontaminate.decontaminate(documents(EDGES), items[1].limit(0)).collect()
    assert {(r.n_hit, r.n_items, r.contaminated) for r in got} == {(0, 0, False)} and len(got) == len(EDGES)
