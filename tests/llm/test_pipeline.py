"""The pipeline's stages on a small corpus: each against the plain version on its own input."""

import pytest

import corpus_pipeline
from stampline.llm import queries
from stampline.llm.texts import written

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF))
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "BPE encoding"]


def test_quality_stage_keeps_good_documents(spark, steps):
    before, after = steps[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    scored = {r.doc_id: r.predicted for r in queries.QUERIES["op1_quality_classifier"](spark, SF).collect()}
    assert kept == {d for d, p in scored.items() if p}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)


def test_near_duplicates_stage(steps):
    before, after = steps[1]
    want = sorted({(d, t) for d, t in rows(before)})
    group = brute.similar_groups(want)
    assert sorted(rows(after)) == [want[i] for i in sorted(set(group.values()))]


def test_substring_stage(steps):
    before, after = steps[2]
    want = {d: (n, removed, sha) for d, n, removed, sha in brute.substrings(rows(before))}
    texts = dict(rows(before))
    for r in after.collect():
        n, removed, sha = want[r.doc_id]
        assert (brute.sha(r.text) == sha if removed else r.text == texts[r.doc_id])
        assert r.n_chars == len(r.text)
    assert after.count() == before.count()


def test_decontamination_stage(spark, steps):
    before, after = steps[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {d for d, *_, bad in brute.contamination(rows(before), items) if not bad}
    assert {r.doc_id for r in after.collect()} == want


def test_encoding_stage(steps):
    from tokenizers import Tokenizer

    before, after = steps[4]
    library, texts = Tokenizer.from_file(queries.tokenizer_path()), dict(rows(before))
    got = after.collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_columns_of_documents_stay(steps):
    assert all(after.columns == before.columns for before, after in steps[:-1])


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()
    assert sorted(got) == sorted(steps[-1][1].select("doc_id", "ids_sha256").collect())


def test_a_table_without_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_nulls_repeats_and_clashing_columns(spark):
    """Rows with nulls in any column, repeated rows, empty and long texts, and columns with the stages' names."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (90001, None, "en", "src", 0), (90002, "", None, "src", 0),
         (90003, " \n ", "en", None, 3), (90004, "word " * 30_000, "en", "src", None), (None, "text without an id", "en", "s", 18),
         (90005, "a b c", "en", "s", 5), (90005, "a b c", "en", "s", 5)], docs.schema)
    names = ("id", "th", "text_", "score", "spans", "row", "fp", "window", "item", "path", "core", "y", "quality", "place")
    docs = docs.union(odd).union(odd).withColumns({n: F.lit(None).cast("string") if i % 2 else F.lit(i)
                                                   for i, n in enumerate(names)})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF))
        assert docs.columns == columns, name
        if name == "SimHash near-dedup":
            assert docs.count() == docs.select("doc_id", "text").distinct().count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() > 0
