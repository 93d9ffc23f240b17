"""Corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Documents that the quality classifier rejects go; of each group of near-duplicates one stays; long passages that
came earlier are cut out; documents with benchmark passages go; what is left is encoded. Stages keep the columns
of documents, the last one returns tokens and digests. A stage without rows gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stampline.llm import bpe, decontaminate, quality, similar, substrings
from stampline.llm.queries import table, tokenizer_path
from stampline.llm.texts import keyed, written

#: The classifier is learned and SQL cannot express it.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, learned from these documents' labels, scores below 0.5."""
    model = quality.learned(keyed(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates: five-word shingles, Jaccard
    similarity 0.8 or more, candidates by anchor-point covering of SimHashes."""
    return similar.keep_first_similar(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words out of passages of 20 words and more that came earlier."""
    return substrings.without_repeats(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded."""
    return bpe.bpe_digests(docs, tokenizer_path(), tokens=True)


STAGES = [("quality classifier", good), ("SimHash near-dedup", distinct), ("substring dedup", unrepeated),
          ("benchmark decontamination", clean), ("BPE encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
