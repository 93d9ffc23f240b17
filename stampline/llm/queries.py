"""The registered queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stampline.llm import oracles
from stampline.llm.bpe import bpe_digests
from stampline.llm.conversations import conversation_repair
from stampline.llm.decontaminate import decontaminate
from stampline.llm.languages import language_predictions
from stampline.llm.licenses import license_scan
from stampline.llm.negatives import mined_negatives
from stampline.llm.pages import main_text
from stampline.llm.quality import quality_scores
from stampline.llm.rules import apply_rules, quality_rules
from stampline.llm.simhash import near_duplicates
from stampline.llm.substrings import substring_dedup
from stampline.llm.suffixes import suffix_dedup
from stampline.llm.texts import keyed
from stampline.llm.url_filters import url_verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_quality_classifier")
def op1(spark, sf):
    return quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op2_quality_rules")
def op2(spark, sf):
    docs = table(spark, sf, "documents")
    rules = quality_rules(keyed(docs, "doc_id", "text"), table(spark, sf, "labels"))
    return apply_rules(docs, rules)


@query("op3_decontamination", oracles.DECONTAMINATION)
def op3(spark, sf):
    return decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op4_simhash_anchors")
def op4(spark, sf):
    return near_duplicates(table(spark, sf, "documents"))


@query("op5_language_id")
def op5(spark, sf):
    return language_predictions(table(spark, sf, "documents"))


@query("op6_bpe_automaton")
def op6(spark, sf):
    return bpe_digests(table(spark, sf, "documents"), tokenizer_path())


@query("op7_suffix_buckets")
def op7(spark, sf):
    return suffix_dedup(table(spark, sf, "documents"))


@query("op8_url_filters", oracles.URL_FILTERS)
def op8(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_verdicts(table(spark, sf, "pages"), rules)


@query("op9_license_scan", oracles.LICENSES)
def op9(spark, sf):
    return license_scan(table(spark, sf, "documents"))


@query("op10_substring_dedup", oracles.SUBSTRINGS)
def op10(spark, sf):
    return substring_dedup(table(spark, sf, "documents"))


@query("op11_hard_negatives", oracles.HARD_NEGATIVES)
def op11(spark, sf):
    return mined_negatives(table(spark, sf, "embeddings"))


@query("op12_html_extraction")
def op12(spark, sf):
    return main_text(table(spark, sf, "pages"))


@query("op13_conversation_repair", oracles.CONVERSATIONS)
def op13(spark, sf):
    return conversation_repair(table(spark, sf, "conversations"))
