"""The registered queries of this subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.llm import sql
from gneiss.llm.chat_format import digest_chats, format_chats
from gneiss.llm.decontaminate import leaked_pairs
from gneiss.llm.exact_dedup import exact_groups
from gneiss.llm.license_scan import scan_licenses
from gneiss.llm.mixing import mix_sources
from gneiss.llm.pii import find_pii
from gneiss.llm.quality_classifier import score_quality
from gneiss.llm.quality_rules import judge_quality
from gneiss.llm.session import new_path, table
from gneiss.llm.simhash import simhash_groups
from gneiss.llm.token_store import tokenize
from gneiss.llm.url_filter import filter_urls
from gneiss.llm.vector_codes import compress
from gneiss.llm.whitening import whiten

#: The conversation that the chat query adds to the table: both turns hold what other templates use as marks.
EXTRA_CHAT = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]

#: (host, path, action) of the URL query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path() -> str:
    """The production tokenizer's file, which is on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(EXTRA_CHAT, turns.schema))
    path = new_path(spark, "chats")
    format_chats(turns).write.parquet(path)
    return digest_chats(spark.read.parquet(path))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, radius=2)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation as a long, null beyond one; the operator has up to 38 digits."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_pii, op3_quality_rules, op4_license_scan, op5_mixing, op6_url_filter, op7_quality_classifier, op8_simhash, op9_token_ids, op10_decontaminate, op11_exact_dedup, op12_whitening, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLE
