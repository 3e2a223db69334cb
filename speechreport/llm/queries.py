"""The thin queries that apply each operator to its whole table, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechreport.llm import budget_mix, chat_snapshots, fill_middle, host_rules, license_join, media, mil_quality, minhash_join, ngram_join, oracles, packing, range_coder, spelling, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.write_and_read(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "word")
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.collapse_and_render(_table(spark, sf_dir, "conversations"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_table(spark, sf_dir, "documents"))


def op7_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = range_coder.write_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.apply_rules(_table(spark, sf_dir, "documents"), out_keep=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.store_and_resolve(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op10_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_mix.mix(_table(spark, sf_dir, "documents"))


def op11_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.link(_table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.transform(_table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_mil_quality, op2_warc, op3_license_join, op4_packing, op5_chat_snapshots, op6_ngram_join, op7_range_coder,
    op8_host_rules, op9_media, op10_budget_mix, op11_minhash_bayes, op12_fill_middle, op13_spelling,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in OPERATORS}
ORACLES: dict[str, str] = {
    "op2_warc": oracles.WARC,
    "op3_license_join": oracles.license_sql(),
    "op5_chat_snapshots": oracles.CHAT,
    "op6_ngram_join": oracles.JACCARD,
    "op8_host_rules": oracles.HOSTS,
    "op11_minhash_bayes": oracles.MINHASH,
    "op12_fill_middle": oracles.FILL_MIDDLE,
    "op13_spelling": oracles.SPELLING,
}
