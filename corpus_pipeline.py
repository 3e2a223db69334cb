"""A training corpus in five stages, each written as Parquet and read again as the next one's docs.

Stages take (spark, docs, sf_dir). All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechreport.llm import budget_mix, host_rules, mil_quality, ngram_join, packing
from speechreport.llm.common import materialize, scratch_dir, small

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level rules keep.

    Null and empty texts have too few words and go; very long texts are measured whole. A null source is a
    host of its own, ids are not looked at, repeated rows are judged each. An empty table gives an empty
    table, extra columns are not read.
    """
    return host_rules.apply_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds to be good.

    It is fitted on labelled rows of the whole table: the rules have already taken most of the bad
    ones from docs, and a model that has seen few of them would reject good documents. Null and empty texts
    are scored as one passage without words, very long ones whole; a score of 0.5 is good. Ids and sources
    are not looked at, repeated rows are scored each. An empty table gives an empty table, extra columns are
    not read.
    """
    model = mil_quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mil_quality.score(docs.select(*COLUMNS), model, keep_text=True).filter("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Documents without an id and without words link to nothing and stay. Of rows that share an id one stays,
    the least by text, language, source and length. Very long texts are compared whole, a similarity of
    just 0.8 links. An empty table gives an empty table, extra columns are not read.
    """
    linked = materialize(ngram_join.link(docs))
    others = materialize(linked.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct())
    kept = docs.select(*COLUMNS).join(small(others), "doc_id", "left_anti").select(*COLUMNS)
    repeated = linked.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return kept
    one = kept.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("_row"))
    return one.select("doc_id", "_row.*").unionByName(kept.filter("doc_id is null"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it leaves out go.

    Null and empty texts have no words and go; very long ones count whole. A null source is the last one.
    Each row is taken by itself, also if it has no id or shares one; of equal rows some may be taken more
    often. An empty table gives an empty table, extra columns are not read.
    """
    mixed = budget_mix.mix(docs.select(*COLUMNS), keep=list(COLUMNS))
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    return mixed.filter("taken > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens.

    Null and empty texts are the end id alone; very long texts are cut into many pieces. Rows that repeat
    are packed each; null ids and sources are kept as they are. An empty table gives no pieces, extra columns
    are not read.
    """
    return packing.pack(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"), "word")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The classifier and the packing of token ids are not expressible in SQL.
ORACLE_SQL: str | None = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
