"""Helpers that several operators share: words and running totals, and the scratch tables of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechreport.sources.scratch import dropped, scratch_dir, small
from speechreport.sources.scratch import written as materialize

__all__ = ["dropped", "materialize", "scratch_dir", "small", "with_starts", "words"]

#: ASCII white space, the separator of the word contracts, inside a Java character class.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; null has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+"))


def with_starts(df: DataFrame, order: list[str], size: str, by: str | None = None, start: str = "start") -> DataFrame:
    """Adds the sum of ``size`` over the rows before each row in ``order`` (among equal ``by``).

    Rows are dealt in ranges of ``order``. Sums within a range and sums over the totals of ranges
    give the result, so neither one hot value of ``by`` nor the whole table meets in one task.
    Null values of ``by`` count as one value. Ties in ``order`` get some order of their own.
    """
    key = F.lit(0) if by is None else F.struct(F.col(by).isNull().alias("none"), F.coalesce(F.col(by), F.lit("")).alias("name"))
    dealt = df.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id(), "_key": key})
    dealt = materialize(dealt)
    within = Window.partitionBy("_range", "_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range", "_key").agg(F.sum(size).alias("_total"))
    bases = materialize(totals.select("_range", "_key", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base")))
    found = dealt.withColumn("_within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return found.join(bases, ["_range", "_key"]).withColumn(start, F.col("_base") + F.col("_within")).drop("_range", "_key", "_base", "_within")
