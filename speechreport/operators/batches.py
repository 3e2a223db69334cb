"""Requests as batch files: JSON lines in files of bounded size, and answers matched to them by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechreport.operators.replies import reply_text
from speechreport.sources.scratch import small, written

#: Bytes that a batch file may hold.
FILE_BYTES = 100 << 20


def batch_line(key: Column, body: Column) -> Column:
    """A line {"custom_id": ..., "body": {...}}; ``body`` is JSON text without line ends, as to_json gives it; null gives {}."""
    told = F.to_json(F.struct(F.coalesce(key.cast("string"), F.lit("")).alias("custom_id")))
    return F.concat(F.substr(told, F.lit(1), F.length(told) - 1), F.lit(',"body":'), F.coalesce(body, F.lit("{}")), F.lit("}"))


def numbered(lines: DataFrame, limit: int = FILE_BYTES) -> DataFrame:
    """(file_no, line) of rows (line): running totals of bytes cut the lines into files of at most ``limit`` bytes, line ends included.

    A file holds the lines that begin within one stretch of half the limit, so it is at least about half full and no line decides
    where later ones go; a line of more than half the limit has a file of its own. Totals run within each task's lines and over
    the tasks' totals, so no task reads all lines. Null lines are left out.
    """
    size = (F.octet_length("line") + 1).cast("long")
    half = max(1, limit // 2)
    told = written(lines.filter("line is not null").select("line", size.alias("size")).withColumns({"task": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    fits = told.filter(F.col("size") <= half)
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = written(fits.groupBy("task").agg(F.sum("size").alias("n")).select("task", before.alias("base")))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("task").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = fits.withColumn("within", within).join(small(totals), "task").select(F.floor((F.col("base") + F.col("within")) / half).cast("string").alias("file_no"), "line")
    alone = told.filter(F.col("size") > half).select(F.concat(F.lit("x"), F.col("place").cast("string")).alias("file_no"), "line")
    return placed.unionByName(alone)


def write_batches(lines: DataFrame, path: str, limit: int = FILE_BYTES) -> None:
    """Writes rows (line) as ``path``/file_no=.../part-*, one text file in each folder, of at most ``limit`` bytes unless one line is longer."""
    numbered(lines, limit).repartition("file_no").select("file_no", F.col("line").alias("value")).write.partitionBy("file_no").text(path)


def match_answers(requests: DataFrame, answers: DataFrame, key: str = "request_id", shape: str = "chat") -> DataFrame:
    """requests with reply, status and error from rows (value) of answers, JSON lines with custom_id, response.status_code and response.body.

    A request without an answer, with several, with another status than 200 or without a text in it has status 502; the others have none.
    Answers to ids that nobody asked are left out, as are lines without an id. Requests that share an id share its answer; null and '' are
    one id. Answers are counted by id before the join, which doesn't carry the answers of an id twice.
    """
    at = lambda p: F.get_json_object("value", p)
    found = answers.select(at("$.custom_id").alias("_id"), at("$.response.status_code").alias("_code"), reply_text(at("$.response.body"), shape).alias("_reply")).filter("_id is not null")
    by_id = found.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("_code", "_reply"), F.xxhash64("_code", "_reply")).alias("_one"))
    kept = [F.col(c) for c in requests.columns if c not in ("reply", "status", "error")]
    joined = requests.select(*kept, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id")).join(by_id, "_id", "left")
    code = F.coalesce(F.col("_one._code"), F.lit("none"))
    error = (
        F.when(F.col("_n").isNull(), "no answer").when(F.col("_n") > 1, F.concat(F.col("_n").cast("string"), F.lit(" answers")))
        .when(code != "200", F.concat(F.lit("answer has status "), code)).when(F.col("_one._reply").isNull(), "answer has no text")
    )
    joined = joined.withColumn("error", error).withColumn("status", F.when(F.col("error").isNotNull(), 502))
    return joined.select(*kept, F.when(F.col("error").isNull(), F.col("_one._reply")).alias("reply"), "status", "error")
