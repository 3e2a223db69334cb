"""Sources and sinks: recordings, requests, reports and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechreport.functions.columns import is_rtl
from speechreport.operators.validate import MAX_SLOTS
from speechreport.sources.schemas import RECORDINGS, SLOTS


def recording_id(spark: SparkSession, root: str, path: Column) -> Column:
    """A recording is known by its path below ``root``, or by its file name if root is a pattern or the file."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, 1_000_000)).otherwise(F.regexp_extract(path, r"([^/]*)$", 1))


def read_recordings(spark: SparkSession, path: str, glob: str = "*.{wav,mp3,flac,ogg,m4a,aac,aiff}") -> DataFrame:
    """binaryFile rows with recording_id. Ask for ``content`` only where it is decoded."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.withColumn("recording_id", recording_id(spark, path, F.col("path")))


def stream_recordings(spark: SparkSession, path: str, glob: str = "*.{wav,mp3,flac,ogg,m4a,aac,aiff}", files_per_trigger: int = 1000) -> DataFrame:
    """Each new file below path, once."""
    found = spark.readStream.format("binaryFile").schema(RECORDINGS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return found.withColumn("recording_id", recording_id(spark, path, F.col("path")))


#: White space in JSON, and the fields of a slot.
JSON_BLANKS = " \t\n\r"
SLOT_FIELDS = ("model", "api_key", "base_url", "language")


def parse_slots(text: Column) -> Column:
    """(slots, error) of slot JSON: a list of null or of objects with a model; {} and no text are no slots.

    A model is a string, the other fields are strings or null; of a repeated field the last counts.
    """
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(JSON_BLANKS))
    none = body.isin("", "[]", "null") | body.rlike(r"^[\[{]\s*[\]}]$")
    # in a list inside an object, text after the list makes the whole malformed, or adds an element or a key
    boxed = F.concat(F.lit('{"x":['), body, F.lit("]}"))
    shape = f"struct<x:array<array<struct<{','.join(f'{f}:variant' for f in SLOT_FIELDS)}>>>>"
    whole = F.from_json(boxed, shape, {"mode": "PERMISSIVE"})["x"]
    alone = (F.size(whole) == 1) & (F.size(F.json_object_keys(boxed)) == 1)
    found = F.get(whole, F.lit(0))
    told = lambda x: x.isNotNull() & ~F.is_variant_null(x)
    string = lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))
    loose = lambda x: F.coalesce(told(x) & ~string(x), F.lit(False))
    typed = lambda s: string(s["model"]) & ~loose(s["api_key"]) & ~loose(s["base_url"]) & ~loose(s["language"])
    good = none | F.coalesce(body.startswith("[") & alone & F.forall(found, lambda s: s.isNull() | typed(s)), F.lit(False))
    slots = F.transform(found, lambda s: F.when(s.isNotNull(), F.struct(*[F.try_variant_get(s[f], "$", "string").alias(f) for f in SLOT_FIELDS])))
    empty = F.array().cast("array<struct<model:string,api_key:string,base_url:string,language:string>>")
    return F.struct(F.when(none, empty).when(good, slots).alias("slots"), F.when(~good, F.lit("invalid slot JSON")).alias("error"))


def read_requests(df: DataFrame) -> DataFrame:
    """df with stt_slots parsed from stt_slots_json where that is given (run_slots), and status 400 and error
    if it is invalid. Slots of df itself are the session's and limited, those of a run are not."""
    own = F.col("stt_slots") if "stt_slots" in df.columns else F.lit(None).cast(SLOTS)
    parsed = df.withColumn("_parsed", parse_slots(F.col("stt_slots_json")))
    given = F.coalesce(F.btrim("stt_slots_json", F.lit(JSON_BLANKS)) != "", F.lit(False))
    over = given & (F.coalesce(F.size(own), F.lit(0)) > MAX_SLOTS)
    error = F.when(over, "more than 3 slots").otherwise(F.col("_parsed.error"))
    return parsed.withColumns({"stt_slots": F.when(given, F.col("_parsed.slots")).otherwise(own), "run_slots": given, "status": F.when(error.isNotNull(), 400), "error": error}).drop("_parsed", "stt_slots_json")


def write_reports(df: DataFrame, path: str, mode: str = "error") -> None:
    """Reports below path/pipeline=..., one JSON text (result) for each."""
    own = [c for c in ("request_id", "recording_id", "pipeline", "status", "error") if c in df.columns]
    result = F.to_json(F.struct(*[c for c in df.columns if c not in own]))
    df.select(*own, result.alias("result")).write.mode(mode).partitionBy("pipeline").parquet(path)


def report_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """df's other columns with line_no (from 0), line and rtl for each line of text; null is one empty line."""
    kept = [c for c in df.columns if c != text]
    lines = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line")
    return df.select(*kept, lines).withColumn("rtl", is_rtl(F.col("line")))
