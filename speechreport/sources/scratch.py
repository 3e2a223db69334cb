"""Tables written between stages, and joins that are broadcast where a side is small."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that a broadcast may hold.
BROADCAST_BYTES = 64 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local master, whose driver is the only executor, gets a temporary folder; a
    cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/speechreport-{uuid.uuid4().hex}"


def dropped(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more; what was made from them must be written."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if re.search(r"/speechreport-[0-9a-f]{32}$", path):
                at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df as a scratch table that is read again, so that lineage ends there."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df marked for broadcast if its rows, ``row_bytes`` each at most, fit the bound; else df, which Spark then shuffles.

    df should be a written table: it is counted here and read again later.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
