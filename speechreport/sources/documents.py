"""A sink for documents: one text file for each report, under a generated name, committed task by task."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from speechreport.sources.scratch import dropped, small, written

FORMAT = "speechreport_documents"
#: Bytes of a file name that is used as it is; longer ones are cut and told apart by a digest.
NAME_BYTES = 200
STAGED = "_staged"
#: Bytes of texts that are read at a time.
READ_BYTES = 16 << 20


def found_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or URI, and the folder there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    """The folder of one task's files; None if the task had no rows."""

    folder: str | None


class DocumentWriter(DataSourceArrowWriter):
    """Writes rows (name, text) to a folder of the task's own, which the commit of the whole job moves to its place by one rename.

    What a failed or repeated task has written is never moved, and deleted at the end of the job.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def store(self) -> tuple[fs.FileSystem, str]:
        return found_store(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = self.store()
        folder = None
        for batch in iterator:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if folder is None:
                    folder = f"part-{uuid.uuid4().hex}"
                    store.create_dir(f"{root}/{STAGED}-{self.job}/{folder}", recursive=True)
                with store.open_output_stream(f"{root}/{STAGED}-{self.job}/{folder}/{name}") as f:
                    f.write(f"{text or ''}\n".encode())
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = self.store()
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.base_name.startswith("part-"):
                    store.delete_dir(old.path)
        for m in messages:
            if m is not None and m.folder is not None:
                store.move(f"{root}/{STAGED}-{self.job}/{m.folder}", f"{root}/{m.folder}")
        self.cleared(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self.cleared(*self.store())

    def cleared(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{STAGED}-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{STAGED}-{self.job}")


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return DocumentReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], overwrite)


def numbered(df: DataFrame, name: str, key: str) -> DataFrame:
    """df with its names made different: of rows with one name, in order of key, the second gets _2 before the extension, and so on.

    Rows are dealt in ranges of name and key, numbered there, and numbers of earlier ranges added, so that a name that very many rows
    share does not meet in one task. Rows that share name and key get some order. Only names and keys are written for this.
    """
    dealt = df.select(F.col(name).alias("_name"), F.col(key).alias("_key")).repartitionByRange("_name", "_key").withColumn("_part", F.spark_partition_id())
    rows = written(dealt)
    counts = rows.groupBy("_name", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.select("_name", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy("_name")).alias("_all")).filter("_all > 1"))
    own = F.row_number().over(Window.partitionBy("_name", "_part").orderBy("_key"))
    clashes = rows.join(small(bases), ["_name", "_part"]).select("_name", "_key", (own + F.col("_base")).alias("_number"))
    # rows that share their key as well are told apart by their place among these
    again = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(1)))
    numbers = written(clashes.withColumn("_again", F.row_number().over(Window.partitionBy("_name", "_key").orderBy("_number"))))
    dropped(rows, bases)
    placed = df.withColumn("_again", again(name, key))
    on = F.col(name).eqNullSafe(F.col("_name")) & F.col(key).eqNullSafe(F.col("_key")) & (placed["_again"] == F.col("_place"))
    found = placed.join(small(numbers.withColumnRenamed("_again", "_place"), 256), on, "left")
    stem, ext = F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]*)?$", 2)
    told = F.when(F.col("_number") > 1, F.concat(stem, F.lit("_"), F.col("_number").cast("string"), ext)).otherwise(F.col(name))
    return found.withColumn(name, told).select(*df.columns)


def file_name(name: Column) -> Column:
    """name, or for one that is too long for a file its start with a digest; it has no separators and isn't empty.

    'report' stands before a name that begins as hidden files do, as Spark would not read it.
    """
    plain = F.regexp_replace(F.coalesce(name, F.lit("")), r"[/\x00]", "-")
    plain = F.when(plain.rlike("^([._]|$)"), F.concat(F.lit("report"), plain)).otherwise(plain)
    return F.when(F.octet_length(plain) > NAME_BYTES, F.concat(F.left(plain, F.lit(NAME_BYTES // 8)), F.lit("_"), F.md5(plain), F.regexp_extract(plain, r"(\.[A-Za-z0-9]{1,8})?$", 1))).otherwise(plain)


def write_documents(df: DataFrame, path: str, name: str = "name", text: str = "text", key: str = "recording_id", mode: str = "append") -> None:
    """One UTF-8 file below ``path`` for each row, its last line ended like the others; a null text is one empty line.

    Files get the row's name, numbered where rows share one, in a folder for each task. ``path`` is a folder or URI that all executors
    reach. With mode 'overwrite' the files there are replaced; no file is to be seen before all are written.
    """
    df.sparkSession.dataSource.register(Documents)
    named = numbered(df.select(file_name(F.col(name)).alias("name"), F.col(text).alias("text"), F.col(key).alias("key")), "name", "key")
    named.select("name", "text").write.format(FORMAT).mode(mode).option("path", path).save()


@dataclass
class Folder(InputPartition):
    """One task's folder of files."""

    path: str


class DocumentReader(DataSourceReader):
    """Rows (name, text) of the files below a folder, a task for each folder that a task has written: the driver lists folders only."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Folder]:
        store, root = found_store(self.path)
        there = store.get_file_info(fs.FileSelector(root))
        return [Folder(x.path) for x in sorted(there, key=lambda x: x.path) if x.type == fs.FileType.Directory and x.base_name.startswith("part-")]

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        # without any folder Spark asks once for a part that is None
        if partition is None:
            return
        store, _ = found_store(self.path)
        names: list[str] = []
        texts: list[bytes] = []
        size = 0
        for x in store.get_file_info(fs.FileSelector(partition.path)):
            with store.open_input_stream(x.path) as f:
                text = f.read()[:-1]
            names.append(x.base_name)
            texts.append(text)
            size += len(text)
            if size >= READ_BYTES:
                yield listed(names, texts)
                names, texts, size = [], [], 0
        yield listed(names, texts)


def listed(names: list[str], texts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["name", "text"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the files that write_documents() has committed."""
    spark.dataSource.register(Documents)
    return spark.read.format(FORMAT).option("path", path.rstrip("/")).load()
