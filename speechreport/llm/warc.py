"""WARC archives: written as text by Spark, read back by verifying chains of record boundaries.

Reading splits archives at the mark of a version line wherever it stands, payloads included. Each piece that begins with a
known version and whose header tells a length is a candidate record that points at the offset where its successor must begin.
Only candidates that pointers reach from the start of the file are records; the version line inside a
payload is rejected, as nothing that is reached points at it. Pointers are first followed inside
blocks of the file, then doubled over blocks, then followed inside blocks again from where a chain
enters, so no task follows a whole file's chain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechreport.llm.common import materialize, scratch_dir, small

#: Archives are written in version 1.1; MARK begins a version line, and VERSIONS are those that are read.
VERSION, MARK, VERSIONS, END = "WARC/1.1\r\n", "WARC/", ("1.0", "1.1"), "\r\n\r\n"
LEAST_DEDUPED = 100
#: Records of a file, and bytes of the blocks in which pointers are followed at once.
RECORDS, BLOCK = 20_000, 1 << 20
DATE = "2024-01-01T00:00:00Z"


def records(pages: DataFrame) -> DataFrame:
    """The text of one record for each row (page_id, url, html): a response, or a revisit of one.

    Of equal payloads of LEAST_DEDUPED bytes and more, the one with the smallest page_id is the
    response. A revisit holds the HTTP header, whose Content-Length is the payload's, and no payload.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    line = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    base = pages.select("page_id", line.alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha2(html.cast("binary"), 256).alias("digest")).withColumn("_d", F.unhex("digest"))
    many = base.filter(F.col("n") >= LEAST_DEDUPED).groupBy("_d").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = materialize(many.filter((F.col("copies") > 1) & F.col("first").isNotNull()).select("_d", "first"))
    rows = base.join(small(firsts, 128), "_d", "left")
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(F.lit(""))
    return rows.select(F.concat(
        F.lit(VERSION), F.lit("WARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), refers, F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    ).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Writes archives below path; each is a plain WARC file of RECORDS records at most."""
    records(pages).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).text(path)


def pieces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, split, id, body, n) of what stands between the marks of version lines, and (file, id, at, next) of it.

    ``file`` is a hash of the path, which is shorter to carry along.
    ``at`` is the offset of the piece's mark. ids ascend along a file's splits. ``next`` is
    null where no version that is read, or no header with a length, follows the mark.
    """
    raw = spark.read.option("lineSep", MARK).text(path)
    raw = raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("body"), F.octet_length("value").cast("long").alias("n"))
    raw = materialize(raw)
    before = Window.partitionBy("file").orderBy("split", "id").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("file").orderBy("split", "id")
    # the first piece stands before the first version line; each later one after a line of its own
    sums = raw.select("file", "id", (F.sum(F.col("n") + len(MARK)).over(before) - len(MARK)).alias("at"), F.row_number().over(order).alias("piece"))
    sums = sums.filter(F.col("piece") > 1).select("file", "id", "at")
    head = F.substring_index("body", END, 1)
    length = F.nullif(F.regexp_extract(head, r"(?i)(?:^|\r\n)Content-Length: *(\d{1,18})(?:\r\n|$)", 1), F.lit("")).cast("long")
    has_end = (F.octet_length(head) < F.octet_length("body")) & F.substring("body", 1, 5).isin(*[f"{v}\r\n" for v in VERSIONS])
    told = raw.select("file", "id", F.when(has_end, len(MARK) + F.octet_length(head) + len(END) * 2 + length).alias("size"))
    found = materialize(sums.join(told.hint("merge"), ["file", "id"]).select("file", "id", "at", (F.col("at") + F.col("size")).alias("next")))
    return raw, found


def reachable(candidates: DataFrame, block: int = BLOCK) -> DataFrame:
    """The (file, at) of candidates (file, at, next) that pointers reach from offset 0."""
    kind = candidates.schema["file"].dataType.simpleString()
    nodes = candidates.select("file", "at", F.coalesce("next", F.lit(-1)).alias("next"), F.floor(F.col("at") / block).alias("block"))

    def exits(group: pd.DataFrame) -> pd.DataFrame:
        """Where the chain from each candidate leaves the block; -1 if it breaks in it."""
        at, step = group["at"].to_numpy(), group["next"].to_numpy()
        end, leave = (int(group["block"].iloc[0]) + 1) * block, {}
        for a, n in sorted(zip(at.tolist(), step.tolist(), strict=True), reverse=True):
            leave[a] = n if n < 0 or n >= end else leave.get(n, -1)
        return pd.DataFrame({"file": group["file"].astype(object), "at": at, "out": np.array([leave[a] for a in at.tolist()], np.int64)})

    jumps = materialize(nodes.groupBy("file", "block").applyInPandas(exits, f"file {kind}, at long, out long"))
    # only candidates that an exit points at can be entries of blocks
    targets = jumps.filter("out >= 0").select("file", F.col("out").alias("at")).distinct()
    entries = materialize(jumps.join(targets, ["file", "at"], "left_semi").union(jumps.filter("at = 0")).distinct())
    reached = entries.filter("at = 0").select("file", "at")
    links, count = entries, -1
    while (now := (reached := materialize(reached)).count()) > count:
        count = now
        step = reached.join(links, ["file", "at"]).filter("out >= 0").select("file", F.col("out").alias("at"))
        step = step.join(entries, ["file", "at"], "left_semi")
        ahead = links.select("file", F.col("at").alias("out"), F.col("out").alias("then"))
        doubled = links.join(ahead, ["file", "out"], "left")
        reached = reached.union(step).distinct()
        links = materialize(doubled.select("file", "at", F.coalesce("then", F.lit(-1)).alias("out")))

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        pointer = dict(zip(group["at"].tolist(), group["next"].tolist(), strict=True))
        found = []
        for a in group["at"][group["entry"]].tolist():
            while a in pointer and pointer[a] >= 0:
                found.append(a)
                a = pointer.pop(a)
        return pd.DataFrame({"file": pd.Series([group["file"].iloc[0]] * len(found), dtype=object), "at": np.array(found, np.int64)})

    marked = nodes.join(reached.withColumn("entry", F.lit(True)).hint("merge"), ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("file", "block").applyInPandas(follow, f"file {kind}, at long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives below path: page_id, record_type, refers_to,
    payload_bytes, payload_digest, url, payload (binary, null for revisits), intact.

    payload_digest is computed for responses and told by the header for revisits; intact is whether
    it fits the header's. Empty files give no rows; a file that doesn't begin with a record of a version that is read
    raises ValueError, as its records would be lost silently. A record whose payload holds version
    lines is put together again from its pieces.
    """
    raw, found = pieces(spark, path)
    unread = raw.select("file").distinct().join(found.filter("at = 0 and next is not null").select("file"), "file", "left_anti").count()
    if unread:
        raise ValueError(f"{unread} files below {path} don't begin with a record of WARC version {' or '.join(VERSIONS)}")
    starts = reachable(found.select("file", "at", "next")).withColumn("_reached", F.lit(True))
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = found.join(materialize(starts).hint("merge"), ["file", "at"], "left").withColumn("owner", F.last(F.when(F.col("_reached"), F.col("at")), ignorenulls=True).over(order))
    owned = materialize(owned.select("file", "id", "at", "owner"))
    # pieces that are not a record of their own: those inside payloads and their owners, and those of no record
    parts = owned.groupBy("file", "owner").agg(F.count(F.lit(1)).alias("parts"), F.first("id").alias("_id"))
    plain = parts.filter((F.col("parts") == 1) & F.col("owner").isNotNull()).select("file", F.col("_id").alias("id"))
    odd = materialize(owned.join(plain.hint("merge"), ["file", "id"], "left_anti").select("file", "id", "at", "owner").withColumn("odd", F.lit(True)))
    first = materialize(raw.select("file", "id").join(owned.select("file", "id").hint("merge"), ["file", "id"], "left_anti").withColumns({"at": F.lit(None).cast("long"), "owner": F.lit(None).cast("long"), "odd": F.lit(True)}))
    split = raw.select("file", "id", "body").join(small(materialize(odd.unionByName(first)), 96), ["file", "id"], "left")
    whole = split.filter("odd is null").select("body")
    joined = split.filter("owner is not null").groupBy("file", "owner").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), MARK).alias("body"))
    return parse(whole.union(joined.select("body")))


def _header(name: str, column: str = "head") -> Column:
    return F.nullif(F.regexp_extract(column, rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1), F.lit(""))


def parse(bodies: DataFrame) -> DataFrame:
    """The columns of read() for rows (body): a record without the mark of its version line."""
    rows = bodies.withColumn("head", F.substring_index("body", END, 1))
    rows = rows.withColumn("block", F.substring(F.col("body").cast("binary"), F.octet_length("head") + len(END) + 1, _header("Content-Length").cast("int")))
    rows = rows.withColumn("http", F.substring_index(F.col("block").cast("string"), END, 1))
    rows = rows.withColumn("payload", F.substring(F.col("block"), F.octet_length("http") + len(END) + 1, F.octet_length("block")))
    page = lambda name: F.nullif(F.regexp_extract(_header(name), "<urn:page:(-?[0-9]+)>", 1), F.lit("")).cast("long")
    revisit, told = _header("WARC-Type") == "revisit", F.substring_index(_header("WARC-Payload-Digest"), ":", -1)
    digest = F.when(revisit, told).otherwise(F.sha2("payload", 256))
    return rows.select(
        page("WARC-Record-ID").alias("page_id"), _header("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
        F.when(revisit, _header("Content-Length", "http").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        digest.alias("payload_digest"), _header("WARC-Target-URI").alias("url"), F.when(~revisit, F.col("payload")).alias("payload"), (digest == told).alias("intact"),
    )


def write_and_read(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes one record for each row of pages and reads the archives back.

    Null html is an empty payload, a null url an empty one; a null page_id reads back as null and is
    never referred to. Rows that repeat a page_id and its payload are responses each. Very long payloads, up
    to 2 GB, are written and read whole. Columns other than page_id, url and html are not read. An empty
    table gives no rows.
    """
    path = path or scratch_dir(pages.sparkSession)
    write(pages, path)
    return read(pages.sparkSession, path)
