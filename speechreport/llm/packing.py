"""Mixture-controlled packing of token ids into sequences of fixed length.

A deficit round-robin serves one queue of packets for each source. With every round a source earns its
quantum, its share of a window of tokens; a packet leaves in the first round in which the tokens
earned so far cover it, and what is left over is carried to the next window. A queue that is never
empty serves the packet that ends at token e of its source in round ceil(e / quantum), so the schedule
is a formula over running totals: no task follows the rounds one by one, and deficits cross windows
and partitions by themselves. Packets in order of e / quantum, which is the order of rounds and holds the
shares inside a round as well, form one stream, cut every 4096 tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechreport.llm import tokens
from speechreport.llm.common import materialize, small, with_starts

LENGTH = 4096
#: Tokens of a window: a round of all queues. It numbers the rounds and doesn't change the order.
WINDOW = 64 * LENGTH


def quanta(sized: DataFrame, weights: dict[str | None, float] | None, window: int) -> DataFrame:
    """(source, quantum): tokens that each source earns in a round; shares follow ``weights``.

    Without weights a source's share is its share of all tokens, so all queues end together. Sources
    that ``weights`` lacks get the smallest weight given.
    """
    totals = materialize(sized.groupBy("source").agg(F.sum("size").cast("double").alias("total")))
    share = F.col("total")
    if weights is not None:
        share = F.lit(float(min(weights.values(), default=1.0)))
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    shares = totals.select("source", share.alias("share"))
    whole = shares.agg(F.sum("share")).first()[0]  # one number
    earned = F.lit(float(window)) * F.col("share") / F.lit(whole or 1.0)
    return shares.select("source", earned.alias("quantum"))


def schedule(sized: DataFrame, length: int = LENGTH, weights: dict[str | None, float] | None = None, window: int = WINDOW) -> DataFrame:
    """(row, begin, span, sequence_id, offset, round) of pieces, for rows (row, doc_id, source, size).

    ``row`` identifies a row. A document's packets have at most ``length`` tokens.
    """
    queued = with_starts(sized, ["doc_id", "row"], "size", by="source", start="queued")
    earned = materialize(quanta(sized, weights, window))
    packets = queued.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(length).cast("long"))).alias("begin"))
    packets = packets.withColumn("span", F.least(F.lit(length), F.col("size") - F.col("begin")))
    packets = packets.withColumnRenamed("source", "_source").join(small(earned), F.col("_source").eqNullSafe(F.col("source")))
    ends = F.col("queued") + F.col("begin") + F.col("span")
    packets = packets.select("row", "source", "begin", "span", (ends - F.col("span")).alias("place"), (ends / F.col("quantum")).alias("due"))
    streamed = with_starts(packets, ["due", "source", "place"], "span", start="at").withColumn("round", F.ceil("due"))
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("span") - 1) / length)
    cut = streamed.select("*", F.explode(F.sequence(first, last)).alias("sequence_id"))
    lo = F.greatest(F.col("at"), F.col("sequence_id") * length)
    hi = F.least(F.col("at") + F.col("span"), (F.col("sequence_id") + 1) * length)
    return cut.select("row", (F.col("begin") + lo - F.col("at")).alias("begin"), (hi - lo).alias("span"), "sequence_id", (lo - F.col("sequence_id") * length).alias("offset"), "round")


def pack(df: DataFrame, tokenizer: str, kind: str = "word", key: str = "doc_id", text: str = "text", source: str = "source", length: int = LENGTH, weights: dict[str | None, float] | None = None, window: int = WINDOW, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    Every id of every document lies in exactly one piece. All sequences but the last are full, and
    the last one is padded to ``length`` unless it ends at a power of two. ``with_ids`` adds the ids
    (binary, little-endian 32-bit). Null and empty texts are the end id alone; null keys come first
    and null sources are a source; rows that repeat are packed each, very long texts whole. An empty table gives
    no rows. Other columns are not read.
    """
    coded = tokens.tokenize(df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), text), tokenizer, kind, text, end_id)
    coded = materialize(coded.withColumn("row", F.monotonically_increasing_id()))
    width = tokens.id_width(tokenizer)
    sized = coded.select("row", "doc_id", "source", F.col("n_tokens").alias("size"))
    pieces = schedule(sized, length, weights, window)
    placed = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("begin", "span", "sequence_id", "offset"))).alias("pieces"))
    joined = coded.join(placed, "row").select("doc_id", "source", "n_tokens", "ids", "pieces")
    names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    schema = df.select(F.col(key).alias("doc_id"), F.col(source).alias("source")).withColumns({n: F.lit(0).cast("long") for n in names[2:8]} | ({"ids": F.lit(b"")} if with_ids else {})).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sources, sizes, ids, pieces = batch.columns
            flat = pieces.flatten()
            counts = np.diff(pieces.offsets.to_numpy())
            begin, span, sequence, offset = (c.to_numpy(zero_copy_only=False) for c in flat.flatten())
            of = np.repeat(np.arange(len(counts)), counts)
            wide = [np.frombuffer(x.as_buffer(), width).astype("<u4") for x in ids]
            parts = [wide[d][b : b + n].tobytes() for d, b, n in zip(of, begin, span, strict=True)]
            own = [docs.take(pa.array(of)), sources.take(pa.array(of)), pa.array(begin), pa.array(span), pa.array([zlib.crc32(p) for p in parts], pa.int64()), sizes.take(pa.array(of)), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(parts, pa.binary())] * with_ids], names)

    return joined.mapInArrow(cut, schema).withColumnsRenamed({"doc_id": key, "source": source})
