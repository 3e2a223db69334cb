"""Token-id files coded by a static range asymmetric numeral system.

All blocks share one frequency table. A block holds whole documents and is coded by itself, with many
interleaved lanes that numpy steps together; it carries a checksum, and checkpoints from which decoding can
start in its middle. A long block, which a very long document makes, is cut at checkpoints into stretches, each a row
with its own words and checksum, so tasks decode them side by side and no word is moved twice; the stretches of a
document are put together. Blocks are rows of a table that Spark writes, so any store works.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechreport.llm import tokens
from speechreport.llm.common import materialize, scratch_dir, small

#: Slots of the table as a power of two. States stay in [2**32, 2**48), 16 bits go out at a time; below
#: 2**53 the quotient of a state and a frequency is exact in double precision, which is far faster.
BITS = 20
LOW = 1 << 32
WORD = 16
BLOCK_TOKENS = 1 << 19
LANES = 2048
CHECKPOINT_STEPS = 128
#: Tokens of the longest block that is kept whole, and of the stretches of longer ones, about.
LONG, STRETCH = 1 << 21, 1 << 20
MAGIC = b"SRNS"
HEAD = struct.Struct("<4sQIIIIQ")  # magic, tokens, lanes, documents, checkpoints, steps between them, words
OVER = 32 - BITS + WORD


def quantize(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**BITS, at least 1 for every symbol that occurs."""
    total, present = int(counts.sum()), counts > 0
    if not total:
        return np.zeros(len(counts), np.int64)
    if int(present.sum()) > 1 << BITS:
        raise ValueError("more symbols than the table has slots")
    free = (1 << BITS) - int(present.sum())
    found = np.where(present, 1 + np.floor(counts * (free / total)), 0).astype(np.int64)
    found[np.argmax(counts)] += (1 << BITS) - int(found.sum())
    return found


class Table:
    """Frequencies, their running sums and the symbol of each slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.int64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.int64) if len(freq) else self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_block(docs: list[tuple[int | None, np.ndarray]], table: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    """Documents (id, token ids) as one block."""
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    state, chunks, marks, written = np.full(lanes, LOW, np.int64), [], [], 0
    freq, cum = table.freq[ids], table.cum[ids]
    limit, exact = freq << OVER, freq.astype(np.float64)
    for t in range(steps - 1, -1, -1):
        own = slice(t * lanes, (t + 1) * lanes)
        f = freq[own]
        x = state[: len(f)]
        over = np.flatnonzero(x >= limit[own])
        out = x[over]
        x[over] = out >> WORD
        again = np.flatnonzero(x[over] >= limit[own][over])  # a rare symbol needs two words
        if len(again):
            chunks.append(out[again].astype("<u2"))  # the decoder takes these last
            out[again] >>= WORD
            x[over[again]] >>= WORD
        chunks.append(out.astype("<u2"))  # the low bits
        written += len(out) + len(again)
        q = (x / exact[own]).astype(np.int64)
        x += (q << BITS) - q * f + cum[own]
        if t % every == 0 and t:
            marks.append((written, state.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u2")
    # a mark tells how many words were written before it, so the decoder's place is counted from the end
    return _packed([(i, len(x)) for i, x in docs], n, lanes, every, state, [(len(words) - w, s) for w, s in marks[::-1]], words)


def _packed(docs: list[tuple[int | None, int]], n: int, lanes: int, every: int, state: np.ndarray, marks: list[tuple[int, np.ndarray]], words: np.ndarray) -> bytes:
    """A block of n tokens: documents (id, tokens), states of the lanes, checkpoints (place in the words, states) and words."""
    body = HEAD.pack(MAGIC, n, lanes, len(docs), len(marks), every, len(words))
    known = np.array([i is not None for i, _ in docs], np.uint8)
    body += known.tobytes() + np.array([i or 0 for i, _ in docs], "<i8").tobytes() + np.array([s for _, s in docs], "<u8").tobytes()
    body += state.astype("<i8").tobytes()
    body += b"".join(struct.pack("<Q", at) + s.astype("<i8").tobytes() for at, s in marks)
    body += words.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def count_marks(block: bytes) -> int:
    return HEAD.unpack_from(block)[4]


def count_docs(block: bytes) -> int:
    return HEAD.unpack_from(block)[3]


def stretches(block: bytes, tokens: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(first token, tokens, tokens of the first document before it, block) of stretches of about ``tokens`` tokens.

    Each begins at a checkpoint of the block, whose states are its own first ones, and is a block by itself of the words up to the
    next stretch. Its documents are those that it has a part of, each with the tokens of this part.
    """
    _, n, lanes, n_docs, n_marks, every, n_words = HEAD.unpack_from(block)
    at = HEAD.size
    known = np.frombuffer(block, np.uint8, n_docs, at)
    names = np.frombuffer(block, "<i8", n_docs, at := at + n_docs)
    sizes = np.frombuffer(block, "<u8", n_docs, at := at + 8 * n_docs).astype(np.int64)
    ends = np.cumsum(sizes)
    state = np.frombuffer(block, "<i8", lanes, at := at + 8 * n_docs)
    marks = [(0, state)]
    at += 8 * lanes
    for _ in range(n_marks):
        marks.append((struct.unpack_from("<Q", block, at)[0], np.frombuffer(block, "<i8", lanes, at + 8)))
        at += 8 * (1 + lanes)
    words = np.frombuffer(block, "<u2", n_words, at)
    step = max(1, tokens // (every * lanes))
    for k in range(0, n_marks + 1, step):
        first, last = k * every * lanes, min(n, (k + step) * every * lanes)
        place, own = marks[k]
        end = marks[k + step][0] if k + step <= n_marks else n_words
        # a document without tokens belongs to the stretch that ends where it stands
        lo, hi = int(np.searchsorted(ends, first, "right")) if k else 0, int(np.searchsorted(ends, last, "right"))
        hi += hi < n_docs and ends[hi] - sizes[hi] < last
        parts = [(int(names[d]) if known[d] else None, int(min(ends[d], last) - max(ends[d] - sizes[d], first))) for d in range(lo, hi)]
        inner = [(p - place, s) for p, s in marks[k + 1 : min(k + step, n_marks + 1)]]
        yield first, last - first, first - int(ends[lo] - sizes[lo]), _packed(parts, last - first, lanes, every, own, inner, words[place:end])


def decode_block(block: bytes, table: Table, checkpoint: int = 0, until: int | None = None) -> tuple[list[tuple[int | None, int]], np.ndarray, int]:
    """((document id, its tokens) of the block, token ids from a checkpoint on up to another, tokens before them).

    Checkpoint 0 is the start; ``until`` None or after the last one is the end.

    Raises ValueError if the checksum or the magic doesn't fit.
    """
    body = memoryview(block)[:-4]
    if len(block) < HEAD.size + 4 or zlib.crc32(body) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("block checksum differs")
    magic, n, lanes, n_docs, n_marks, every, n_words = HEAD.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = HEAD.size
    known = np.frombuffer(body, np.uint8, n_docs, at)
    names = np.frombuffer(body, "<i8", n_docs, at := at + n_docs)
    sizes = np.frombuffer(body, "<u8", n_docs, at := at + 8 * n_docs)
    state = np.frombuffer(body, "<i8", lanes, at := at + 8 * n_docs).copy()
    at += 8 * lanes
    marks = at
    words = np.frombuffer(body, "<u2", n_words, at + n_marks * 8 * (1 + lanes))
    pos, first = 0, 0
    if checkpoint:
        here = marks + (checkpoint - 1) * 8 * (1 + lanes)
        pos = struct.unpack_from("<Q", body, here)[0]
        state = np.frombuffer(body, "<i8", lanes, here + 8).copy()
        first = checkpoint * every
    last = -(-n // lanes) if until is None or until > n_marks else until * every
    out = np.empty(min(n, last * lanes) - first * lanes, np.uint32)
    for t in range(first, last):
        k = min(lanes, n - t * lanes)
        x = state[:k]
        slot = x & ((1 << BITS) - 1)
        symbol = table.symbol[slot]
        out[(t - first) * lanes : (t - first) * lanes + k] = symbol
        x >>= BITS
        x *= table.freq[symbol]
        x += slot
        x -= table.cum[symbol]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << WORD) | words[pos : pos + len(low)]
        pos += len(low)
        low = low[x[low] < LOW]
        if len(low):
            x[low] = (x[low] << WORD) | words[pos : pos + len(low)]
            pos += len(low)
    return [(int(i) if k else None, int(s)) for k, i, s in zip(known, names, sizes, strict=True)], out, first * lanes


def frequencies(coded: DataFrame, width: str) -> np.ndarray:
    """Counts of all token ids; the rows that reach the driver are at most the vocabulary's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            seen = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), width))
            if len(seen) > len(total):
                total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
            total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["symbol", "n"])

    rows = coded.select("ids").mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["symbol"] for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        counts[r["symbol"]] = r["n"]
    return counts


def write_files(coded: DataFrame, path: str, width: str, key: str = "doc_id") -> None:
    """Writes (key, n_tokens, ids) in ascending order of key: ``path``/blocks and ``path``/table.

    A block row: shard (ascending ranges of key), block_no, shard_start (tokens of the shard before
    it), n_docs, n_tokens, marks (its checkpoints), lead, block. A block of more than LONG tokens is written as its stretches, a row
    each, of which lead counts the tokens that the first document has before it; other blocks have none. Nulls of key come
    first; ties stand in the order of their ids.
    """
    spark = coded.sparkSession
    freq = quantize(frequencies(coded, width))
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq) if f], "symbol long, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared, lanes, every, longest, stretch = spark.sparkContext.broadcast(freq), LANES, CHECKPOINT_STEPS, LONG, STRETCH

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shard = Table(shared.value), TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        number = start = size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, number, start, size
            block = encode_block(held, table, lanes, every)
            held = []
            for first, n, lead, own in stretches(block, stretch) if size > longest else [(0, size, None, block)]:
                row = (shard, number, start + first, count_docs(own), n, count_marks(own), lead)
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in row), pa.array([own], pa.binary())], names)
                number += 1
            start, size = start + size, 0

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((k, np.frombuffer(x.as_py(), width)))
                size += len(held[-1][1])
                if size >= BLOCK_TOKENS:
                    yield from close()
        if held:
            yield from close()

    names = ["shard", "block_no", "shard_start", "n_docs", "n_tokens", "marks", "lead", "block"]
    dealt = coded.select(key, "ids").repartitionByRange(key).sortWithinPartitions(key, "ids")
    dealt.mapInArrow(blocks, "shard long, block_no long, shard_start long, n_docs long, n_tokens long, marks long, lead long, block binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_files(spark, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids as little-endian 32-bit, ids_crc32) of all documents in the files."""
    freq_rows = spark.read.parquet(f"{path}/table").collect()  # as many rows as the vocabulary has
    freq = np.zeros(max([r["symbol"] for r in freq_rows], default=-1) + 1, np.int64)
    for r in freq_rows:
        freq[r["symbol"]] = r["freq"]
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(totals.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base")))
    placed = blocks.join(small(bases), "shard").select((F.col("base") + F.col("shard_start")).alias("start"), "lead", "block")
    names = [key, "start", "n_tokens", "ids_crc32", "ids"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for start, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, ids, _ = decode_block(block.as_py(), table)
                ends = np.cumsum([n for _, n in docs])
                parts = [ids[e - n : e].astype("<u4").tobytes() for e, (_, n) in zip(ends, docs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in docs], pa.int64()), pa.array([start + int(e) - n for e, (_, n) in zip(ends, docs, strict=True)], pa.int64()), pa.array([n for _, n in docs], pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                    names,
                )

    def decode_stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The part of each document that lies in the stretch: where the document starts, and the part's place (at) in it."""
        table = Table(shared.value)
        for batch in batches:
            for start, lead, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs, ids, _ = decode_block(block.as_py(), table)
                rows, base = [], 0
                for k, n in docs:
                    rows.append((k, start + base - lead, n, lead, ids[base : base + n].astype("<u4").tobytes()))
                    base, lead = base + n, 0
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], [key, "start", "n", "at", "part"])

    whole = placed.filter("lead is null").select("start", "block").mapInArrow(decode, f"`{key}` long, start long, n_tokens long, ids_crc32 long, ids binary")
    # a stretch is a row of its own, dealt once to some task
    cut = placed.filter("lead is not null").repartition("start").select("start", "lead", "block")
    parts = cut.mapInArrow(decode_stretch, f"`{key}` long, start long, n long, at long, part binary")
    ids = F.expr("listagg(part) within group (order by at)")
    joined = parts.groupBy(key, "start").agg(F.sum("n").alias("n_tokens"), ids.alias("ids")).select(key, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "ids")
    return whole.unionByName(joined)


def write_and_read(df: DataFrame, tokenizer: str, kind: str = "byte", key: str = "doc_id", text: str = "text", end_id: int = 2, path: str | None = None) -> DataFrame:
    """Tokenizes, writes files below ``path`` (a scratch folder if None) and reads the documents back.

    Null and empty texts are documents of the end id alone. Null keys come first. Rows that repeat a
    key stay documents of their own. Very long texts are coded whole, and may be decoded in stretches. An empty
    table gives no rows. Other columns of df are not read.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    coded = materialize(tokens.tokenize(df.select(F.col(key).cast("long").alias(key), text), tokenizer, kind, text, end_id))
    write_files(coded, path, tokens.id_width(tokenizer), key)
    return read_files(spark, path, key)
