"""Assembling recordings from a stream of chunks."""

from __future__ import annotations

import io
import math
import wave
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RATE = 16_000
#: Event time that a recording may wait for its next chunk.
WAIT_MS = 600_000
OUTPUT = "recording_id string, status string, n_chunks long, content binary"
#: The state store that keyed maps need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def to_wav(pcm: bytes, rate: int = RATE) -> bytes:
    """A mono 16-bit WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(pcm)
    return out.getvalue()


def joined(seen: list[tuple[int, int]], new: Iterable[int]) -> list[tuple[int, int]]:
    """Ranges (first, last) of whole numbers with others added, in order; neighbouring ranges become one."""
    found: list[tuple[int, int]] = []
    for a, b in sorted([*seen, *((x, x) for x in new)]):
        if found and a <= found[-1][1] + 1:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


class Assembler(StatefulProcessor):
    """A recording's chunks in a map, of which a batch writes one entry with its own new chunks, and one mark with the ranges of known seqs.

    Each call of the state is a message to the JVM, so their number grows with recordings and batches, not with chunks.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "block long", "seqs array<long>, bytes array<binary>")
        self.mark = handle.getValueState("mark", "n long, last long, timer long, done boolean, seen array<long>")

    def row(self, key: tuple, status: str, known: dict[int, bytes]) -> pd.DataFrame:
        return pd.DataFrame({"recording_id": [key[0]], "status": [status], "n_chunks": [len(known)], "content": [to_wav(b"".join(known[k] for k in sorted(known)))]})

    def held(self) -> dict[int, bytes]:
        return {seq: bytes(data) for _, (seqs, parts) in self.chunks.iterator() for seq, data in zip(seqs, parts, strict=True)}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, last, timer, done, flat = self.mark.get() if self.mark.exists() else (0, -1, -1, False, [])
        seen = list(zip(flat[::2], flat[1::2], strict=True))
        newest = timerValues.getCurrentWatermarkInMs()
        new: dict[int, bytes] = {}
        for part in rows:
            newest = max(newest, int(part["ms"].max()))
            if done:
                continue
            for seq, data in zip(part["seq"].tolist(), part["bytes"], strict=True):
                at = bisect_right(seen, (seq, math.inf)) - 1
                if seq not in new and (at < 0 or seen[at][1] < seq):
                    new[seq] = bytes(data) if data is not None else b""
            last = max(last, int(part["seq"].where(part["is_last"], -1).max()))
        before, n = n, n + len(new)
        seen = joined(seen, new)
        # the recording is whole once its last chunk and all before it are there; then only the mark is kept, so
        # that chunks that come again don't open it anew
        if not done and last >= 0 and any(a <= 0 and b >= last for a, b in seen):
            done = True
            yield self.row(key, "complete", (self.held() if before else {}) | new)
            if before:
                self.chunks.clear()
            seen = []
        elif new:
            self.chunks.updateValue((before,), (list(new), list(new.values())))
        if newest + WAIT_MS > timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = newest + WAIT_MS
            self.handle.registerTimer(timer)
        self.mark.update((n, last, timer, done, [x for pair in seen for x in pair]))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if not self.mark.get()[3]:
            yield self.row(key, "incomplete", self.held())
        self.chunks.clear()
        self.mark.clear()

    def close(self) -> None:
        pass


def assemble_chunks(stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """(recording_id, status, n_chunks, content) of rows (recording_id, seq, ts, bytes, is_last).

    seq counts from 0. Chunks may come in any order; of rows with one (recording_id, seq) the first
    counts. A recording whose last chunk doesn't come within the watermark is given as 'incomplete'.
    Chunks that repeat after that or after completion give no second row until the wait is over. Rows
    without seq or ts are left out, as they have no place in the recording or in time; null bytes are empty.
    The session's state store is set to one that has keyed maps.
    """
    stream.sparkSession.conf.set(*STORE)
    placed = stream.filter("seq is not null and ts is not null").withColumns({"ms": F.unix_millis("ts"), "is_last": F.coalesce("is_last", F.lit(False))})
    grouped = placed.withWatermark("ts", watermark).groupBy("recording_id")
    return grouped.transformWithStateInPandas(Assembler(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def assemble_batch(df: DataFrame) -> DataFrame:
    """The same for a finished table of chunks, with the bare bytes as content; ts is not needed.

    Of rows with one (recording_id, seq) the one with the least ts counts, if there is a ts, then the least bytes.
    """
    data = F.coalesce("bytes", F.lit(b""))
    first = F.min_by(data, F.struct("ts", data)) if "ts" in df.columns else F.min(data)
    placed = df.filter("seq is not null and ts is not null") if "ts" in df.columns else df.filter("seq is not null")
    one = placed.groupBy("recording_id", "seq").agg(first.alias("bytes"), F.max(F.coalesce("is_last", F.lit(False))).alias("is_last"))
    content = F.expr("listagg(bytes) within group (order by seq)")
    whole = one.groupBy("recording_id").agg(content.alias("content"), F.collect_list("seq").alias("_seqs"), F.max(F.when(F.col("is_last"), F.col("seq"))).alias("_last"))
    there = F.size(F.filter("_seqs", lambda s: (s >= 0) & (s <= F.col("_last"))))
    status = F.when(F.coalesce(there == F.col("_last") + 1, F.lit(False)), "complete").otherwise("incomplete")
    return whole.select("recording_id", status.alias("status"), F.size("_seqs").cast("long").alias("n_chunks"), "content")
