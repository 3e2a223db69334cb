"""Near duplicates by MinHash bands, with sequential Bayesian verification of the candidates.

Documents whose signatures agree in a band of ROWS hashes stand in one bucket. With BANDS bands a pair at the
threshold shares no band with a probability of (1 - t**ROWS)**BANDS, 7e-8 here. Signatures of candidates are
compared batch by batch: after k hashes of which m agree, the similarity has the posterior Beta(m + 1, k - m + 1) over
a uniform prior, and a pair for which it reaches the threshold with a probability below ``miss`` is dropped. Most
pairs that merely share a passage go after the first batch. What survives the last one is verified on the full sets,
so links are exact, and only the two probabilities above can lose one.

As equal hashes of a band brought the pair here, the agreements lean upward, which can only keep a pair longer.

Buckets of near copies would give all pairs of a group. As in the n-gram join, equal sets are one node, each member first
meets the hub of its bucket, and only members that are still in different components meet: in pairs in small
buckets, by their differences to the hub in large ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechreport.llm.common import dropped, materialize, small
from speechreport.llm.ngram_join import Sets, among, classes, connected, distinct_sets, labelled, similar, with_texts
from speechreport.llm.shingles import PLACE, all_sets, mixed, slices

WORDS, PERCENT = 3, 85
BANDS, ROWS = 28, 5
#: Hashes that are compared at a time, and the probability of dropping a pair at the threshold.
BATCH, MISS = 28, 1e-9
HASHES = BANDS * ROWS
#: Shingles that are hashed at a time.
CHUNK = 4096


def family(n: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of n hash functions of 32 bits."""
    made = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(PLACE[0]))
    a, b = (x.astype(np.uint32)[:, None] for x in (made[:n] >> np.uint64(32), made[n:] >> np.uint64(32)))
    return a | np.uint32(1), b


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), CHUNK):
        np.minimum(least, (x[None, at : at + CHUNK] * a + b).min(axis=1), out=least)
    return least


def signatures(df: DataFrame, known: Broadcast, words: int) -> DataFrame:
    """(node, n, rare, bands, sig) of rows (node, text) with words: a hash of each band, and the signature cut to 16 bits a hash.

    Hashes that differ may look equal when cut, which can only let a pair through to the exact check.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = family()
        place = np.array(PLACE[:ROWS], np.uint64)
        for batch in slices(batches):
            found = [(node, s) for node, s in zip(batch.column(0).to_pylist(), all_sets(batch.column(1).to_pylist(), words), strict=True) if len(s)]
            if not found:
                continue
            sig = np.array([signature(s, a, b) for _, s in found], np.uint32)
            bands = mixed((sig.reshape(-1, BANDS, ROWS).astype(np.uint64) * place).sum(axis=2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            rare = [int((classes(s, known.value) == 0).sum()) for _, s in found]
            cut = (sig >> np.uint32(16)).astype("<u2")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int32()), pa.array(rare, pa.int32()), lists, pa.array([x.tobytes() for x in cut], pa.binary())],
                ["node", "n", "rare", "bands", "sig"],
            )

    return df.mapInArrow(run, "node long, n int, rare int, bands array<long>, sig binary")


def buckets(signed: DataFrame) -> DataFrame:
    """Rows (shingle: the bucket, node, n, place, rare, hub, size) of the buckets that more than one node has.

    Hubs are aggregated before the shuffle and written; the join with them is one that Spark can split at a hot bucket.
    """
    listed = signed.select(F.explode(F.array_distinct("bands")).alias("shingle"), "node", "n", F.lit(0).alias("place"), "rare")
    hubs = listed.groupBy("shingle").agg(F.min(F.struct("rare", "node", "n", "place")).alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return listed.join(small(materialize(hubs)), "shingle")


def least_matches(percent: int, hashes: int, batch: int, miss: float) -> list[tuple[int, int]]:
    """(k, m): hashes after which a pair is judged, and the agreements below which it is dropped.

    The posterior Beta(m + 1, k - m + 1) is above t with the probability that k + 1 trials of chance t succeed m times at most.
    """
    t, found = percent / 100, []
    for k in [*range(batch, hashes, batch), hashes]:
        reach, m = 0.0, -1
        while reach < miss and m < k:
            m += 1
            reach += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        found.append((k, m))
    return found


def plausible(df: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) of rows (a, b, sig_a, sig_b) that no batch of hashes drops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = least_matches(percent, HASHES, BATCH, miss)
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, HASHES) for i in (2, 3))
            left, agreed, seen = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for k, least in steps:
                agreed = agreed + (x[left, seen:k] == y[left, seen:k]).sum(axis=1)
                keep = agreed >= least
                left, agreed, seen = left[keep], agreed[keep], k
            yield batch.select([0, 1]).take(pa.array(left))

    return df.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, signed: DataFrame, sets: Sets, percent: int, words: int, miss: float) -> DataFrame:
    """The pairs (a, b) that link: the signatures decide which are compared, then the full sets."""
    left = materialize(plausible(with_texts(pairs, signed.select("node", "sig"), a="_a", b="_b"), percent, miss))
    return similar(with_texts(left, among(sets.texts, left, "a", "b"), a="_a", b="_b"), percent, words)


def link(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS, miss: float = MISS) -> DataFrame:
    """One row for each row of df: key, n_shingles, component_id, kept.

    component_id is the smallest key that links reach, equal sets being linked; kept tells whether it is the row's own. Null texts
    and texts without words have no shingles and link to nothing; very long texts are compared whole. Rows without a key have
    no component, take no part and are kept; rows that share a key are one document, whose texts are all compared, and
    repeated rows give a row each. Keys are whole numbers. An empty table gives no rows; other columns are not read.
    """
    sets = distinct_sets(df, key, text, words)
    signed = materialize(signatures(sets.firsts, sets.known, words))
    groups = materialize(buckets(signed))
    whole = connected(groups, sets, lambda pairs: verified(pairs, signed, sets, percent, words, miss), percent, words)
    dropped(groups, signed)
    found = labelled(sets, whole, key)
    return found.withColumn("kept", F.coalesce(F.col("component_id") == F.col(key), F.lit(True)))
