"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded from measures of its own, surface and
hashed words, by a tanh layer; nothing of the whole document is among them; gated attention weighs the passages; the weighted representation is scored. Only documents are
labelled, the weights of passages are learned with the rest. Training takes a bounded sample of
labelled rows on the driver; scoring runs over whole texts in Arrow batch tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 64
#: Labelled rows that a model is fitted on, at most: those first in a seeded order of their ids; and passages
#: of each of them, at equal distances. (Scores take all passages.)
SAMPLE, PASSAGES = 6000, 64
#: Numbers that words are hashed to, as a power of two, and bytes from which on a word is long.
WORD_BITS, LONG_WORD = 5, 12
#: Bytes of text whose measures are taken together.
PORTION = 1 << 20

#: Classes of bytes that passages are measured by; other bytes are class 0.
CLASSES = (
    b" \t\n\r\x0b\x0c",
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b".,;:",
    b"!?",
    b"#*$%&|<>",
    b"'\"()-",
    b"/@_=+~^{}[]\\`",
)
CLASS_OF = np.zeros(256, np.int64)
for _number, _members in enumerate(CLASSES, 1):
    CLASS_OF[list(_members)] = _number
CLASS_OF[0x80:0xC0] = len(CLASSES) + 1  # continuation bytes
CLASS_OF[0xC0:] = len(CLASSES) + 2
N_CLASSES = len(CLASSES) + 3
MEASURES = N_CLASSES + 8 + (1 << WORD_BITS)


def measure(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x MEASURES, passages of each text); a text without words is one empty passage."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    kind = CLASS_OF[data]
    inside = kind != 1
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    n_words = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
    passages = np.maximum(1, -(-n_words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(passages)[:-1]])
    total = int(passages.sum())
    out = np.zeros((total, MEASURES))
    if not len(starts):
        return out, passages
    word_doc = np.repeat(np.arange(len(texts)), n_words)
    order = np.arange(len(starts)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    at = first[word_doc] + order // PASSAGE
    ends = np.flatnonzero(~inside & np.concatenate([[False], inside[:-1]]))
    size = ends - starts
    in_passage = np.bincount(at, minlength=total)
    # bytes of a word and of the space after it, up to the next word of the text
    byte_word = np.cumsum(np.bincount(starts, minlength=len(data))) - 1
    own = inside & (byte_word >= 0)
    counts = np.bincount(at[byte_word[own]] * N_CLASSES + kind[own], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    letters = np.maximum(1, np.bincount(at, size, total))
    out[:, :N_CLASSES] = counts / letters[:, None]
    # a polynomial hash of each word, for repeats
    place = np.arange(len(data)) - starts[np.maximum(byte_word, 0)]
    value = (data.astype(np.int64) + 1) * ((place * place * 7919 + place * 104729 + 1) % 1000003)
    value[~own] = 0
    word = np.add.reduceat(value, starts) + size * 1_000_000_007
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (at[1:] == at[:-1])
    words = np.maximum(1, in_passage)
    both = np.flatnonzero(at[1:] == at[:-1])
    pairs = np.bincount(_distinct(at[both], word[both] * 31 + word[both + 1]), minlength=total)
    out[:, N_CLASSES] = (pairs + (in_passage > 0)) / words
    out[:, N_CLASSES + 1] = np.bincount(at[again], minlength=total) / words
    out[:, N_CLASSES + 2] = np.bincount(_distinct(at, word), minlength=total) / words
    out[:, N_CLASSES + 3] = np.bincount(at, size, total) / words
    out[:, N_CLASSES + 4] = np.log1p(in_passage)
    out[:, N_CLASSES + 5] = np.bincount(at[size >= LONG_WORD], minlength=total) / words
    upper = np.bincount(at[np.isin(kind[starts], (3,))], minlength=total)
    out[:, N_CLASSES + 6] = upper / words
    out[:, N_CLASSES + 7] = np.bincount(at[size <= 2], minlength=total) / words
    bucket = (word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    out[:, N_CLASSES + 8 :] = np.bincount((at << WORD_BITS) + bucket, minlength=total << WORD_BITS).reshape(total, -1) / (in_passage + PASSAGE // 4)[:, None]  # few words tell little
    return out, passages


def bags_of(texts: list[bytes]) -> list[np.ndarray]:
    """The measures of each text's passages."""
    measures, passages = measure(texts)
    return np.split(measures, np.cumsum(passages)[:-1])


def _distinct(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The group of each distinct (group, value)."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return g[new]


@dataclass
class Model:
    """Weights by name, and the mean and spread of the measures."""

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, passages: np.ndarray) -> dict[str, np.ndarray]:
        """All layers for passages x of bags with ``passages`` rows each, one after another."""
        w, first = self.weights, np.concatenate([[0], np.cumsum(passages)[:-1]])
        bag = np.repeat(np.arange(len(passages)), passages)
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        tanh, gate = np.tanh(h @ w["attend"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (tanh * gate) @ w["weigh"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        alpha = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(alpha[:, None] * h, first)
        p = 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["score_bias"], -30, 30)))
        return {"bag": bag, "first": first, "h": h, "tanh": tanh, "gate": gate, "alpha": alpha, "z": z, "p": p}

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x, passages = measure(texts)
        return self.forward(self.scaled(x), passages)["p"]


def fit(x: np.ndarray, passages: np.ndarray, y: np.ndarray, hidden: int = 16, attention: int = 8, steps: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Model:
    """Full-batch Adam on the log loss of bags. With one class, or none, the score is constant."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0), np.zeros(0), {}, constant=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    weights = {"encode": draw(x.shape[1], hidden), "encode_bias": np.zeros(hidden), "attend": draw(hidden, attention), "gate": draw(hidden, attention), "weigh": draw(attention), "score": draw(hidden), "score_bias": np.zeros(1)}
    model = Model(x.mean(0), x.std(0) + 1e-3, weights)
    x = model.scaled(x)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    for step in range(1, steps + 1):
        f = model.forward(x, passages)
        d = (f["p"] - y) / len(y)
        bag, first, h, alpha = f["bag"], f["first"], f["h"], f["alpha"]
        dz = d[:, None] * weights["score"]
        dalpha = (dz[bag] * h).sum(1)
        de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, first)[bag])
        both = de[:, None] * weights["weigh"]
        dt, dg = both * f["gate"] * (1 - f["tanh"] ** 2), both * f["tanh"] * f["gate"] * (1 - f["gate"])
        dh = (alpha[:, None] * dz[bag] + dt @ weights["attend"].T + dg @ weights["gate"].T) * (1 - h * h)
        grads = {"encode": x.T @ dh, "encode_bias": dh.sum(0), "attend": h.T @ dt, "gate": h.T @ dg, "weigh": (f["tanh"] * f["gate"]).T @ de, "score": f["z"].T @ d, "score_bias": d.sum(keepdims=True)}
        for k, g in grads.items():
            g = g + decay * weights[k]
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            weights[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def held_out(key: str) -> Column:
    """Whether a row's crc32(key as text) mod 3 is 1, which training never sees; false for null."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def portions(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from the labelled rows of df that are not held out: ``sample`` rows and PASSAGES passages of each
    at most, so the measures that reach the driver take 100 MB at most.

    Labels that are null are left out; of several labels for one key the least counts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64(F.lit(3), "_key"), "_key").limit(sample)
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key").select("_key", "_text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            found = [bag[:: -(-len(bag) // PASSAGES)] for part in portions(texts) for bag in bags_of(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([m.astype("<f4").tobytes() for m in found], pa.binary())], ["_key", "_label", "measures"])

    schema = rows.select("_key", "_label").withColumn("measures", F.lit(b"")).schema
    got = sorted((r["_key"], r["_label"], bytes(r["measures"])) for r in rows.mapInArrow(run, schema).collect())
    bags = [np.frombuffer(m, "<f4").reshape(-1, MEASURES) for _, _, m in got]
    if not bags:
        return fit(np.zeros((0, MEASURES)), np.zeros(0, int), np.zeros(0))
    return fit(np.concatenate(bags).astype(np.float64), np.array([len(b) for b in bags]), np.array([y for _, y, _ in got], float))


def score(df: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df's columns (``text`` only if asked for), with score (double) and predicted (int).

    Null and empty texts are one passage without words and are scored like others. Columns of df
    named score or predicted are replaced.
    """
    kept = [c for c in df.columns if c not in ("score", "predicted") and (keep_text or c != text)]
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select(*kept).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(len(kept)).to_pylist()]
            p = np.concatenate([shared.value.score(part) for part in portions(texts)]) if texts else np.zeros(0)
            own = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    return df.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(key, held_out, score, predicted) for each row of df, by a model trained on its labelled rows.

    Null and empty texts are one passage without words, very long ones are scored whole. Rows that share a key
    are scored each, and each teaches with the key's label; a null key is not held out and has no label. A
    score of 0.5 is predicted as 1. Without labels, or with labels of one kind, all scores are equal. An empty
    table gives no rows. Other columns are not read.
    """
    model = train(df, labels, key, text, label, sample)
    return score(df.select(key, text), model, text).select(key, held_out(key).alias("held_out"), "score", "predicted")
