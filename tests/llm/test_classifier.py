"""The classifier against plain programs, and its accuracy on documents that it hasn't seen."""

import math
import random

import numpy as np

from speechreport.llm import mil_quality as mil

SF = "/root/testdata/sf0.01"


def plain_measures(text):
    """One list of measures for each 64 words of a text, by loops."""
    words = text.split()
    found = []
    # a passage's bytes run from its first word up to the next passage's first word; white space counts for no class of its own
    for begin in range(0, max(1, len(words)), mil.PASSAGE):
        own = words[begin : begin + mil.PASSAGE]
        row, n = [0.0] * mil.MEASURES, len(own)
        if not n:
            found.append(row)
            continue
        letters = sum(map(len, own))
        for w in own:
            for b in w:
                row[mil.CLASS_OF[b]] += 1 / letters
        hashes = [word_hash(w) for w in own]
        k = mil.N_CLASSES
        row[k] = (1 + len(set(zip(own, own[1:], strict=False)))) / n
        row[k + 1] = sum(x == y for x, y in zip(own, own[1:], strict=False)) / n
        row[k + 2] = len(set(own)) / n
        row[k + 3] = letters / n
        row[k + 4] = math.log1p(n)
        row[k + 5] = sum(len(w) >= mil.LONG_WORD for w in own) / n
        row[k + 6] = sum(w[:1].isupper() and w[0] < 128 for w in own) / n
        row[k + 7] = sum(len(w) <= 2 for w in own) / n
        for h in hashes:
            row[k + 8 + ((h * 0x9E3779B97F4A7C15) % 2**64 >> (64 - mil.WORD_BITS))] += 1 / (n + mil.PASSAGE // 4)
        found.append(row)
    return found


def word_hash(word):
    return sum((b + 1) * ((i * i * 7919 + i * 104729 + 1) % 1000003) for i, b in enumerate(word)) + len(word) * 1_000_000_007


def test_measures_match_a_plain_program():
    rnd = random.Random(1)
    letters = "aábcde FGH 12 .,!#$ \n\t日"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 900))).encode() for _ in range(60)] + [b"", b" ", b"word word WORD a", ("lorem ipsum " * 200).encode()]
    x, passages = mil.measure(texts)
    want = [plain_measures(t) for t in texts]
    assert passages.tolist() == [len(w) for w in want]
    assert np.allclose(x, np.array([row for w in want for row in w]))


def test_layers_match_a_plain_program():
    rng = np.random.default_rng(2)
    passages = np.array([1, 3, 2, 5])
    x = rng.normal(size=(passages.sum(), mil.MEASURES))
    model = mil.fit(x, passages, np.array([0.0, 1.0, 0.0, 1.0]), steps=3)
    w, scaled, at = model.weights, model.scaled(x), 0
    got = model.forward(scaled, passages)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    for k, n in enumerate(passages):
        hidden = [[math.tanh(dot(row, w["encode"][:, j]) + w["encode_bias"][j]) for j in range(w["encode"].shape[1])] for row in scaled[at : at + n]]
        energy = []
        for h in hidden:
            gated = [math.tanh(dot(h, w["attend"][:, j])) / (1 + math.exp(-dot(h, w["gate"][:, j]))) for j in range(w["attend"].shape[1])]
            energy.append(math.exp(dot(gated, w["weigh"])))
        alpha = [e / sum(energy) for e in energy]
        bag = [dot(alpha, [h[j] for h in hidden]) for j in range(len(hidden[0]))]
        assert np.allclose(got["alpha"][at : at + n], alpha) and np.isclose(got["p"][k], 1 / (1 + math.exp(-(dot(bag, w["score"]) + w["score_bias"][0]))))
        at += n


def test_held_out_accuracy_and_attention(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = mil.train(docs, labels)
    seen = mil.score(docs, model).join(labels, "doc_id").filter(mil.held_out("doc_id")).filter("quality is not null").collect()
    assert len(seen) > 80 and sum(r["predicted"] == r["quality"] for r in seen) >= 0.97 * len(seen)
    # of a long document that is junk in one half, attention looks more at one of the halves
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    long = {q: [t for i, t in texts.items() if quality.get(i) == q and len(t.split()) >= 128][:20] for q in (0, 1)}
    shares = []
    for good, bad in zip(long[1], long[0], strict=False):
        both = " ".join(good.split()[:128] + bad.split()[:128]).encode()
        x, passages = mil.measure([both])
        alpha = model.forward(model.scaled(x), passages)["alpha"]
        shares.append(alpha[2:].sum())
    assert shares and abs(np.mean(shares) - 0.5) > 0.02
