"""MinHash join, fill-in-the-middle and spelling variants: odd rows and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechreport.llm import fill_middle, minhash_join, ngram_join, shingles, spelling
from speechreport.sources import scratch
from tests.llm.test_odd_rows import CLASH, ROWS, SCHEMA, edited

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in (*CLASH, "form", "word", "output", "g", "m")})


def brute_sets(text, n):
    ws = tuple((text or "").encode().lower().split())
    return {ws[i : i + n] for i in range(max(1, len(ws) - n + 1))} if ws else set()


# shingles


@pytest.mark.parametrize("n", [3, 5])
def test_word_hashes_do_not_depend_on_blocks(monkeypatch, n):
    rnd = random.Random(n)
    parts = ["a", "B", "é", "x" * 9, "word", " ", "\n", "\t  ", "\x0b", "\xa0", "日本", "y" * 70]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + [None, "", " ", "one", " two"]
    whole = shingles.shingle_sets(texts, n)
    assert [len(s) for s in whole] == [len(brute_sets(t, n)) for t in texts]
    monkeypatch.setattr(shingles, "BLOCK", 64)
    small = shingles.shingle_sets([t for t in texts if "y" not in (t or "")], n)
    assert all(np.array_equal(a, b) for a, b in zip(small, [s for s, t in zip(whole, texts, strict=True) if "y" not in (t or "")], strict=True))
    cut = shingles.shingle_sets(texts, n)
    assert [len(s) for s in cut] == [len(s) for s in whole]
    assert all(np.array_equal(a, shingles.shingle_sets([t], n)[0]) for a, t in zip(cut, texts, strict=True))


# MinHash


def brute_components(docs, n=3, percent=85):
    sets, root = [brute_sets(t, n) for t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(len(docs))]


def test_minhash_odd_rows(odd):
    rows = minhash_join.link(odd).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None}
    for key, text, _ in ROWS:
        if key is not None:
            assert got[key] == (len(brute_sets(text, 3)), 7 if key in (7, 8) else key, key != 8)
    assert {(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None} == {(None, True)}
    assert minhash_join.link(odd.limit(0)).collect() == []


@pytest.mark.parametrize(("broadcast", "members", "share"), [(1 << 26, 32, 4096), (-1, 3, 2)])
def test_minhash_matches_brute_force_in_groups_of_near_copies(spark, monkeypatch, broadcast, members, share):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(ngram_join, "PAIRED", members)
    monkeypatch.setattr(ngram_join, "SHARE", share)
    rng, docs = np.random.default_rng(members), []
    for g, most in enumerate((7, 9, 12, 16)):
        base = [f"g{g}w{x}" for x in rng.integers(0, 400, 150)]
        docs += [" ".join(edited(rng, base, most)) for _ in range(40)]
    docs += [" ".join([f"p{i}" for i in range(60)] + [f"u{rng.integers(0, 10**6)}" for _ in range(rng.integers(2, 30))]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = minhash_join.link(df).collect()
    want = brute_components(docs)
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(want))
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in rows) and 20 < len(set(want)) < len(docs) - 60


def test_bands_find_pairs_at_the_threshold():
    assert (1 - 0.85**minhash_join.ROWS) ** minhash_join.BANDS < 1e-7


def test_posterior_bounds():
    """A pair at the threshold passes every step but for a small chance; one far below it falls at the first."""
    steps = minhash_join.least_matches(85, minhash_join.HASHES, minhash_join.BATCH, 1e-3)
    assert [k for k, _ in steps] == [28, 56, 84, 112, 140] and all(m < 0.85 * k for k, m in steps)
    rng = np.random.default_rng(0)
    for t, low, high in ((0.85, 0.98, 1), (0.4, 0, 0.01)):
        drawn = np.cumsum(rng.random((4000, minhash_join.HASHES)) < t, axis=1)
        kept = np.all([drawn[:, k - 1] >= m for k, m in steps], axis=0)
        assert low <= kept.mean() <= high
    # the bound is the largest number of agreements whose posterior stays below the probability
    for k, m in steps:
        grid = (np.arange(200_000) + 0.5) / 200_000
        for agreed, wanted in ((m - 1, True), (m, False)):
            weight = np.exp(agreed * np.log(grid) + (k - agreed) * np.log1p(-grid) - (agreed * np.log(agreed / k) + (k - agreed) * np.log1p(-agreed / k)))
            assert (weight[grid >= 0.85].sum() / weight.sum() < 1e-3) == wanted


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
    y = np.unique(np.concatenate([x[:1500], rng.integers(0, 2**63, 500).astype(np.uint64)]))
    a, b = minhash_join.family(4000)
    agreed = (minhash_join.signature(x, a, b) == minhash_join.signature(y, a, b)).mean()
    assert abs(agreed - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.03


# fill-in-the-middle


def plain_fim(key, text):
    text = text or ""
    units = TOKEN.findall(text)
    told = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(told[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_matches_a_plain_program(spark, odd, monkeypatch):
    monkeypatch.setattr(fill_middle, "PORTION", 200)
    rnd = random.Random(4)
    letters = " \t\n\x0b\x0c\r\x1c\x08\x0e\x1f!aé日😀\xa0\x85\x00<PS>M"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(600)] + ["a<P>b", " " * 16, "x" * 16, "<", "ab <S"]
    rows = list(enumerate(texts))
    for df, given in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (odd, [r[:2] for r in ROWS])):
        found = fill_middle.transform(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in found) == Counter((k, *plain_fim(k, t), t or "") for k, t in given)
    assert {r["form"] for r in found} <= {"plain", "psm", "spm"}
    assert fill_middle.transform(odd.limit(0)).collect() == []


def test_fill_middle_keeps_bytes_that_are_not_text(spark):
    df = spark.sql("select id as doc_id, cast(unhex('61FF2062C328') as string) as text from range(40)")
    found = fill_middle.transform(df).select("form", F.hex(F.col("output").cast("binary")).alias("x"), "n").collect()
    assert {r["n"] for r in found} == {2} and {r["x"] for r in found if r["form"] == "plain"} == {"61FF2062C328"}
    assert {len(r["x"]) for r in found if r["form"] != "plain"} == {30}


# spelling


def plain_variants(rows):
    total = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            total[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: c for w, c in total.items() if len(w) >= 7 and c >= 2}
    cut, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            cut[i, shorter].add(w)
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in cut.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    found = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        found[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return found


def variant_rows():
    """Words that share long halves, repeated letters, very long words, words of few letters only, and chains of forms."""
    rnd, words = random.Random(3), []
    for _ in range(1500):
        w = list("internationalinternational")
        for _ in range(rnd.randint(0, 2)):
            k = rnd.randrange(len(w))
            w[k : k + 1] = [rnd.choice("abcdefé")] if rnd.random() < 0.5 else []
        words.append("".join(w))
    words += ["q" * 3000, "q" * 3001, "q" * 2999 + "z", "q" * 3000] * 3 + ["".join(rnd.choice("ab") for _ in range(rnd.randint(7, 9))) for _ in range(500)]
    words += ["Chained"] * 3000 + ["chainedx"] * 200 + ["chainedxy"] * 12 + ["ÀÉchained", "àéchained", "Àéchained"] * 9
    rows = [(i if i % 7 else None, " ".join(rnd.choices(words, k=60))) for i in range(500)]
    return [*rows, (None, None), (5, ""), (1, "q" * 3000), (1, "q" * 3000), (2, "×÷ÿ7chained,chained")]


@pytest.mark.parametrize(("cells", "block"), [(1 << 15, 128), (200, 8)])
def test_variants_match_a_plain_program(spark, monkeypatch, cells, block):
    monkeypatch.setattr(spelling, "CELLS", cells)
    rows = variant_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "g", "m", "p", "s")})
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}
    want = plain_variants(rows)
    assert found == want
    assert len([w for w in want.values() if w[0] is not None and w[0] != w[1]]) > 0 and max(w[3] for w in want.values()) > 5
    if block == 8:
        assert plain_pairs(spelling, list(want)[:300], block)


def plain_pairs(module, words, block):
    """Blocks of any size give the same pairs."""
    group, m = np.zeros(len(words), np.int64), np.array([max(map(len, words))] * len(words), np.int32)
    words = sorted(w for w in words if len(w) >= m[0] - 1) or words
    group, m = group[: len(words)], m[: len(words)]
    args = (words, group, m, np.zeros(len(words), np.int32), m)
    before = set(zip(*map(np.ndarray.tolist, module.near(*args)), strict=True))
    old, module.BLOCK = module.BLOCK, block
    after = set(zip(*map(np.ndarray.tolist, module.near(*args)), strict=True))
    module.BLOCK = old
    return before == after


def test_variants_of_odd_tables(odd, spark):
    rows = [r[:2] for r in ROWS]
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(odd).collect()} == plain_variants(rows)
    assert spelling.variants(odd.limit(0)).collect() == []
