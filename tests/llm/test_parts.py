"""Parts of operators against plain programs."""

import random
import struct
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from speechreport.llm import budget_mix, mil_quality, range_coder, shingles, tokens, warc


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_cut_texts_encode_as_whole_ones(name, kind, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 300)
    encoder, rnd = tokens.Encoder(public_tokenizers.path(name), kind), random.Random(2)
    letters = "ab Éß\n\t  '\x85\xa0\x1c\x00s t12²½%.,#İK<|endoftext|>µª\r日é́ÀÿŸ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + ["".join(chr(rnd.randint(0, 255)) for _ in range(50)) for _ in range(500)]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    for token in encoder.added:
        texts += [token, f"a {token} b", f"É{token.upper()}{token}é ", f" {token}{token} x", token[:-1]]
    plain = lambda t: np.array(library.encode(t, add_special_tokens=False).ids, encoder.dtype).tobytes()
    assert len(encoder.added) > 0 and [t for t in texts if encoder.encode(t) != plain(t)] == []
    assert [t for t in texts if encoder.encode(t) != encoder.whole(t)] == []


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 300_000])
def test_blocks_round_trip_from_every_checkpoint(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.01, n), 40_000).astype("<u2")
    table = range_coder.Table(range_coder.quantize(np.bincount(np.append(ids, [1, 50_000]), minlength=50_001)))
    docs = [(None, ids[:10]), (7, ids[10:])]
    block = range_coder.encode_block(docs, table, every=16)
    found, out, _ = range_coder.decode_block(block, table)
    assert found == [(None, len(ids[:10])), (7, len(ids[10:]))] and np.array_equal(out, ids)
    marks = struct.unpack_from("<I", block, 20)[0]
    for k in range(1, marks + 1):
        _, part, lead = range_coder.decode_block(block, table, k)
        assert 0 < len(part) < n and lead == n - len(part) and np.array_equal(part, ids[lead:])
        _, part, lead = range_coder.decode_block(block, table, k - 1, k)
        assert len(part) and np.array_equal(part, ids[lead : lead + len(part)])
    for at in (0, len(block) // 2, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            range_coder.decode_block(bytes(broken), table)


@pytest.mark.parametrize("tokens", [1, 20_000, 10**6])
def test_stretches_of_a_block_decode_by_themselves(tokens):
    rnd = np.random.default_rng(tokens)
    ids = np.minimum(rnd.geometric(0.01, 200_000), 40_000).astype("<u2")
    table = range_coder.Table(range_coder.quantize(np.bincount(ids, minlength=50_001)))
    ends = np.sort(rnd.choice(200_000, 30))
    docs = [(None if i % 7 == 0 else i, x) for i, x in enumerate(np.split(ids, [0, *ends[:5], ends[4], *ends[5:]]))]
    block = range_coder.encode_block(docs, table, lanes=64, every=16)
    found, said, place = [], [], 0
    for first, n, lead, own in range_coder.stretches(block, tokens):
        parts, out, _ = range_coder.decode_block(own, table)
        assert first == place and n == len(out) == sum(k for _, k in parts)
        for k in range(1, range_coder.count_marks(own) + 1):
            _, rest, at = range_coder.decode_block(own, table, k)
            assert np.array_equal(rest, out[at:])
        if lead:
            assert found[-1][0] == parts[0][0] and found[-1][1] == lead
            found[-1] = (found[-1][0], lead + parts[0][1])
            parts = parts[1:]
        found += parts
        said.append(out)
        place += n
    assert np.array_equal(np.concatenate(said), ids) and found == [(k, len(x)) for k, x in docs]
    assert len(said) == 1 if tokens == 10**6 else len(said) > 9


def test_frequencies_sum_and_keep_rare_symbols():
    freq = range_coder.quantize(np.array([10**9, 0, 1, 3]))
    assert freq.sum() == 1 << range_coder.BITS and freq[1] == 0 and freq[2] >= 1
    assert range_coder.quantize(np.zeros(3, int)).sum() == 0


def best_sum(counts, budget):
    reach = {0}
    for n, c in counts.items():
        reach = {s + k * n for s in reach for k in range(c + 1) if s + k * n <= budget}
    return max(reach)


def test_budgets_are_met_as_well_as_can_be():
    rnd = random.Random(8)
    for _ in range(150):
        counts = {rnd.randint(1, 60): rnd.randint(1, 6) for _ in range(rnd.randint(1, 8))}
        budget = rnd.randint(0, sum(n * c for n, c in counts.items()) + 5)
        got = budget_mix.fill(counts, budget, seed=1)
        assert all(0 <= got[n] <= counts[n] for n in counts)
        total = sum(n * k for n, k in got.items())
        assert total == best_sum(counts, budget)


def test_large_budgets_leave_the_exact_program_little():
    rnd = random.Random(9)
    counts = {n: rnd.randint(1, 400) for n in range(1, 3000)}
    budget = sum(n * c for n, c in counts.items()) // 3
    got = budget_mix.fill(counts, budget, seed=1)
    assert sum(n * k for n, k in got.items()) == budget


@pytest.mark.parametrize("few", [budget_mix.FEW, 0])
def test_budgets_are_met_exactly(monkeypatch, few):
    monkeypatch.setattr(budget_mix, "FEW", few)
    assert budget_mix.fill({5000: 3, 4000: 4}, 16_000, seed=1) == {5000: 0, 4000: 4}
    rnd = random.Random(10)
    for longest, docs, lengths, program in ((60, 6, 8, 1 << 16), (60, 6, 8, 4), (50_000, 3, 5, 1 << 16), (40, 30, 3, 0)):
        for unit in (1, 7):
            for _ in range(40):
                counts = {unit * rnd.randint(1, longest): rnd.randint(1, docs) for _ in range(rnd.randint(1, lengths))}
                budget = rnd.randint(0, sum(n * c for n, c in counts.items()) + 5)
                got = budget_mix.fill(counts, budget, seed=1, program=program)
                assert all(0 <= got[n] <= counts[n] for n in counts)
                assert sum(n * k for n, k in got.items()) == best_sum(counts, budget)


def test_few_long_lengths_take_little_memory():
    counts = {200_003: 2000, 200_009: 2000}
    for budget in (3, 200_008, 123_456_789, 400_012_345, 700_000_001):
        tracemalloc.start()
        got = budget_mix.fill(counts, budget, seed=1)
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
        tracemalloc.stop()
        best = max(a * 200_003 + min(2000, (budget - a * 200_003) // 200_009) * 200_009 for a in range(2001) if a * 200_003 <= budget)
        assert all(0 <= got[n] <= counts[n] for n in counts) and sum(n * k for n, k in got.items()) == best


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(capped.values()), [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s: 3.0 * sizes[s] for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mix_does_not_depend_on_partitions(spark):
    rows = [(None if i % 3 else i % 6, " ".join([f"w{i}"] * (i % 7 + 1)), "ab"[i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = [sorted(map(repr, budget_mix.mix(df.repartition(n), keep=["doc_id", "text"]).collect())) for n in (1, 7)]
    assert found[0] == found[1] and len(found[0]) == 120


def test_targets(spark):
    rnd = random.Random(3)
    for _ in range(4):
        sizes = {f"s{i}é" if i % 2 else f"S{i}": rnd.choice([0, 1, 5, 40, 1000, 90_000]) for i in range(rnd.randint(1, 14))} | {None: 17}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in budget_mix.targets(df).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def test_shingles():
    a, b, c = shingles.shingle_sets(["a b c d e f", "A B\tC d e F", "b a c d e f"])
    assert len(a) == 2 and np.array_equal(a, b) and len(np.intersect1d(a, c)) == 0
    short, other, none = shingles.shingle_sets(["x y", "y x", " "])
    assert len(short) == len(other) == 1 and short[0] != other[0] and len(none) == 0
    long = " ".join(map(str, range(9000)))
    assert len(shingles.shingles(long)) == 8996 and np.array_equal(shingles.all_sets([long, "q"])[0], shingles.shingles(long))


def test_passages_do_not_depend_on_neighbours():
    texts = [b"", b"one two", ("Some WORDS here, 12! " * 90).encode(), "été ça".encode(), b" \n ", b"x" * 3000]
    x, passages = mil_quality.measure(texts)
    assert passages.tolist() == [1, 1, 6, 1, 1, 1]
    alone = np.concatenate([mil_quality.measure([t])[0] for t in texts])
    assert np.allclose(x, alone)


def test_gradients_lower_the_loss_and_attention_finds_the_passage():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 8, 300)
    y = rng.integers(0, 2, 300).astype(float)
    x = rng.normal(size=(sizes.sum(), mil_quality.MEASURES))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = first + rng.integers(0, sizes)
    x[at, 0] += 6 * y  # one passage of each positive bag tells
    model = mil_quality.fit(x, sizes, y)
    out = model.forward(model.scaled(x), sizes)
    assert ((out["p"] >= 0.5) == y).mean() > 0.95
    told = (y == 1) & (sizes > 2)
    assert out["alpha"][at[told]].mean() > 1.5 * (1 / sizes[told]).mean()


PAGES = [
    (1, "u", "x" * 120), (2, "u", "x" * 120), (3, None, None), (4, "a b\nc", "short"), (5, "u", "short"),
    (6, "u", "evil WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"),
    (7, "u", "WARC/1.1\r\n"), (8, "u", "é" * 200 + "\r\n\r\n"), (9, "u", "é" * 200 + "\r\n\r\n"), (None, "u", "nul" * 50), (10, "u", "nul" * 50), (11, "u", "nul" * 50), (10, "u", "nul" * 50), (12, "v", "long " * 100_000),
]


def test_warc_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("n", "digest", "first", "body")})
    rows = warc.write_and_read(df, str(tmp_path / "w")).collect()
    assert len(rows) == len(PAGES) and all(r["intact"] for r in rows)
    got = {r["page_id"]: r for r in rows}
    assert {k for k, r in got.items() if r["record_type"] == "revisit"} == {2, 9, 11}
    assert (got[2]["refers_to"], got[9]["refers_to"], got[11]["refers_to"]) == (1, 8, 10)
    for key, _, html in PAGES:
        assert got[key]["payload_bytes"] == len((html or "").encode())
        assert got[key]["payload"] is None or bytes(got[key]["payload"]) == (html or "").encode()
    assert warc.write_and_read(df.limit(0)).collect() == []


def archive(version, *payloads):
    """An archive by hand; its header lines are in an order of their own and each record has one more."""
    out = b""
    for i, x in enumerate(payloads):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + x
        out += f"WARC/{version}\r\nContent-Length: {len(block)}\r\nwarc-type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nX-Else: 1\r\n\r\n".encode() + block + b"\r\n\r\n"
    return out


def test_versions_of_archives(spark, tmp_path):
    inner = archive("1.0", b"inner")
    payloads = [b"a", inner, b"WARC/", b"WARC/1.0\r\nWARC/1.1\r\n" + inner, b""]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "old.warc").write_bytes(archive("1.0", *payloads))
    (tmp_path / "w" / "new.warc").write_bytes(archive("1.1", b"other"))
    (tmp_path / "w" / "empty.warc").write_bytes(b"")
    got = sorted((r["page_id"], bytes(r["payload"]), r["record_type"]) for r in warc.read(spark, str(tmp_path / "w")).collect())
    assert got == sorted([*((i, x, "response") for i, x in enumerate(payloads)), (0, b"other", "response")])
    for name, bad in {"unknown": archive("0.18", b"x"), "junk": b"junk" + archive("1.0", b"x"), "plain": b"no archive"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.warc").write_bytes(bad)
        with pytest.raises(ValueError, match="1 files"):
            warc.read(spark, str(tmp_path / name))


def test_chains_across_blocks_and_breaks(spark):
    rows = [("f", i * 10, i * 10 + 10) for i in range(500)] + [("f", 5, 10), ("f", 333, 340), ("g", 0, 7), ("g", 8, 16), ("h", 3, 9), ("h", 9, 12)]
    df = spark.createDataFrame(rows, "file string, at long, next long")
    got = {(r["file"], r["at"]) for r in warc.reachable(df, block=64).collect()}
    assert got == {("f", i * 10) for i in range(500)} | {("g", 0)}
