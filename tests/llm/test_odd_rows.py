"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import html
import io
import re
import wave
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from speechreport.llm import budget_mix, chat_snapshots, host_rules, license_join, media, mil_quality, ngram_join, packing, range_coder
from speechreport.sources import scratch

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
TEXTS = [None, "", "   \n\t", "one", "a b c d", "Ünïcödé — текст 日本語 \U0001f600 " * 8, LONG, "same text here " * 30, "same text here " * 30, "x" * 5000, "\x00\x1c odd \x85 bytes   end", "<|endoftext|> it's 12½", "a <|endoftext|> b <|startoftext|>c"]
ROWS = [(i if i != 3 else None, t, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "s1"), (7, TEXTS[7], "s1"), (None, None, None)]
SCHEMA = "doc_id long, text string, source string"
#: Names that operators use themselves.
CLASH = ("n", "size", "taken", "score", "kept", "start", "n_words", "_key", "_words", "quality", "row", "ids", "node", "digest", "html", "_row")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(12)] + [(1, None), (2, 1), (None, 1)], "doc_id long, quality int")


def plain_tokens(path, text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_classifier(odd, labels):
    rows = mil_quality.classify(odd, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_classifier_with_nothing_to_learn(odd, labels):
    assert {r["score"] for r in mil_quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert mil_quality.classify(odd.limit(0), labels).collect() == []


def test_license_scan(odd):
    rows = license_join.scan(odd).collect()
    assert len(rows) == len(ROWS)
    assert all(r["n_base"] == 0 and r["labels"] == "" and r["score"] == 0 for r in rows)
    assert {r["n_words"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0} and max(r["n_words"] for r in rows) == 60_000
    assert license_join.scan(odd.limit(0)).collect() == []


def test_license_scan_finds_planted_blocks(spark):
    body = "lorem ipsum dolor " * 40
    notice = license_join.TEMPLATES["mit"].split()
    texts = {
        1: body + license_join.TEMPLATES["bsd"].upper().replace(" ", ", ") + ". " + body,
        2: body + " ".join(w for i, w in enumerate(notice) if i % 7) + ". " + body,
        3: body + " ".join(notice[::3]) + ". " + body,
        4: "The MIT  License\nand (MIT) license; CC-BY; cc by",
    }
    rows = {r["doc_id"]: r for r in license_join.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (rows[1]["labels"], rows[1]["score"]) == ("bsd", 1.0)
    assert rows[2]["labels"] == "mit" and 0.8 <= rows[2]["score"] < 1 and rows[2]["base_labels"] == ""
    assert rows[3]["labels"] == "" and rows[3]["score"] == 0
    assert (rows[4]["n_base"], rows[4]["first_word"], rows[4]["last_word"], rows[4]["base_labels"], rows[4]["score"]) == (4, 1, 8, "cc-by,mit", 1.0)


def test_license_statements_name_versions(spark):
    body = "lorem ipsum dolor " * 40
    texts = {
        1: body + "Licensed under the Apache License, Version 2.0." + body,
        2: body + "under version 3 of the GNU General Public License. " + body,
        3: body + "Licensed under CC BY-NC 4.0" + body,
        4: "All rights " + body + "reserved",
        5: body + "(c) ALL RIGHTS RESERVED",
        6: body + "apache license, version " + "x " * 20 + "2.0",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: (r["base_labels"], r["labels"], r["score"]) for r in license_join.scan(df).collect()}
    assert rows[1] == ("apache", "apache,apache-2.0", 1.0) and rows[2] == ("gpl", "gpl,gpl-3.0", 1.0) and rows[3] == ("cc-by", "cc-by,cc-by-nc", 1.0)
    assert rows[4] == ("", "", 0.0) and rows[5] == ("", "all-rights-reserved", 1.0) and rows[6] == ("apache", "apache", 1.0)
    assert {r["labels"] for r in license_join.scan(df, templates={}, statements={}).collect()} == {"", "apache", "gpl", "cc-by"}


def test_license_blocks_hold_long_templates(spark):
    long = " ".join(f"clause{i}" for i in range(120))
    body = ["lorem"] * 500
    texts = {i: " ".join(body[:i] + long.split()[: 120 - 6 * (i % 5)] + body[i:]) for i in (0, 1, 67, 128, 250, 499)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_join.scan(df, templates={"long": long, "mit": license_join.TEMPLATES["mit"]}).collect()}
    assert {i: r["labels"] for i, r in rows.items()} == {i: "long" for i in texts}
    assert {i: round(r["score"], 9) for i, r in rows.items()} == {i: round((120 - 6 * (i % 5)) / 120, 9) for i in texts}
    found = license_join.hits(df, "doc_id", "text", sorted(set(long.split())))
    for r in license_join.matches(found, {"long": long}).collect():
        ws = texts[r["_id"]].split()[r["start"] : r["start"] + r["block"]]
        assert r["block"] == 256 and r["start"] % 128 == 0 and r["containment"] == len({w for w in ws if w.startswith("clause")}) / 120 >= 0.8


@pytest.mark.parametrize("with_rows", [True, False])
def test_packing(odd, with_rows):
    df = odd if with_rows else odd.limit(0)
    rows = packing.pack(df, WORDS, with_ids=True).collect()
    if not with_rows:
        assert rows == []
        return
    own = {}
    for r in rows:
        own.setdefault(r["doc_id"], []).append(r)
    for key, text in {k: t for k, t, _ in ROWS if k is not None and k != 7}.items():
        ids, at = plain_tokens(WORDS, text), 0
        for r in sorted(own[key], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) == zlib.crc32(r["ids"])
            at += r["length"]
        assert at == len(ids)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert [s * 4096 + o for s, o, _ in places] == [0, *np.cumsum([n for *_, n in places])[:-1].tolist()]
    assert sum(n for *_, n in places) == sum(len(plain_tokens(WORDS, t)) for _, t, _ in ROWS)


def test_packing_fills_windows_to_target_shares(spark):
    rows = [(i, "tok " * (20 + i % 50), "big" if i % 4 else "small") for i in range(4000)]
    sized = spark.createDataFrame([(i, i, s, len(t.split()) + 1) for i, t, s in rows], "row long, doc_id long, source string, size long")
    found = packing.schedule(sized, length=512, weights={"big": 1, "small": 1}, window=4096).collect()
    seen = {}
    for r in found:
        seen.setdefault(r["round"], {"big": 0, "small": 0})[rows[r["row"]][2]] += r["span"]
    both = [w for w in seen.values() if w["big"] and w["small"]][:-2]
    assert len(both) > 5
    totals = {"big": 0, "small": 0}
    for number, w in enumerate([seen[k] for k in sorted(seen)][: len(both)], 1):
        for s in totals:
            totals[s] += w[s]
            assert abs(totals[s] - number * 2048) < 512  # the deficit carried is less than a packet


def test_chat_snapshots(spark):
    said = lambda c, *ts: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(ts)]
    rows = said(1, "a") + said(2, "a", "b") + said(3, "a", "b", "c") + said(4, "a", "x") + said(5, "a", "b", "c") + said(6, None, "") + said(7, "") + [(None, 0, "user", "q"), (8, 0, None, None), (8, 0, None, None), (9, None, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("place", "conv", "n_turns")})
    found = {r["conv_id"]: r for r in chat_snapshots.collapse_and_render(df).collect()}
    assert set(found) == {3, 4, 6, 8}
    assert (found[3]["n_turns"], found[3]["n_copies"]) == (3, 2)
    assert found[3]["rendered"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert found[6]["rendered"] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert chat_snapshots.collapse_and_render(df.limit(0)).collect() == []


def test_chat_snapshots_with_very_long_texts_and_ties(spark):
    rows = [(1, 0, "user", LONG), (2, 0, "user", LONG), (2, 1, "assistant", LONG + " more"), (3, 0, "user", LONG + "."), (4, 0, "user", "a"), (4, 0, "user", "b"), (5, 0, "user", "b"), (5, 0, "user", "a")]
    found = {r["conv_id"]: r for r in chat_snapshots.collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: (r["n_turns"], r["n_copies"]) for k, r in found.items()} == {2: (2, 1), 3: (1, 1), 4: (2, 2)}
    assert found[2]["rendered"] == f"<|im_start|>user\n{LONG}<|im_end|>\n<|im_start|>assistant\n{LONG} more<|im_end|>\n"


def brute_sets(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_ngram_join(spark, odd):
    rows = ngram_join.link(odd).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    for key, text, _ in ROWS:
        if key is not None:
            assert got[key] == (len(brute_sets(text)), 7 if key in (7, 8) else key)
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert ngram_join.link(odd.limit(0)).collect() == []


def edited(rng, base, most, least=0):
    ws = list(base)
    for _ in range(rng.integers(least, most)):
        i, kind = rng.integers(0, len(ws)), rng.integers(0, 3)
        ws[i : i + int(kind != 2)] = [f"e{rng.integers(0, 10**6)}"] * int(kind != 1)
    return ws


def plain_components(docs):
    """The smallest number that each text reaches by links, by comparing all pairs."""
    sets, root = [brute_sets(t) for t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(len(docs))]


@pytest.mark.parametrize(("broadcast", "members", "hot"), [(1 << 26, 32, 13), (-1, 3, 13), (1 << 26, 0, 3)])
def test_ngram_join_matches_brute_force_in_groups_of_near_copies(spark, monkeypatch, broadcast, members, hot):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(ngram_join, "PAIRED", members)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rng = np.random.default_rng(3 + members)
    docs, passage = [], [f"p{i}" for i in range(60)]
    for g, most in enumerate((9, 9, 9, 14, 14, 20)):
        base = [f"g{g}w{x}" for x in rng.integers(0, 400, 150)]
        docs += [" ".join(edited(rng, base, most)) for _ in range(40)]
    chain = [f"c{i}" for i in range(150)]
    for _ in range(30):  # each text is an edit of the one before
        chain = edited(rng, chain, 6)
        docs.append(" ".join(chain))
    docs += [" ".join(passage + [f"u{rng.integers(0, 10**6)}" for _ in range(rng.integers(2, 30))]) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link(df).collect()}
    want = plain_components(docs)
    assert got == dict(enumerate(want))
    assert 30 < len(set(want)) < len(docs) - 100


def test_few_pairs_of_a_large_group_are_compared(spark, monkeypatch):
    """A text and copies that differ from it in a quarter, hence from each other in 40 per cent: hardly any pair of copies is compared."""
    compared, verify = [], ngram_join.verify

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(ngram_join, "verify", counted)
    rng, size = np.random.default_rng(1), 400
    base = [f"w{x}" for x in range(200)]
    docs = [" ".join(base)] + [" ".join(edited(rng, base, 9, 5)) for _ in range(size)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(plain_components(docs)))
    assert len(set(got.values())) > size // 2
    assert compared[0] < 5 * size and compared[1] < size * size / 2 / 50


def test_keys_with_several_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, one), (5, two), (3, two), (7, one + " more"), (8, ""), (8, "x y z"), (9, None), (9, "q"), (4, "x y z")]
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (4, 4), (5, 3), (5, 3), (7, 3), (8, 4), (8, 4), (9, 9), (9, 9)]


@pytest.mark.parametrize("long", [range_coder.LONG, 500])
def test_range_coder(odd, monkeypatch, long):
    monkeypatch.setattr(range_coder, "LONG", long)
    monkeypatch.setattr(range_coder, "STRETCH", 1)
    monkeypatch.setattr(range_coder, "CHECKPOINT_STEPS", 7 if long == 500 else range_coder.CHECKPOINT_STEPS)
    rows = range_coder.write_and_read(odd, BYTES).collect()
    assert len(rows) == len(ROWS)
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1].tolist()]
    keys = [r["doc_id"] for r in ordered]
    assert keys[:2] == [None, None] and keys[2:] == sorted(keys[2:])
    texts = {k: t for k, t, _ in ROWS if k is not None}
    for r in ordered[2:]:
        ids = plain_tokens(BYTES, texts[r["doc_id"]])
        assert bytes(r["ids"]) == ids.tobytes() and r["ids_crc32"] == zlib.crc32(ids.tobytes())
    assert range_coder.write_and_read(odd.limit(0), BYTES).collect() == []


def test_host_rules(odd):
    rows = host_rules.apply_rules(odd, out_keep=["doc_id", "text", "source"]).collect()
    assert len(rows) == len(ROWS)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 20)
    same = next(r for r in rows if r["doc_id"] == 7)
    assert (same["n_words"], same["n_repeat_words"], same["kept"]) == (90, 90, False)
    assert host_rules.apply_rules(odd.limit(0)).collect() == []
    assert "quality" in host_rules.apply_rules(odd).columns


def test_host_verdict_moves_limits(spark):
    clean = lambda h, i: f"clean {h} text number {i} " + " ".join(f"w{i}{k}" for k in range(30))
    edge = " ".join(f"w{k}" + "#" * (k % 3 == 0) for k in range(30))
    junk = " ".join(f"w{k}###" for k in range(30))
    rows = [("bad", junk + str(i)) for i in range(60)] + [("good", clean("g", i)) for i in range(60)] + [("bad", edge), ("good", edge), ("bad", clean("b", 1))]
    df = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], SCHEMA)
    kept = {r["doc_id"]: r["kept"] for r in host_rules.apply_rules(df).collect()}
    assert (kept[120], kept[121], kept[122]) == (False, True, True)
    assert not any(kept[i] for i in range(60)) and all(kept[i] for i in range(60, 120))


def plain_wav(payload):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setparams((1, 1, 16_000, 0, "NONE", ""))
        f.writeframes(payload)
    return out.getvalue()


def plain_feature(payload):
    n, hist = len(payload), [0] * 8
    for x in payload:
        hist[x // 32] += 1
    rms = (sum((x - 128) ** 2 for x in payload) / n) ** 0.5
    return f"n={n};mean={sum(payload) / n:.4f};rms={rms:.4f};peak={max(abs(x - 128) for x in payload)};hist={','.join(map(str, hist))}"


def test_media(odd):
    rows = media.store_and_resolve(odd).collect()
    assert len(rows) == len(ROWS)
    texts = {k: t for k, t, _ in ROWS if k is not None}
    for r in rows:
        if r["doc_id"] is not None:
            data = (texts[r["doc_id"]] or "").encode()
            payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
            assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
            assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
            stored = plain_wav(payload)
            assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
            assert r["feature"] == plain_feature(payload) and (r["position"], r["caption"]) == (1, f"{len(data)} bytes of text")
    assert media.store_and_resolve(odd.limit(0)).collect() == []


def test_media_are_stored_once(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (None, "a"), (4, None), (5, ""), (6, "c"), (6, "c"), (None, "d"), (None, "d")]
    stored = media.store_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    counts = {}
    for r in stored:
        counts[bytes(r["media"])[44:].rstrip(b"\0")] = counts.get(bytes(r["media"])[44:].rstrip(b"\0"), 0) + 1
    assert counts == {b"a": 1, b"b": 1, b"": 1, b"c": 2, b"d": 2}
    assert all(r["digest"] == hashlib.sha256(bytes(r["media"])[44:]).hexdigest() for r in stored)


def test_sequences_of_whole_pages(spark):
    """All text of the given pages outside scripts and styles, in order."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.join(media.sequences(pages).withColumnRenamed("page_id", "_id"), F.col("page_id") == F.col("_id")).collect()
    assert len(rows) == pages.count()
    for r in rows:
        bare = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ", r["html"] or "")
        assert [i["kind"] for i in r["items"]].count("text") == len(r["items"])
        assert "".join("".join(i["text"] for i in r["items"]).split()) == "".join(html.unescape(bare).split())


def test_sequences_keep_positions_and_captions(spark):
    stored = media.materialize(media.store_texts(spark.createDataFrame([(1, "hello")], "doc_id long, text string")))
    digest = stored.first()["digest"]
    page = f'<p>before<script>no</script></p><figure><img src="sha256:{digest}" alt="alt"><figcaption>A <b>cap</b></figcaption></figure>between<audio src="sha256:{"0" * 64}"></audio><div>after'
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<<>< & text")], "page_id long, html string")
    rows = media.resolve(media.sequences(df), stored).orderBy("page_id", "position").collect()
    assert [(r["page_id"], r["position"], r["kind"], r["text"], r["caption"], r["payload_bytes"]) for r in rows[:5]] == [
        (1, 0, "text", "before", None, None), (1, 1, "image", None, "A cap", 64), (1, 2, "text", "between", None, None), (1, 3, "audio", None, None, None), (1, 4, "text", "after", None, None)]
    assert {r["page_id"] for r in rows} == {1, 4}


def test_packing_holds_shares_in_every_sequence(spark):
    sources = 20
    sized = spark.createDataFrame([(i, i, f"s{i % sources}", 20 + i % 30) for i in range(6000)], "row long, doc_id long, source string, size long")
    found = packing.schedule(sized, length=1024, weights={f"s{i}": 1 for i in range(sources)}, window=4096).collect()
    served, last = [0] * sources, max(r["sequence_id"] for r in found)
    pieces = {}
    for r in found:
        pieces.setdefault(r["sequence_id"], []).append((r["row"] % sources, r["span"]))
    for number in range(last // 2):
        for source, span in pieces[number]:
            served[source] += span
        assert max(served) - min(served) < 2 * 50  # a packet behind and a packet cut by the sequence's end
    assert abs(max(r["round"] for r in found) * 4096 / sum(r["span"] for r in found) - 1) < 0.3


def test_captions_are_not_lost():
    text, image = (lambda t: ["text", t, None, None, None]), (lambda r, c=None: ["image", None, r, c, None])
    pages = {
        "<figure><figcaption>x</figcaption><img src=a><img src=b alt=y></figure>z": [image("a", "x"), image("b", "x"), text("z")],
        "a<figcaption>x</figcaption>b": [text("a"), text("x"), text("b")],
        "a<figcaption>x<p>b": [text("a"), text("x"), text("b")],
        "<figure><figcaption>x</figcaption><pre>code</pre></figure>z": [text("x"), text("code"), text("z")],
        "<figure><img src=a><figcaption>x</figure>z": [image("a", "x"), text("z")],
        "<figure><figcaption>x<p>y": [text("x y")],
        "<figure><figcaption>x</figcaption><p>y<img src=a>": [text("y"), image("a", "x")],
        "<figure><img src=a><figcaption>x</figcaption>y": [image("a", "x"), text("y")],
        "<figure><figure><figcaption>x</figcaption><img src=a></figure><figcaption>y</figcaption></figure>z": [image("a", "x"), text("y"), text("z")],
        "<figure><img src=a><figcaption>x</figcaption><figcaption>y</figcaption></figure>": [image("a", "x y")],
        "<figure><img src=a alt=y><figcaption> </figcaption></figure>": [image("a", "y")],
    }
    assert {page: media.parse(page) for page in pages} == pages


def test_mix(odd):
    rows = budget_mix.mix(odd.withColumnRenamed("size", "other")).collect()
    again = budget_mix.mix(odd).collect()
    assert sorted(map(repr, ((r["doc_id"], r["taken"]) for r in rows))) == sorted(map(repr, ((r["doc_id"], r["taken"]) for r in again)))
    assert len(rows) == len(ROWS) and all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], [r["target"], 0, r["source_size"]])[1] += r["taken"]
    assert all(taken <= target + 1 and target <= 3 * size for target, taken, size in by.values())
    assert budget_mix.mix(odd.limit(0)).collect() == []
