"""The stages of the corpus pipeline on odd rows, empty tables and the given documents, against plain programs."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from speechreport.llm import host_rules
from tests.llm.test_odd_rows import LONG, plain_components, plain_tokens
from tests.oracle import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = " ".join(f"Some{i} words that stand for{i} a text, number {i}." for i in range(12))
TEXTS = [None, "", " \n\t", "one two", GOOD, GOOD, GOOD + " more", LONG, "été " * 30, "x" * 3000, "# " * 40, " ".join(f"other{i}" for i in range(60))]
ROWS = [(i if i != 3 else None, t, "en" if i % 2 else None, None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
ROWS += [(4, GOOD, "en", "s1", 5), (4, GOOD, "en", "s1", 5), (None, GOOD, None, None, None), (None, GOOD, None, None, None), (7, "same id, other text " * 9, "en", None, 1)]
STAGES = dict(cp.STAGES)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in ("_id", "_times", "taken", "size", "kept", "score", "component_id", "n_words", "row", "ids")})


def tuples(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows_and_empty_tables(spark, odd, name):
    found = STAGES[name](spark, odd, SF)
    if name != "pack":
        assert tuple(found.columns) == cp.COLUMNS
        known = {repr(tuple(r)) for r in odd.select(*cp.COLUMNS).collect()}
        assert set(tuples(found)) <= known
    assert found.count() > 0
    empty = STAGES[name](spark, odd.limit(0), SF)
    assert empty.columns == found.columns and empty.collect() == []


def test_quality_rules_keep_what_the_rules_keep(spark, odd):
    judged = host_rules.apply_rules(odd.select(*cp.COLUMNS)).filter("kept").select(*cp.COLUMNS)
    assert tuples(cp.quality_rules(spark, odd, SF)) == tuples(judged)
    assert all(len((r["text"] or "").split()) >= 20 for r in judged.collect())


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = np.random.default_rng(5)
    docs = [f"w{x} " * 3 for x in range(20)]
    for g in range(5):
        base = [f"g{g}w{i}" for i in range(80)]
        for _ in range(8):
            ws = list(base)
            for i in rng.integers(0, 80, rng.integers(0, 4)):
                ws[i] = f"e{rng.integers(0, 10**6)}"
            docs.append(" ".join(ws))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(docs)] + [(None, docs[30], "en", "s", 1), (3, docs[3], "aa", "s", 1)], SCHEMA)
    rows = cp.near_duplicates(spark, df, SF).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(set(plain_components(docs)))
    assert [r["text"] for r in rows if r["doc_id"] is None] == [docs[30]]
    assert [r["lang"] for r in rows if r["doc_id"] == 3] == ["aa"]  # of rows with one id the least stays


@pytest.mark.parametrize("with_ids", [True, False])
def test_source_mix_meets_its_targets_row_by_row(spark, with_ids):
    """Sources weigh 5, 2, 1 and are taken three times at most; rows without ids are rows of their own."""
    rng = np.random.default_rng(6)
    rows = [(i if with_ids or i % 2 else None, " ".join(f"w{i}x{k}" for k in range(rng.integers(1, 40))), "en", "abc"[i % 3], 1) for i in range(300)]
    taken = cp.source_mix(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    size = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "abc"}
    total, target, left = sum(size.values()), {}, dict(zip("abc", (5, 2, 1), strict=True))
    while left:
        rest = total - sum(target.values())
        over = {s: 3 * size[s] for s, w in left.items() if rest * w / sum(left.values()) > 3 * size[s]}
        if not over:
            target |= {s: rest * w / sum(left.values()) for s, w in left.items()}
            break
        target |= over
        left = {s: w for s, w in left.items() if s not in over}
    for s in "abc":
        got = sum(len(r["text"].split()) for r in taken if r["source"] == s)
        assert abs(got - target[s]) <= 1
    times = {}
    for r in taken:
        times[r["text"]] = times.get(r["text"], 0) + 1
    assert max(times.values()) <= 3 and set(times) <= {r[1] for r in rows}


def test_pack_holds_every_token_once(spark, odd):
    pieces = cp.pack(spark, odd, SF).collect()
    want = sum(len(plain_tokens(public_tokenizers.path("word_bpe_49k.json"), r[1])) for r in ROWS)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in pieces)
    assert sum(n for *_, n in places) == want
    assert [s * 4096 + o for s, o, _ in places] == [0, *np.cumsum([n for *_, n in places])[:-1].tolist()]


def test_the_whole_pipeline(spark):
    pieces = cp.run(spark, SF).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert pieces and {r["doc_id"] for r in pieces} <= docs
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in pieces)
    assert [s * 4096 + o for s, o, _ in places] == [0, *np.cumsum([n for *_, n in places])[:-1].tolist()]
