"""Cases of the operators that the given tables don't hold."""

import hashlib
import io
import json
import math
import random
import wave
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from speechreport.functions import columns as C
from speechreport.operators import batches, conversations, inference, network, prompts, quality, replies, slots, validate
from speechreport.plans import standins
from speechreport.plans.pipelines import identified, run_pipelines, transcripts_of
from speechreport.sources import documents, recordings, schemas
from speechreport.streaming import chunks, intake


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def wav(samples, channels=1, rate=16000):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


@pytest.mark.parametrize(("name", "suffix"), [("a.wav", "wav"), ("A.MP3", "mp3"), (".wav", ""), ("none", ""), ("x.tar.flac", "flac"), ("d.e/x", ""), (None, "")])
def test_file_suffix(spark, name, suffix):
    assert one(spark, C.file_suffix(F.lit(name).cast("string")))[0] == suffix


@pytest.mark.parametrize(("model", "part"), [("openai:a/b", "a-b"), ("gemini:x", "gemini-x"), ("_-x-_", "x"), (None, ""), ("a<b>|?c", "a-b---c")])
def test_sanitize_part(spark, model, part):
    assert one(spark, C.sanitize_part(F.lit(model).cast("string")))[0] == part


@pytest.mark.parametrize(("path", "name"), [("d/take.wav", "take_m.docx"), (None, "report_m.docx"), ("", "report_m.docx"), (".hidden", ".hidden_m.docx"), ("a.b.c", "a.b_m.docx")])
def test_output_name(spark, path, name):
    assert one(spark, C.output_name(F.lit(path).cast("string"), [F.lit("m"), F.lit(None).cast("string")]))[0] == name


def test_rtl_and_parts(spark):
    row = one(spark, C.is_rtl(F.lit("abc")), C.is_rtl(F.lit("x گ")), C.is_rtl(F.lit(None).cast("string")), C.resolve(F.lit(""), F.lit(None).cast("string"), F.lit("z")))
    assert tuple(row) == (False, True, False, "z")


REPLIES = [
    ('```json\n{"notes": "a"}\n``` tail {', "a"),
    ('{"a":1} mid {"b":2}', None),
    ("{'a':1}", None),
    ('{"notes":NaN}', "NaN"),
    ('{"notes":"1","notes":"3"}', "3"),
    ('{"notes":01}', None),
    ('{"notes":"x",}', None),
    ("} {", None),
    ("no brace", None),
    ('{"notes":"x"}\n```', None),
    ('[{"notes":"x"}]', "x"),
    ("", None),
    (None, None),
]


def test_extract_json(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, reply string")
    found = {r["i"]: r for r in replies.extract_json(df).collect()}
    for i, (reply, notes) in enumerate(REPLIES):
        assert (found[i]["status"] == 502) == (notes is None), reply
        assert notes is None or found[i]["report"]["notes"] == notes


def test_merge_keeps_missing_and_unknown_keys(spark):
    reply = '{"transcript_1": "mine", "discrepancies_found": ["a", {"b": 1}], "other": 5, "final_text": null}'
    df = spark.createDataFrame([("r", "t1", "t2", None, reply)], "recording_id string, transcript_1 string, transcript_2 string, transcript_3 string, reply string")
    row = slots.merge_report(replies.extract_json(df)).first()
    assert (row["transcript_1"], row["transcript_2"], row["final_text"], row["notes"]) == ("mine", "t2", None, None)
    assert row["discrepancies_found"] == ["a", '{"b": 1}'] and row["extra"] == {"other": "5"}
    assert set(row["present_keys"]) == {"transcript_1", "discrepancies_found", "other", "final_text"}


def test_sections_keep_empty_transcripts_and_string_order(spark):
    t = F.create_map(*[F.lit(x) for x in ("transcript_2", "", "transcript_10", "ten")])
    row = one(spark, prompts.engine_sections(t), prompts.reference_sections(t), prompts.engine_sections(F.create_map().cast("map<string,string>")))
    assert row[0] == "STT engine 2 transcript:\n"
    assert row[1].startswith("Reference transcript 1 ") and row[1].index("ten") < row[1].index("Reference transcript 2")
    assert row[2] is None


def test_request_shapes(spark):
    a = F.lit(b"xy")
    bodies = one(spark, *[prompts.render_request(s, F.lit(m), F.lit('s"'), F.lit(u), a, F.lit("wav")) for s, m, u in (("chat", "openai:m", "u"), ("audio_chat", "openai:m", "u"), ("audio_chat", "openai:m", ""), ("inline", "gemini:m", "u"))])
    chat, audio, bare, inline = map(json.loads, bodies)
    assert chat == {"model": "m", "messages": [{"role": "system", "content": 's"'}, {"role": "user", "content": "u"}], "response_format": {"type": "json_object"}}
    sound = {"type": "input_audio", "input_audio": {"data": "eHk=", "format": "wav"}}
    assert audio["messages"][1]["content"] == [sound, {"type": "text", "text": "u"}] and bare["messages"][1]["content"] == [sound]
    assert inline["contents"][0]["parts"] == [{"text": 's"\n\nu'}, {"inline_data": {"mime_type": "audio/wav", "data": "eHk="}}]
    assert inline["system_instruction"] == {"parts": [{"text": 's"'}]}


def test_decode_audio(spark):
    stereo = np.stack([np.full(800, 8192), np.full(800, 0)], 1).ravel()
    rows = [("mono", wav([100] * 160)), ("stereo", wav(stereo, 2, 8000)), ("empty", wav([])), ("bad", b"not-real-audio"), ("none", None)]
    found = {r["recording_id"]: r for r in inference.decode_audio(spark.createDataFrame(rows, "recording_id string, content binary")).collect()}
    assert len(found["mono"]["samples"]) == 160 and found["mono"]["samples"][0] == pytest.approx(100 / 32768)
    assert len(found["stereo"]["samples"]) == 1600 and found["stereo"]["samples"][800] == pytest.approx(0.125, abs=2e-3)
    assert found["empty"]["samples"] == [] and found["empty"]["status"] is None
    assert found["bad"]["status"] == found["none"]["status"] == 400


def test_broken_files_are_rows_with_a_status(spark):
    whole = wav([1, 2, 3, 4])
    rows = [("odd", whole[:-3]), ("rate", whole[:24] + bytes(4) + whole[28:]), ("channels", whole[:22] + bytes(2) + whole[24:]), ("head", whole[:30]), ("good", whole)]
    found = {r["recording_id"]: r["status"] for r in inference.decode_audio(spark.createDataFrame(rows, "recording_id string, content binary")).collect()}
    assert found == {"odd": 400, "rate": 400, "channels": 400, "head": 400, "good": None}


def test_resampling_keeps_a_tone():
    t = np.arange(8000) / 8000
    out = inference.resample(np.sin(2 * np.pi * 440 * t), 8000)
    want = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert np.abs(out - want)[200:-200].max() < 0.01


class Broken:
    def transcribe(self, audio, rate, language, access):
        raise RuntimeError("out of memory")


class Many:
    """Takes all calls of a portion at once and tells what it got."""

    def transcribe_all(self, calls):
        return [f"{len(calls)}:{audio}:{language}:{access['api_key']}" for audio, _, language, access in calls]


def slot_rows(spark, rows):
    """Rows (recording_id, said, slots as (slot_no, model, language, api_key, base_url))."""
    slot = "array<struct<slot_no:int,model:string,language:string,api_key:string,base_url:string>>"
    return spark.createDataFrame([(i, said, [(n, *x) for n, x in enumerate(slots, 1)]) for i, said, slots in rows], f"recording_id string, said string, slots {slot}")


def test_row_errors_do_not_fail_the_job(spark):
    plain = lambda *models: [(m, "fa", None, None) for m in models]
    df = slot_rows(spark, [("a", "x", plain("seamless", "broken")), ("b", "y", plain("seamless", "nope")), ("c", "z", plain("seamless"))])
    got = inference.transcribe(df, {**standins.STT, "broken": Broken}, audio="said")
    assert set(got.columns) == {"recording_id", "slot_no", "model", "language", "text", "status", "error"}
    good, rejects = inference.fail_recordings(got)
    assert [r["recording_id"] for r in good.collect()] == ["c"]
    assert {r["recording_id"]: r["error"] for r in rejects.collect()} == {"a": "RuntimeError: out of memory", "b": "unknown model: nope"}
    skipped, none = inference.fail_recordings(got, on_slot_error="skip")
    assert skipped.count() == 3 and none.count() == 0


def test_engines_get_calls_together_and_credentials(spark):
    df = slot_rows(spark, [("a", "x", [("many", "fa", "k1", None), ("many", "en", None, None)])])
    assert [r["text"] for r in inference.transcribe(df, {"many": Many}, audio="said").orderBy("slot_no").collect()] == ["2:x:fa:k1", "2:x:en:None"]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Odd:
    """Answers that are no texts."""

    def transcribe(self, audio, rate, language, access):
        return {"five": 5, "none": None, "half": "\ud800", "good": "text"}[audio]

    def chat_all(self, calls):
        return [{"five": 5, "half": "\ud800"}.get(messages[0]["content"], "text") for messages, *_ in calls]


def test_answers_that_are_no_texts_are_rows_with_a_status(spark):
    df = slot_rows(spark, [(x, x, [("odd", "fa", None, None)]) for x in ("five", "none", "half", "good")])
    assert {r["recording_id"]: (r["text"], r["status"]) for r in inference.transcribe(df, {"odd": Odd}, audio="said").collect()} == {"five": (None, 502), "none": (None, 502), "half": (None, 502), "good": ("text", None)}
    asked = spark.createDataFrame([(x, "odd", [("user", x)]) for x in ("five", "half", "good")], "recording_id string, llm_model string, messages array<struct<role:string,content:string>>")
    assert {r["recording_id"]: (r["reply"], r["status"]) for r in inference.chat(asked, {"odd": Odd}).collect()} == {"five": (None, 502), "half": (None, 502), "good": ("text", None)}


def test_an_engine_of_another_factory_is_not_taken(spark):
    df = slot_rows(spark, [("a", "x y", [("same", "fa", None, None)])])
    for old, new, want in (("x", "1", "1 y"), ("y", "2", "x 2"), ("x", "1", "1 y")):
        assert inference.transcribe(df, {"same": lambda old=old, new=new: standins.EchoSpeech(old, new)}, audio="said").first()["text"] == want


def test_replies_that_no_table_can_hold(spark):
    rows = [("half", '{"notes":"\\ud800"}'), ("key", '{"\\udc00":1}'), ("deep", '{"notes":' + "[" * 200_000 + "]" * 200_000 + "}"), ("pair", '{"notes":"\\ud83d\\ude00"}')]
    found = {r["k"]: (r["status"], r["report"] and r["report"]["notes"]) for r in replies.extract_json(spark.createDataFrame(rows, "k string, reply string")).collect()}
    assert found == {"half": (502, None), "key": (502, None), "deep": (502, None), "pair": (None, "\U0001f600")}


def test_sample_rates_out_of_range_are_errors():
    for rate, good in ((1, False), (249, False), (250, True), (1_024_000, True), (4_000_000_000, False)):
        body = wav([1] * 60)
        audio, error = inference.decode_wav(body[:24] + rate.to_bytes(4, "little") + body[28:])
        assert (audio is not None, error is None) == (good, good)


def test_resampling_by_chunks_gives_the_same_samples(monkeypatch):
    sound = np.sin(np.arange(5000) / 7)
    whole = inference.resample(sound, 11_025)
    monkeypatch.setattr(inference, "CHUNK", 100)
    assert np.array_equal(inference.resample(sound, 11_025), whole)


def test_calls_are_dealt_by_running_sums(spark):
    """Tasks grow with the work of a model, and each has about the same."""
    rows = [(f"r{i}", "popular" if i % 4 else "other", 100 + i % 50) for i in range(8000)] + [("null", None, 5)]
    df = spark.createDataFrame(rows, "recording_id string, llm_model string, bytes long").repartition(3)
    found = inference.dealt(df, "llm_model", "recording_id", F.col("bytes"), 10_000).withColumn("task", F.spark_partition_id())
    assert found.drop("task").exceptAll(df).isEmpty() and found.count() == len(rows)
    by = found.groupBy("task").agg(F.sum("bytes").alias("n"), F.countDistinct("llm_model").alias("models"), F.first("llm_model").alias("model")).collect()
    popular = [r["n"] for r in by if r["model"] == "popular"]
    assert len(popular) > 64 and max(r["models"] for r in by) <= 1
    assert max(popular) < 10_000 * 1.3 and min(popular) > 10_000 * 0.7
    weights = df.select("llm_model", "recording_id", F.col("bytes").alias("weight"))
    for sized in (weights, weights.limit(100)):  # rows without a weight are dealt as well
        assert inference.dealt(df, "llm_model", "recording_id", F.col("bytes"), 10_000, sized=sized).exceptAll(df).isEmpty()
        assert inference.dealt(df, "llm_model", "recording_id", F.col("bytes"), 10_000, sized=sized).count() == len(rows)
    assert inference.dealt(df.limit(0), "llm_model", "recording_id", F.col("bytes"), 10_000).count() == 0


def test_edit_counts_match_plain_program():
    rnd = random.Random(4)
    for _ in range(400):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))] if rnd.random() < 0.5 else [x for x in a if rnd.random() < 0.9]
        s, i, d = quality.count_edits(a, b)
        assert s + i + d == plain_distance(a, b)
        assert len(a) - d == len(b) - i
        assert all(x != y for x, y in ((a[i], b[j]) for i, j in quality.changes(a, b) if i >= 0 and j >= 0)) or quality.swaps(a, b) is None


def test_long_unrelated_texts_are_aligned_in_parts(monkeypatch):
    monkeypatch.setattr(quality, "TRACE", 500)
    rnd = random.Random(6)
    for _ in range(40):
        a, b = ([rnd.choice("abcdef") for _ in range(rnd.randint(0, 90))] for _ in range(2))
        assert sum(quality.count_edits(a, b)) == plain_distance(a, b)
        pairs = quality._traced(*quality.codes(a, b))
        assert [i for i, _ in pairs if i >= 0] == list(range(len(a))) and [j for _, j in pairs if j >= 0] == list(range(len(b)))


def test_aligned_words_stand_at_their_places():
    rnd = random.Random(7)
    for _ in range(200):
        pivot = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        other = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        told = quality.align_slots([(1, pivot), (2, other)])
        words = {2 * i: w for i, w in enumerate(pivot)} | {p: v[2] for p, v in told.items()}
        assert " ".join(words[p] for p in sorted(words) if words[p]) == " ".join(other)


def test_vote_and_discrepancies_with_insertions(spark):
    rows = [("r", 1, "the left lung is clear"), ("r", 2, "the left lungs is very clear"), ("r", 3, "the lung is very clear"), ("s", 2, "alone"), ("e", 1, ""), ("n", 1, None)]
    df = spark.createDataFrame(rows, "recording_id string, slot_no int, text string")
    voted = {r["recording_id"]: r["voted_text"] for r in quality.vote_transcript(df).collect()}
    assert voted == {"r": "the left lung is very clear", "s": "alone", "e": "", "n": ""}
    diffs = {r["position"]: r["variants"] for r in quality.discrepancies(df).collect()}
    assert diffs == {2: {1: "left", 2: "left", 3: ""}, 4: {1: "lung", 2: "lungs", 3: "lung"}, 7: {1: "", 2: "very", 3: "very"}}


def plain_steps(columns, words):
    """A cheapest path by the full table: a pair before a pass and that before a new column."""
    cost, came = {(0, 0): 0}, {}
    for i in range(len(columns) + 1):
        for j in range(len(words) + 1):
            ways = []
            if i and j:
                ways.append((cost[i - 1, j - 1] + (words[j - 1] not in columns[i - 1]), 0))
            if i:
                ways.append((cost[i - 1, j] + ("" not in columns[i - 1]), 1))
            if j:
                ways.append((cost[i, j - 1] + 1, 2))
            if ways:
                cost[i, j], came[i, j] = min(ways)
    i, j, steps = len(columns), len(words), []
    while i or j:
        way = came[i, j]
        steps.append((i - 1 if way != 2 else -1, j - 1 if way != 1 else -1))
        i, j = i - (way != 2), j - (way != 1)
    return steps[::-1]


def test_network_matches_a_plain_program():
    rnd = random.Random(8)
    for _ in range(500):
        said = [[rnd.choice("abcd") for _ in range(rnd.randint(0, 9))] for _ in range(3)]
        columns = [[w] for w in said[0]]
        for n, words in enumerate(said[1:], 1):
            columns = [(columns[i] if i >= 0 else [""] * n) + [words[j] if j >= 0 else ""] for i, j in plain_steps(columns, words)]
        assert network.network(said) == columns
        assert [[w for w in (c[k] for c in columns) if w] for k in range(3)] == said
    assert network.majority(network.network(["a c".split(), "a b x c".split(), "a b c".split()])) == ["a", "b", "c"]
    assert network.network([]) == [] and network.spans([["a"], ["b"]]) == []


def test_majority_words_win_wherever_they_stand():
    rnd = random.Random(9)
    for _ in range(60):
        text = [f"w{rnd.randint(0, 200)}" for _ in range(150)]
        at = rnd.sample(range(0, 150, 3), 20)  # places of edits, apart from each other, each in one transcript
        said = []
        for k in range(3):
            own = at[k::3]
            said.append([x for i, w in enumerate(text) for x in ((w,) if i not in own else ((), ("zz",), (w, "zz"))[i % 2 if i % 5 else 2])])
        assert network.majority(network.network(said)) == text


@pytest.mark.parametrize(("direct", "trace"), [(0, 1 << 25), (4096, 400), (0, 400)])
def test_long_transcripts_are_aligned_in_parts(monkeypatch, direct, trace):
    monkeypatch.setattr(network, "DIRECT", direct)
    monkeypatch.setattr(network, "TRACE", trace)
    rnd = random.Random(10)
    for size in (1, 5, 300):
        for _ in range(20):
            base = [f"w{rnd.randint(0, size)}" for _ in range(80)]
            said = [[w for w in base if rnd.random() < 0.95] for _ in range(3)]
            columns = network.network(said)
            assert [[w for w in (c[k] for c in columns) if w] for k in range(3)] == said
            assert len(columns) <= 90


def test_anchors_are_the_longest_chain():
    assert network.anchors([[1], [2], [3], [4], [5]], [3, 1, 2, 4, 4]) == [(0, 1), (1, 2)]
    assert network.anchors([[1, 2], [3, 0]], [2, 1, 3]) in ([(0, 1), (1, 2)], [(0, 0), (1, 2)])


def test_spans_of_neighbouring_columns(spark):
    rows = [("r", 1, "left lung is clear today"), ("r", 2, "left lungs very clear now"), ("r", 4, "lung is very clear today"), ("s", 2, "alone"), ("e", 1, ""), ("n", 1, None), ("n", 2, "new words")]
    found = {r["recording_id"]: [(s["start"], s["variants"]) for s in r["spans"]] for r in quality.discrepancy_spans(spark.createDataFrame(rows, "recording_id string, slot_no int, text string")).collect()}
    assert found["s"] == found["e"] == [] and found["n"] == [(0, {1: [], 2: ["new", "words"]})]
    assert found["r"] == [(0, {1: ["left", "lung", "is"], 2: ["left", "lungs", "very"], 4: ["lung", "is", "very"]}), (4, {1: ["today"], 2: ["now"], 4: ["today"]})]


def test_very_long_transcripts(spark):
    rnd = random.Random(11)
    base = [f"w{rnd.randint(0, 3000)}" for _ in range(20_000)]
    said = [[w for w in base if rnd.random() < 0.98] for _ in range(3)]
    df = spark.createDataFrame([("r", k, " ".join(ws)) for k, ws in enumerate(said, 1)], "recording_id string, slot_no int, text string")
    assert plain_distance(quality.vote_transcript(df).first()["voted_text"].split()[:1500], base[:1500]) < 10
    assert len(quality.discrepancy_spans(df).first()["spans"]) > 800


def test_last_user_turn_without_user(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c")], "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: (r["turn"], r["text"], r["status"]) for r in conversations.last_user_turn(df).collect()}
    assert found == {1: (None, None, 400), 2: (2, "c", None)}


SLOT_TEXTS = [
    ('\n[{"model":"a"}]\t', 1, None), ('[{"model":5}]', None, 400), ('[{"model":"a","language":{"x":1}}]', None, 400), ('[{"model":"a","model":"b"}]', 1, None), ('[{"model":"a","language":null,"more":[1]}]', 1, None),
    ('[{"model":"a"}] x', None, 400), ('[{"model":"a"}],[]', None, 400), ('[{"model":"a"}]]', None, 400), ('[{"model":"a"}]],"y":[[]', None, 400), ("[1]", None, 400), ('"x"', None, 400), ("[[]]", None, 400), ('[{"model":null}]', None, 400), ("[null]", 1, None), ("{}", 0, None), ('{"a":1}', None, 400), ("3", None, 400), ("null", 0, None), ('["x"]', None, 400), ("[{}]", None, 400), ('[{"model":"a"', None, 400), ('[{"model":"a"}, {"model":"b","language":"en"}]', 2, None),
]


@pytest.mark.parametrize(("text", "n", "status"), SLOT_TEXTS)
def test_slot_json(spark, text, n, status):
    row = recordings.read_requests(spark.createDataFrame([(text,)], "stt_slots_json string")).first()
    assert row["status"] == status and (status or len(row["stt_slots"]) == n)


def test_slot_json_gives_all_fields(spark):
    text = '[{"model":"a","model":"b","api_key":"k","base_url":"u","language":"en"}]'
    assert recordings.read_requests(spark.createDataFrame([(text,)], "stt_slots_json string")).first()["stt_slots"] == [("b", "k", "u", "en")]


def test_only_a_sessions_slots_are_limited(spark):
    four, slot = "[" + ",".join(['{"model":"m"}'] * 4) + "]", ("m", None, None, None)
    rows = [("a", four, None), ("b", None, [slot] * 4), ("c", four, [slot] * 4), ("d", None, [slot] * 3)]
    df = spark.createDataFrame([(*r, "separate", "openai:x") for r in rows], f"recording_id string, stt_slots_json string, stt_slots {schemas.SLOTS.simpleString()}, pipeline string, llm_model string")
    assert {r["recording_id"]: r["status"] for r in validate.validate_requests(recordings.read_requests(df)).collect()} == {"a": None, "b": 400, "c": 400, "d": None}


def test_white_space_and_default_name(spark):
    row = one(spark, C.qualify_model(F.lit("\n\t\u00a0m "), F.lit(True), "llm"), C.audio_format(F.lit(None).cast("string"), F.lit("openai:x")), C.audio_format(F.lit(""), F.lit("m")))
    assert tuple(row) == ("openai:m", "wav", "wav")
    df = spark.createDataFrame([(1, 0, "user", "\n\t"), (1, 1, "user", "q"), (1, 2, "user", None)], "conv_id long, turn long, role string, text string")
    assert [r["turn"] for r in conversations.chat_history(df).collect()] == [1]


def test_validation_keeps_an_earlier_status(spark):
    df = spark.createDataFrame([("separate", "m", 400, "invalid slot JSON")], "pipeline string, llm_model string, status int, error string").withColumn("stt_slots", F.lit(None).cast(schemas.SLOTS))
    assert validate.validate_requests(df).first()["error"] == "invalid slot JSON"


def test_sinks_and_sources(spark, tmp_path):
    (tmp_path / "in/x y").mkdir(parents=True)
    for name in ("a.wav", "x y/a.wav"):
        (tmp_path / "in" / name).write_bytes(wav([1, 2]))
    (tmp_path / "in/b.txt").write_text("no")
    assert sorted(r["recording_id"] for r in recordings.read_recordings(spark, str(tmp_path / "in")).collect()) == ["a.wav", "x y/a.wav"]
    assert [r["recording_id"] for r in recordings.read_recordings(spark, str(tmp_path / "in/x*")).collect()] == ["a.wav"]
    df = spark.createDataFrame([("a", "separate", None, None, "x")], "recording_id string, pipeline string, status int, error string, final_text string")
    recordings.write_reports(df, str(tmp_path / "out"))
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row["pipeline"] == "separate" and json.loads(row["result"]) == {"final_text": "x"}


def test_stream_of_recordings(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, body in (("a.wav", wav([5] * 32)), ("b.wav", b"broken")):
        (source / name).write_bytes(body)

    def asked(batch):
        slot = F.struct(F.lit("seamless").alias("model"), *[F.lit(None).cast("string").alias(k) for k in ("api_key", "base_url", "language")])
        return batch.select("recording_id", F.lit("separate").alias("pipeline"), F.lit("aya-expanse-8b").alias("llm_model"), F.lit("fa").alias("language"), F.array(slot).alias("stt_slots"), F.col("recording_id").alias("file_name"))

    stream = recordings.stream_recordings(spark, str(source))
    intake.run_stream(stream, asked, standins.STT, standins.LLM, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = {r["recording_id"]: r for r in spark.read.parquet(str(tmp_path / "out/batch=0")).collect()}
    assert json.loads(rows["a.wav"]["result"])["raw_transcript"] == "32 samples"
    assert rows["b.wav"]["status"] == 400


def test_documents_are_written_whole_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "documents")
    rows = [(1, "a.txt", "x"), (2, "a.txt", "y\nz"), (2, "a.txt", "y\nz"), (3, "b", None), (4, "b", "q"), (None, None, "n"), (5, "x/../y?.txt", "s"), (6, "n" * 300 + ".txt", "long"), (7, ".hidden", "h"), (8, ".hidden", "i")]
    df = spark.createDataFrame(rows, "recording_id long, name string, text string").repartition(3)
    documents.write_documents(df, out)
    found = sorted((r["name"], r["text"]) for r in documents.read_documents(spark, out).collect() if len(r["name"]) < 50)
    assert found == sorted([("a.txt", "x"), ("a_2.txt", "y\nz"), ("a_3.txt", "y\nz"), ("b", ""), ("b_2", "q"), ("report", "n"), ("x-..-y?.txt", "s"), ("report.hidden", "h"), ("report_2.hidden", "i")]), found
    assert documents.read_documents(spark, out).filter("text = 'long' and name like 'nnn%_.txt'").count() == 1
    broken = df.withColumn("text", F.when(F.col("recording_id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no"):
            documents.write_documents(broken, out, mode=mode)
        assert documents.read_documents(spark, out).count() == len(rows)
        assert not list((tmp_path / "documents").glob(f"{documents.STAGED}*"))
    documents.write_documents(df.filter("recording_id = 1"), out, mode="overwrite")
    assert [tuple(r) for r in documents.read_documents(spark, out).collect()] == [("a.txt", "x")]


def test_names_that_many_rows_share_are_numbered_in_ranges(spark):
    df = spark.range(3000).select(F.col("id").alias("key"), F.when(F.col("id") % 10 > 0, "same.txt").otherwise(F.concat(F.lit("own"), F.col("id"))).alias("name"))
    names = {r["key"]: r["name"] for r in documents.numbered(df, "name", "key").collect()}
    shared = [k for k in range(3000) if k % 10]
    assert [names[k] for k in shared] == ["same.txt"] + [f"same_{n}.txt" for n in range(2, len(shared) + 1)] and names[10] == "own10"


def test_stream_of_requests_and_recordings(spark, tmp_path):
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    slot = "array<struct<model:string,api_key:string,base_url:string,language:string>>"
    ask = lambda key, minute, kind="separate": (key, at(minute), kind, "aya-expanse-8b", "fa", [("seamless", None, None, None)], "a.wav")
    said = [[ask("a", 0), ask("late", 0), ask("none", 0), ask("bad", 0, "other"), ask(None, 0), ask("twice", 0)], [ask("first", 20)], [ask("end", 2000)]]
    heard = [[("a", at(5), wav([1] * 10)), ("first", at(12), wav([1] * 20)), ("twice", at(1), wav([1] * 30)), ("twice", at(1), wav([1] * 30))], [("late", at(40), wav([1] * 5))], [("end", at(2000), wav([]))]]
    schemas_ = (f"recording_id string, requested_at timestamp, pipeline string, llm_model string, language string, stt_slots {slot}, file_name string", "recording_id string, recorded_at timestamp, content binary")
    folders = [str(tmp_path / x) for x in ("said", "heard")]
    for n in range(3):  # requests and recordings come bit by bit, in several runs of the stream
        for rows, schema, folder in ((said[n], schemas_[0], folders[0]), (heard[n], schemas_[1], folders[1])):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        streams = [spark.readStream.schema(s).parquet(f) for s, f in zip(schemas_, folders, strict=True)]
        intake.run_request_stream(*streams, standins.STT, standins.LLM, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out/batch=*")).collect()
    found = sorted((r["recording_id"] or "", r["status"] or 0, json.loads(r["result"]).get("raw_transcript")) for r in rows if r["recording_id"] != "end")
    assert found == [("", 404, None), ("a", 0, "10 samples"), ("bad", 400, None), ("first", 0, "20 samples"), ("late", 404, None), ("none", 404, None), ("twice", 0, "30 samples")]


def test_stream_of_chunks(spark, tmp_path):
    schema = "recording_id string, seq long, ts timestamp, bytes binary, is_last boolean"
    source = str(tmp_path / "chunks")
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    batches = [
        [("a", 1, at(0), b"cc", False), ("a", 0, at(0), b"bb", False), ("b", 0, at(0), b"xx", False), ("a", 0, at(0), b"zz", False), ("n", None, at(0), b"no", True), ("n", 0, None, b"no", True), ("n", 0, at(0), None, None)],
        [("a", 2, at(1), b"dd", True), ("c", 0, at(1), b"yy", True), ("n", 1, at(1), b"z", True)],
        [("a", 1, at(2), b"again", False), ("a", 2, at(2), b"again", True), ("c", 0, at(1), b"yy", True)],
        [("d", 0, at(60), b"qq", False)],
        [("e", 0, at(120), b"qq", True)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = chunks.assemble_chunks(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    told = lambda df, wrap: {r["recording_id"]: (r["status"], r["n_chunks"], wrap(bytes(r["content"]))) for r in df.collect()}
    rows = spark.read.parquet(str(tmp_path / "out"))
    found = told(rows, bytes)
    assert rows.count() == len(found)
    assert found["a"] == ("complete", 3, chunks.to_wav(b"bbccdd")) and found["c"][0] == "complete"
    assert found["b"][:2] == ("incomplete", 1)
    # the finished table gives the same recordings, and those that may still wait in the stream
    whole = told(chunks.assemble_batch(spark.read.parquet(source)), chunks.to_wav)
    assert {k: v for k, v in whole.items() if k in found} == found and set(whole) - set(found) <= {"d"}


class Deaf:
    def transcribe(self, audio, rate, language, access):
        raise RuntimeError("deaf")


def asked(spark, rows):
    """Requests and recordings for rows (recording_id, pipeline, language, models of slots)."""
    told = [(i, p, "aya-expanse-8b" if p == "separate" else "gemma-4-e4b", lang, [(m, None, None, None) for m in models], "a.wav") for i, p, lang, models in rows]
    requests = spark.createDataFrame(told, f"recording_id long, pipeline string, llm_model string, language string, stt_slots {schemas.SLOTS.simpleString()}, file_name string")
    return requests, spark.createDataFrame([(i, f"said {i}") for i, *_ in rows], "recording_id long, said string")


def test_requests_whose_slots_all_failed_keep_a_row(spark):
    requests, heard = asked(spark, [(1, "separate", "fa", ["deaf", "deaf"]), (2, "separate", "fa", ["deaf", "seamless"]), (3, "hybrid", "fa", ["deaf"])])
    stt = standins.STT | {"deaf": Deaf}
    skipped = {r["recording_id"]: (r["status"], r["error"], r["raw_transcript"]) for r in run_pipelines(requests, heard, stt, standins.LLM, "said", on_slot_error="skip").collect()}
    assert skipped == {1: (400, "no usable transcript", None), 2: (None, None, "said 2"), 3: (None, None, "said 3")}
    failed = sorted((r["recording_id"], r["status"]) for r in run_pipelines(requests, heard, stt, standins.LLM, "said").collect())
    assert failed == [(1, 502), (2, 502), (3, 502)]


def test_transcripts_are_regrouped_in_tasks_that_grow_with_their_characters(spark, monkeypatch):
    """A task has a bounded part of the texts, whatever the session's number of partitions, which is 4 here."""
    monkeypatch.setattr(inference, "REGROUP_CHARS", 20_000, raising=False)
    requests, _ = asked(spark, [(i, "separate", "fr" if i % 10 == 0 else "fa", ["seamless", "whisper"]) for i in range(400)])
    heard = spark.range(400).select(F.col("id").alias("recording_id"), F.repeat(F.lit("a the "), 100).alias("said"))
    assembled = transcripts_of(identified(requests), heard, standins.STT, "said", "fail")[0]
    chars = [r["n"] for r in assembled.groupBy(F.spark_partition_id()).agg(F.sum(F.length("transcript_1") + F.length("transcript_2")).alias("n")).collect()]
    assert sum(chars) == 360 * 1200 and max(chars) <= 3 * 20_000, chars
    found = run_pipelines(requests, heard, standins.STT, standins.LLM, "said").collect()
    assert {r["recording_id"]: r["status"] for r in found} == {i: 502 if i % 10 == 0 else None for i in range(400)} and len(found) == 400
    assert all(r["transcript_1"] == "a the " * 100 and r["transcript_2"] == "a zqx " * 100 for r in found if r["status"] is None)


def test_requests_with_a_fourth_slot_alone_have_no_usable_transcript(spark):
    requests, heard = asked(spark, [(1, "separate", "fa", ["seamless"] * 4), (2, "separate", "fa", ["seamless"] * 4)])
    alone = F.when(F.col("recording_id") == 1, F.transform("stt_slots", lambda s, i: F.when(i == 3, s))).otherwise(F.col("stt_slots"))
    found = run_pipelines(requests.withColumns({"stt_slots": alone, "run_slots": F.lit(True)}), heard, standins.STT, standins.LLM, "said").collect()
    assert {r["recording_id"]: (r["status"], r["error"], r["transcript_3"]) for r in found} == {1: (400, "no usable transcript", None), 2: (None, None, "said 2")}


def test_local_slots_with_unsupported_languages_fail(spark):
    rows = [(1, "separate", "fr", ["seamless"]), (2, "separate", "en", ["seamless"]), (3, "separate", "", ["seamless"]), (4, "separate", "fr", ["openai:x"]), (5, "hybrid", "de", ["openai:x", "seamless"])]
    requests, heard = asked(spark, rows)
    found = run_pipelines(requests, heard, standins.STT | {"openai:x": standins.EchoSpeech}, standins.LLM, "said", check_languages=True).collect()
    got = {r["recording_id"]: (r["status"], r["error"], r["raw_transcript"]) for r in found}
    assert len(found) == 5 and got == {1: (502, "unknown language: fr", None), 2: (None, None, "said 2"), 3: (None, None, "said 3"), 4: (None, None, "said 4"), 5: (502, "unknown language: de", None)}


class Told:
    """Tells what it was given."""

    def transcribe(self, audio, rate, language, access):
        return f"{len(audio)} {access['api_key']}"

    def chat(self, messages, params, access):
        return json.dumps({"notes": f"{params['do_sample']} {access['api_key']} {access['base_url']}"})

    def chat_audio(self, messages, audio, params, access):
        return json.dumps({"notes": f"{len(audio)} {params['temperature']}"})


def test_requests_of_one_recording_and_their_credentials(spark):
    slot = lambda key: ("m", key, None, None)
    rows = [
        ("r", "separate", "t", "fa", [slot("secret-1"), slot("secret-2")], "a.wav", 0.0, "secret-llm", "u"), ("r", "separate", "t", "en", [slot(None)], "a.wav", 0.9, None, None),
        ("r", "hybrid", "t", "fa", [slot(None)], None, None, None, None), ("r", "multimodal", "t", "fa", None, "a.wav", 0.0, None, None), ("r", "multimodal", "t", "fa", None, "a.wav", 0.0, None, None), ("bad", "separate", "t", "fa", [slot(None)], "a.wav", None, None, None),
    ]
    asked = spark.createDataFrame(rows, f"recording_id string, pipeline string, llm_model string, language string, stt_slots {schemas.SLOTS.simpleString()}, file_name string, temperature double, llm_api_key string, llm_base_url string")
    heard = spark.createDataFrame([("r", wav([7] * 50)), ("bad", b"no")], "recording_id string, content binary")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    found = run_pipelines(asked, heard, {"m": Told}, {"t": Told}, audio="content").collect()
    got = sorted((r["pipeline"], r["status"] or 0, r["transcript_1"] or "", r["transcript_2"] or "", r["notes"] or "") for r in found)
    assert got == [
        ("hybrid", 0, "50 None", "", "50 0.3"), ("multimodal", 0, "", "", "50 None"), ("multimodal", 0, "", "", "50 None"),
        ("separate", 0, "50 None", "", "True None None"), ("separate", 0, "50 secret-1", "50 secret-2", "False secret-llm u"), ("separate", 400, "", "", ""),
    ]
    kept = [spark.read.parquet(str(f)).columns for f in set(shared.iterdir()) - before]
    assert kept and not {"api_key", "base_url", "stt_slots", "slots", "content"} & {c for columns in kept for c in columns}


def test_keys_part_requests_and_cloud_slots_have_no_default_language(spark):
    class Told:
        def transcribe(self, audio, rate, language, access):
            if access["api_key"] == "bad":
                raise PermissionError("key")
            return f"{language}"

    slot = "array<struct<model:string,api_key:string,base_url:string,language:string>>"
    rows = [("r", "separate", "aya-expanse-8b", None, [(m, key, None, lang)]) for m, key, lang in (("openai:told", "good", None), ("openai:told", "bad", None), ("told", None, None), ("openai:told", "good", "de"))]
    asked = spark.createDataFrame(rows, f"recording_id string, pipeline string, llm_model string, language string, stt_slots {slot}").withColumn("file_name", F.lit("a.wav"))
    heard = spark.createDataFrame([("r", "x")], "recording_id string, said string")
    found = run_pipelines(asked, heard, {"openai:told": Told, "told": Told}, standins.LLM, "said").collect()
    assert sorted((r["status"] or 0, r["raw_transcript"] or "") for r in found) == [(0, "None"), (0, "de"), (0, "fa"), (502, "")], found
    assert len({r["request_id"] for r in found}) == 4


def test_a_recording_is_decoded_once_for_all_its_slots(spark, monkeypatch, tmp_path):
    log = tmp_path / "calls"

    df = spark.createDataFrame([(f"r{i}", wav([i] * 20), [(n, "m", "fa", None, None) for n in (1, 2, 3)]) for i in range(10)], "recording_id string, content binary, slots array<struct<slot_no:int,model:string,language:string,api_key:string,base_url:string>>")

    def decoded(content, target=16000, real=inference.decode_wav, path=str(log)):
        with open(path, "a") as f:
            f.write("x")
        return real(content, target)

    monkeypatch.setattr(inference, "decode_wav", decoded)
    cloudpickle.register_pickle_by_value(inference)  # so that tasks get the decoder that counts
    try:
        assert inference.transcribe(df, {"m": Told}, audio="content").count() == 30
    finally:
        cloudpickle.unregister_pickle_by_value(inference)
    assert log.read_text() == "x" * 10


def test_scratch_needs_a_shared_folder(spark):
    from speechreport.sources import scratch

    class Bare:
        conf = type("", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "local-cluster[3,2,3000]"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(Bare)


def test_scratch_tables_can_be_dropped(spark, tmp_path):
    from speechreport.sources import scratch

    one, own = scratch.written(spark.range(10)), str(tmp_path / "own")
    spark.range(3).write.parquet(own)
    scratch.dropped(one, spark.read.parquet(own))
    assert spark.read.parquet(own).count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        one.collect()


class Parrot:
    """Says how many messages it got and the last one, and fails at the word 'fail'."""

    def chat(self, messages, params, access):
        if "fail" in messages[-1]["content"]:
            raise RuntimeError("no")
        return f"{'/'.join(m['role'][0] for m in messages)} {messages[-1]['content']}"


CHATS = [
    ("a", 2, "user", " second ", "p"), ("a", 0, "user", "first", "p"), ("a", 1, "assistant", "logged", "p"), ("a", 3, "user", "  ", "p"), ("a", 4, "system", "own", "p"),
    ("b", 0, "user", "x", "p"), ("b", 1, "user", "fail", "p"), ("b", 2, "user", "y", "p"), ("b", 0, "user", "x", "p"), ("b", 0, "user", "z", "p"),
    ("c", 0, "user", "x", None), ("d", 0, "system", "alone", "p"), (None, 0, "user", "x", "p"), ("e", None, "user", "x", "p"), ("e", 0, "user", None, "p"), ("f", 0, "user", "long " * 20_000, "p"),
]
CHAT_SCHEMA = "conv_id string, turn long, role string, text string, model string"


def test_replies_become_part_of_the_next_turn(spark):
    df = spark.createDataFrame(CHATS, CHAT_SCHEMA).withColumn("reply", F.lit("clash"))
    got = {(r["conv_id"], r["turn"]): (r["n_messages"], r["reply"], r["status"]) for r in conversations.chat_replies(df, {"p": Parrot}, system="hi").collect()}
    assert got == {
        ("a", 0): (2, "s/u first", None), ("a", 2): (4, "s/u/a/u second", None),
        ("b", 0): (2, "s/u x", None), ("b", 1): (4, None, 502), ("b", 2): (0, None, 424),
        ("c", 0): (2, None, 502), ("f", 0): (2, "s/u " + ("long " * 20_000).strip(), None),
    }
    assert conversations.chat_replies(df.limit(0), {"p": Parrot}).collect() == []


def test_stream_of_turns_forgets_what_rests(spark, tmp_path):
    schema = f"{CHAT_SCHEMA}, ts timestamp"
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    batches = [
        [("a", 0, "user", "one", "p", at(0)), ("b", 0, "user", "fail", "p", at(0)), ("a", 1, "user", "two", "p", at(0)), ("n", 0, "user", "x", "p", None)],
        [("a", 1, "user", "two", "p", at(1)), ("a", 2, "user", "three", "p", at(1)), ("b", 1, "user", "x", "p", at(1))],
        [("c", 0, "user", "x", "p", at(200))],
        [("a", 3, "user", "four", "p", at(201))],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = conversations.chat_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), {"p": Parrot}, time="ts", rest_ms=3_600_000)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["conv_id"], r["turn"], r["n_messages"], r["reply"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [
        ("a", 0, 1, "u one", None), ("a", 1, 3, "u/a/u two", None), ("a", 2, 5, "u/a/u/a/u three", None), ("a", 3, 1, "u four", None),
        ("b", 0, 1, None, 502), ("b", 1, 0, None, 424), ("c", 0, 1, "u x", None),
    ]


def test_bootstrap_matches_a_plain_program(spark):
    draw = random.Random(3)
    rows = [(i, m, c, draw.randrange(5) + (m == "bad"), draw.randrange(3, 9)) for i in range(60) for c in ("x", None) for m in ("good", "bad", None)]
    rows += [(1, "alone", "y", 2, 4), (2, "wordless", "z", 1, 0)]
    schema = "recording_id long, model string, condition string, edits long, ref_words long"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit(9) for c in ("replicate", "lead", "_by")})
    limits = [math.floor(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) + 0.5) for k in range(8)]
    weight = lambda i, r: sum(int(hashlib.md5(f"1:{i}:{r // 8}".encode()).hexdigest()[r % 8 * 4 :][:4], 16) >= n for n in limits)
    rates, whole = {}, {}
    for r in range(200):
        sums = {}
        for i, m, c, e, n in rows:
            s = sums.setdefault((m, c), [0, 0])
            s[0], s[1] = s[0] + e * weight(i, r), s[1] + n * weight(i, r)
        for k, (e, n) in sums.items():
            if n:
                rates.setdefault(k, {})[r] = e / n
    for i, m, c, e, n in rows:
        s = whole.setdefault((m, c), [0, 0])
        s[0], s[1] = s[0] + e, s[1] + n
    found = {(r["model"], r["condition"]): r for r in quality.rank_with_confidence(df).collect()}
    assert set(found) == set(whole)
    for (m, c), r in found.items():
        assert (r["edits"], r["ref_words"]) == tuple(whole[m, c])
        ends = sorted(rates.get((m, c), {}).values())
        cut = int(len(ends) * 0.025 + 1e-9)
        assert (r["low"], r["high"]) == ((ends[cut], ends[-1 - cut]) if ends else (None, None))
        others = [rates[k] for k in rates if k[1] == c and k[0] != m]
        own = rates.get((m, c))
        lead = sum(all(own[x] < o[x] for o in others if x in o) for x in own) / len(own) if own and r["rank"] == 1 else None
        assert r["lead"] == pytest.approx(lead) if lead is not None else r["lead"] is None
        assert r["is_default"] == (lead is not None and lead >= 0.95)
    assert found["alone", "y"]["is_default"] and not found["wordless", "z"]["is_default"]
    assert quality.rank_with_confidence(df.limit(0)).collect() == []


def plain_loose_runs(said, heard, phrase):
    size, free = min(phrase, len(said)), [True] * len(said)
    for i in range(len(said) - size + 1):
        if any(said[i : i + size] == ws[j : j + size] for ws in heard for j in range(len(ws) - size + 1)):
            free[i : i + size] = [False] * size
    runs = []
    for i, x in enumerate(free):
        if x and i and free[i - 1]:
            runs[-1] = (runs[-1][0], i + 1)
        elif x:
            runs.append((i, i + 1))
    return runs


def test_unsupported_runs_equal_a_plain_search():
    rnd = random.Random(5)
    for _ in range(600):
        letters = "abcdefgh"[: rnd.randint(1, 8)]
        said, *heard = ([rnd.choice(letters) for _ in range(rnd.randint(0, 14))] for _ in range(rnd.randint(1, 4)))
        for phrase in (1, 2, 3, 5):
            assert quality.loose_runs(said, heard, phrase) == plain_loose_runs(said, heard, phrase)
    long = [f"w{i % 9973}" for i in range(200_000)]
    assert quality.loose_runs([*long[:1000], "new", "words", *long[1000:]], [long]) == [(1000, 1002)]


def test_unsupported_runs_of_odd_rows(spark):
    rows = [(1, "m", "The pain is is gone", "the pain is gone", None), (2, "m", None, "a b", ""), (3, None, "x y", None, None), (4, "n", "", "a", "b")]
    found = quality.unsupported_runs(spark.createDataFrame(rows, "recording_id long, model string, final_text string, transcript_1 string, transcript_2 string"), sources=("transcript_1", "transcript_2"))
    told = {r["recording_id"]: ([(x["start"], list(x["words"])) for x in r["runs"]], r["n_output"], r["n_unsupported"]) for r in found.collect()}
    assert told == {1: ([(3, ["is", "gone"])], 5, 2), 2: ([], 0, 0), 3: ([(0, ["x", "y"])], 2, 2), 4: ([], 0, 0)}
    by = {r["model"]: tuple(r)[1:] for r in quality.unsupported_by_model(found).collect()}
    assert by == {"m": (5, 2, 1, 2, 0.4), None: (2, 2, 1, 2, 1.0), "n": (0, 0, 0, 0, None)}
    assert quality.unsupported_by_model(found.limit(0)).collect() == []


def test_batch_files_are_bounded_and_whole(spark, tmp_path):
    bodies = [json.dumps({"n": "é" * (i % 40)}, ensure_ascii=False) for i in range(300)] + [json.dumps({"n": "x" * 5000})]
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string").repartition(5)
    batches.write_batches(df.select(batches.batch_line(F.col("request_id"), F.col("body")).alias("line")), str(tmp_path / "out"), 1000)
    files = [p for p in tmp_path.glob("out/file_no=*/part-*")]
    sizes = sorted(p.stat().st_size for p in files)
    assert len({p.parent for p in files}) == len(files) > 20 and sizes[-2] <= 1000 < sizes[-1]
    told = [json.loads(x) for p in files for x in p.read_text().splitlines()]
    assert sorted((int(x["custom_id"]), x["body"]) for x in told) == [(i, json.loads(b)) for i, b in enumerate(bodies)]
    batches.write_batches(df.limit(0).select(F.col("body").alias("line")), str(tmp_path / "none"))
    assert not list(tmp_path.glob("none/file_no=*"))


def test_answers_are_matched_by_id(spark):
    answer = lambda key, code=200, text="yes": json.dumps({"custom_id": key, "response": {"status_code": code, "body": {"choices": [{"message": {"content": text}}]}}})
    lines = [answer("a"), answer("b"), answer("b", text="no"), answer("c", 429), answer("d", text=None), answer("zz"), "not json", "{}", None, '{"custom_id": "e"}', answer("same")]
    asked = spark.createDataFrame([(k, 1) for k in ("a", "b", "c", "d", "e", "f", "same", "same", None)], "request_id string, status int")
    found = batches.match_answers(asked, spark.createDataFrame([(x,) for x in lines], "value string"))
    assert found.columns == ["request_id", "reply", "status", "error"]
    rows = sorted([tuple(r) for r in found.collect()], key=str)
    assert rows == sorted([
        ("a", "yes", None, None), ("b", None, 502, "2 answers"), ("c", None, 502, "answer has status 429"), ("d", None, 502, "answer has no text"), ("e", None, 502, "answer has status none"),
        ("f", None, 502, "no answer"), ("same", "yes", None, None), ("same", "yes", None, None), (None, None, 502, "no answer"),
    ], key=str)


def test_short_parts_of_a_network_take_no_array_calls(monkeypatch):
    monkeypatch.setattr(network, "_rows", lambda *_: pytest.fail("a path by array calls"))
    rng = random.Random(3)
    text = [f"w{rng.randrange(3000)}" for _ in range(5000)]
    lost, got = [w for i, w in enumerate(text) if i % 20], [x for i, w in enumerate(text) for x in ([w, "zqx"] if i % 25 == 7 else [w])]
    assert network.majority(network.network([lost, got, text])) == text


def test_the_last_row_of_a_slot_counts(spark):
    rows = [(1, 1, "a b c"), (1, 2, "a c"), (1, 2, "a x c")]
    df = spark.createDataFrame(rows, "recording_id int, slot_no int, text string")
    found = quality.discrepancy_spans(df).first()["spans"]
    assert [(s["start"], s["variants"]) for s in found] == [(1, {1: ["b"], 2: ["x"]})]


def test_words_that_are_only_lost_or_added_are_counted_without_an_alignment(monkeypatch):
    monkeypatch.setattr(quality, "_reaches", lambda *_: pytest.fail("an alignment"))
    text = [f"w{i % 700}" for i in range(20000)]
    lost = [w for i, w in enumerate(text) if i % 9]
    assert quality.count_edits(text, lost) == (0, 0, len(text) - len(lost))
    assert quality.count_edits(lost, text) == (0, len(text) - len(lost), 0)
    assert quality.count_edits([], ["a"]) == (0, 1, 0) and quality.count_edits(["a", "a"], []) == (0, 0, 2)


def test_resampled_corpora_are_summed_before_they_are_shuffled(spark):
    rows = [(k, m, c, e, n) for k, m, c, e, n in zip(["a", "b", None, "é"] * 50, ["x", None] * 100, ["p"] * 200, [1, None, 3, 4] * 50, range(200), strict=True)]
    df = spark.createDataFrame(rows, "recording_id string, model string, condition string, edits long, ref_words long").coalesce(1)
    found = quality.resampled(df, replicates=11, seed=7)
    wanted = {}
    for k, m, c, e, n in rows:
        told = [hashlib.md5(f"7:{k or ''}:{i}".encode()).hexdigest() for i in range(2)]
        for r in range(11):
            draw = int(told[r // 8][r % 8 * 4 : r % 8 * 4 + 4], 16)
            if w := sum(draw >= x for x in quality.poisson_limits()):
                own = wanted.setdefault((m, c, r), [None, 0])
                own[0] = own[0] if e is None else (own[0] or 0) + e * w
                own[1] += n * w
    assert {(r["model"], r["condition"], r["replicate"]): [r["edits"], r["ref_words"]] for r in found.collect()} == wanted
    assert "posexplode" not in found._jdf.queryExecution().toString()


def test_runs_are_found_without_arrays_of_words(spark):
    rows = [(1, "New Words here  the old text", "the old text"), (2, None, None), (3, "\x0b", "a"), (4, "a b", None)]
    found = quality.unsupported_runs(spark.createDataFrame(rows, "recording_id int, final_text string, transcript_1 string"), sources=("transcript_1",))
    got = {r["recording_id"]: ([(x["start"], x["words"]) for x in r["runs"]], r["n_output"], r["n_unsupported"]) for r in found.collect()}
    assert got == {1: ([(0, ["new", "words", "here"])], 6, 3), 2: ([], 0, 0), 3: ([], 0, 0), 4: ([(0, ["a", "b"])], 2, 2)}
    # texts go to Python, and what a worker holds as words is one row's
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()


class CountedState:
    """State of one key in memory, with the number of calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "updateValue": lambda k, v: self.map.update({k: v}),
            "containsKey": lambda k: k in self.map, "keys": lambda: iter(self.map), "iterator": lambda: iter(self.map.items()), "clear": lambda: self.map.clear(),
        }[name]


def test_state_is_called_for_batches_and_not_for_chunks():
    made = []
    handle = type("Handle", (), {"getMapState": lambda *_: made.append(CountedState()) or made[-1], "getValueState": lambda *_: made.append(CountedState()) or made[-1], "registerTimer": lambda *_: None, "deleteTimer": lambda *_: None})()
    now = type("Now", (), {"getCurrentWatermarkInMs": lambda _: 0})()
    batch = lambda seqs, end: chunks.pd.DataFrame({"seq": seqs, "bytes": [b"%d," % s for s in seqs], "ms": 1, "is_last": [s == end for s in seqs]})
    own = chunks.Assembler()
    own.init(handle)
    assert list(own.handleInputRows(("a",), iter([batch([*range(1, 400, 2), 5], 400)]), now)) == []
    assert list(own.handleInputRows(("a",), iter([batch([*range(2, 401, 2), 3], 400)]), now)) == []
    (found,) = own.handleInputRows(("a",), iter([batch([0, 0, 7], 400)]), now)
    assert found["n_chunks"][0] == 401 and found["content"][0][44:] == b"".join(b"%d," % s for s in range(401))
    assert sum(m.calls for m in made) < 20
    assert list(own.handleInputRows(("a",), iter([batch([0, 8, 400], 400)]), now)) == []


def test_turns_that_were_asked_need_no_history_from_the_state():
    from speechreport.operators import conversations

    said, mark = [], CountedState()
    reads = []
    listed = type("Listed", (), {"get": lambda _: reads.append(1) or iter(said), "appendList": lambda _, xs: said.extend(xs)})()
    own = conversations.Dialogue(inference.marked(standins.CHAT), "Be brief.", None)
    own.init(type("Handle", (), {"getListState": lambda *_: listed, "getValueState": lambda *_: mark})())
    batch = lambda turns: chunks.pd.DataFrame({"turn": turns, "text": [f"t{t}" for t in turns], "role": "user", "model": "recounter", "ms": 0})
    (first,) = own.handleInputRows((1,), iter([batch([1]), batch([0, 1])]), None)
    assert first["turn"].tolist() == [0, 1] and first["n_messages"].tolist() == [2, 4]
    assert list(own.handleInputRows((1,), iter([batch([1, 0])]), None)) == [] and not reads
    (second,) = own.handleInputRows((1,), iter([batch([2, 1])]), None)
    assert second["n_messages"].tolist() == [6] and reads == [1]


def test_documents_are_read_in_a_task_for_each_folder(spark, tmp_path):
    rows = spark.range(300).selectExpr("concat('n', id, '.txt') as name", "concat('text ', id) as text", "id as recording_id").coalesce(2)
    documents.write_documents(rows, str(tmp_path / "out"))
    folders = len(list((tmp_path / "out").glob("part-*")))
    found = documents.read_documents(spark, str(tmp_path / "out"))
    # files are neither listed by the driver nor dealt by a minimum size of each
    assert found.rdd.getNumPartitions() == folders and not found.inputFiles()
    assert {(r["name"], r["text"]) for r in found.collect()} == {(f"n{i}.txt", f"text {i}") for i in range(300)}
    (tmp_path / "none").mkdir()
    assert documents.read_documents(spark, str(tmp_path / "none")).count() == 0
