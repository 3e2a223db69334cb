"""Named queries over the given tables and their DuckDB counterparts.

There is no audio among the tables, so texts stand for it: slot 1 of a document is its text, slots 2
and 3 are edits of it by fixed rules, and slot 3 is missing where doc_id is a multiple of 5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechreport.functions import columns as C
from speechreport.operators import batches, conversations, inference, prompts, quality, replies, slots, validate
from speechreport.plans import standins
from speechreport.plans.pipelines import run_pipelines
from speechreport.sources import documents, recordings, schemas, scratch
from speechreport.streaming.chunks import assemble_batch, assemble_chunks, to_wav
from speechreport.streaming.intake import run_request_stream, run_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(*values: str | None) -> Column:
    """One of the values by doc_id."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("doc_id") % len(values)).cast("int"))


MODELS = ("openai:whisper-1", "gemini:flash", "seamless", "whisper-large", "openai:", None, "")
MODEL_SQL = "['openai:whisper-1','gemini:flash','seamless','whisper-large','openai:',NULL,''][doc_id % 7 + 1]"
SLOTS_SQL = """slots AS (
  SELECT doc_id AS recording_id, 1 AS slot_no, text FROM documents
  UNION ALL SELECT doc_id, 2, replace(text, ' the ', ' zqx ') FROM documents
  UNION ALL SELECT doc_id, 3, replace(text, ' of ', ' qzf ') FROM documents WHERE doc_id % 5 <> 0)"""


def slot_texts() -> list[Column]:
    text = F.col("text")
    return [text, F.replace(text, F.lit(" the "), F.lit(" zqx ")), F.when(F.col("doc_id") % 5 != 0, F.replace(text, F.lit(" of "), F.lit(" qzf ")))]


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, slot_no, model, text) of every document's slots."""
    one, two, three = slot_texts()
    said = F.array(*[F.struct(F.lit(n).alias("slot_no"), F.lit(m).alias("model"), t.alias("text")) for n, m, t in ((1, "seamless", one), (2, "whisper", two), (3, "mms-all", three))])
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording_id"), F.inline(F.filter(said, lambda s: s["text"].isNotNull())))
    return rows


@query(f"""
SELECT doc_id, CASE WHEN m LIKE 'openai:%' THEN 'openai' WHEN m LIKE 'gemini:%' THEN 'gemini' ELSE 'local' END AS provider,
  CASE WHEN m LIKE 'openai:%' THEN 'openai' ELSE 'local' END AS text_route,
  CASE WHEN m LIKE 'openai:%' OR m LIKE 'gemini:%' THEN substr(m, 8) ELSE m END AS bare_model,
  CASE WHEN doc_id % 2 = 0 AND NOT coalesce(m LIKE 'gemini:%', false) THEN 'openai:' || m ELSE m END AS qualified,
  coalesce(m IN ('seamless'), false) AS registered
FROM (SELECT doc_id, {MODEL_SQL} AS m FROM documents)""")
def provider_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = validate.routed(table(spark, sf_dir, "documents").select("doc_id", pick(*MODELS).alias("llm_model")))
    cloud = F.col("doc_id") % 2 == 0
    asis = F.coalesce(F.col("llm_model").startswith(C.GEMINI_PREFIX), F.lit(False))
    df = df.withColumn("qualified", C.qualify_model(F.col("llm_model"), cloud & ~asis, "llm"))
    known, unknown = slots.attach_model(df, schemas.stt_registry(spark), "llm_model")
    both = known.withColumn("registered", F.lit(True)).unionByName(unknown.withColumn("registered", F.lit(False)), allowMissingColumns=True)
    return both.select("doc_id", "provider", "text_route", "bare_model", "qualified", "registered")


@query("""
SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'en' END, ''), nullif(lang, ''), 'fa') AS language,
  coalesce(nullif(CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN source END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN lang END, ''), '') AS headline
FROM documents""")
def override_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    run = F.when(n % 3 == 0, "").when(n % 3 == 1, "en")
    final = F.when(n % 4 == 0, "").when(n % 4 == 1, F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", C.resolve(run, F.col("lang"), F.lit("fa")).alias("language"), C.headline(final, F.when(n % 2 == 0, F.col("lang"))).alias("headline"))


@query("""
WITH r AS (SELECT o_orderkey, ['separate','multimodal','hybrid','other',NULL][o_orderkey % 5 + 1] AS p,
    ['seamless','openai:x','gemini:x','whisper'][o_custkey % 4 + 1] AS llm, o_custkey % 6 AS n, o_orderkey % 7 = 0 AS none FROM orders),
v AS (SELECT *, CASE WHEN p IS NULL THEN 409 WHEN p = 'other' THEN 400 WHEN n > 3 THEN 400
    WHEN p IN ('multimodal','hybrid') AND llm IN ('seamless','whisper') THEN 503
    WHEN p = 'hybrid' AND (n = 0 OR none) THEN 400
    WHEN p = 'separate' AND (n = 0 OR none) THEN 400
    WHEN p = 'separate' AND llm <> 'openai:x' THEN 503 END AS status FROM r)
SELECT coalesce(p, 'none') AS pipeline, status, count(*) AS n_requests, sum(o_orderkey)::BIGINT AS key_sum FROM v GROUP BY 1, 2""")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    pipeline = F.get(F.array(*[F.lit(x).cast("string") for x in ("separate", "multimodal", "hybrid", "other", None)]), (F.col("o_orderkey") % 5).cast("int"))
    llm = F.get(F.array(*map(F.lit, ("seamless", "openai:x", "gemini:x", "whisper"))), (F.col("o_custkey") % 4).cast("int"))
    slot = F.struct(F.lit("seamless").alias("model"), *[F.lit(None).cast("string").alias(k) for k in ("api_key", "base_url", "language")])
    n = (F.col("o_custkey") % 6).cast("int")
    listed = F.transform(F.array_repeat(F.lit(1), n), lambda _: F.when(F.col("o_orderkey") % 7 != 0, slot))
    asked = orders.select("o_orderkey", pipeline.alias("pipeline"), llm.alias("llm_model"), listed.alias("stt_slots"))
    checked = validate.validate_requests(asked, stt_engines=["seamless"], llm_engines=[])
    return checked.groupBy(F.coalesce("pipeline", F.lit("none")).alias("pipeline"), "status").agg(F.count(F.lit(1)).alias("n_requests"), F.sum("o_orderkey").alias("key_sum"))


NAMES = ("take.wav", "TAKE.MP3", "take", "take.m4a", "a.b/take.tar.flac", ".wav", "x.Ogg")


@query("""
WITH f AS (SELECT doc_id, ['take.wav','TAKE.MP3','take','take.m4a','a.b/take.tar.flac','.wav','x.Ogg'][doc_id % 7 + 1] AS name,
    ['openai:x','gemini:x','gemma-4-e4b'][doc_id % 3 + 1] AS model FROM documents),
e AS (SELECT *, lower(regexp_extract(regexp_extract(name, '([^/]*)$', 1), '^.+\\.([^.]+)$', 1)) AS ext FROM f),
g AS (SELECT *, CASE WHEN (model LIKE 'openai:%' AND ext IN ('wav','mp3')) OR (model NOT LIKE 'openai:%' AND ext IN ('wav','mp3','aac','ogg','flac','aiff')) THEN ext END AS audio_format FROM e)
SELECT doc_id, audio_format, 'audio/' || audio_format AS mime_type, CASE WHEN audio_format IS NULL THEN 400 END AS status FROM g""")
def audio_format_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", pick(*NAMES).alias("file_name"), pick("openai:x", "gemini:x", "gemma-4-e4b").alias("llm_model"))
    checked = validate.check_audio_format(df)
    return checked.select("doc_id", "audio_format", C.mime_type(F.col("audio_format")).alias("mime_type"), "status")


@query("""
SELECT doc_id, lang AS language, CASE WHEN lang NOT IN ('fa', 'en') THEN 400 END AS status,
  CASE WHEN lang = 'en' THEN 'english' ELSE lang END AS whisper_code, CASE WHEN lang = 'en' THEN 'eng' ELSE lang END AS seamless_code
FROM documents""")
def language_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = validate.check_language(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language")))
    code = lambda family: C.family_language(F.lit(family), F.col("language"))
    return df.select("doc_id", "language", "status", code("whisper").alias("whisper_code"), code("seamless_v2").alias("seamless_code"))


@query("""
SELECT c_custkey, 1 AS slot_no, c_name AS model, c_mktsegment AS base_url, NULL::VARCHAR AS api_key FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 2, 'whisper', NULL, NULL FROM customer""")
def redacted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = lambda model, key, url: F.struct(model.alias("model"), key.alias("api_key"), url.alias("base_url"), F.lit(None).cast("string").alias("language"))
    first = F.when(F.col("c_custkey") % 3 != 0, slot(F.col("c_name"), F.col("c_name"), F.col("c_mktsegment")))
    second = slot(F.lit("whisper"), F.lit("secret"), F.lit(None).cast("string"))
    df = table(spark, sf_dir, "customer").select("c_custkey", F.array(first, second).alias("stt_slots"))
    cleared = df.withColumn("stt_slots", C.redact_slots(F.col("stt_slots")))
    out = cleared.select("c_custkey", F.posexplode("stt_slots").alias("at", "slot")).filter("slot is not null")
    keys = [f.name for f in out.schema["slot"].dataType.fields]
    return out.select("c_custkey", (F.col("at") + 1).alias("slot_no"), "slot.model", "slot.base_url", (F.col("slot.api_key") if "api_key" in keys else F.lit(None).cast("string")).alias("api_key"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'گزارش ' || source ELSE text END, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, sum(regexp_matches(line, '[\\x{0590}-\\x{08FF}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]')::INT)::BIGINT AS n_rtl, sum(length(line))::BIGINT AS n_chars FROM l GROUP BY 1""")
def rtl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit("\nگزارش "), F.col("source"))).otherwise(F.col("text"))
    lines = recordings.report_lines(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("rtl").cast("long")).alias("n_rtl"), F.sum(F.length("line").cast("long")).alias("n_chars"))


@query("""
WITH n AS (SELECT *, coalesce(nullif(source, ''), 'report') || '_gemini-x' AS stem, row_number() OVER (PARTITION BY coalesce(nullif(source, ''), 'report') ORDER BY doc_id) AS k FROM documents),
l AS (SELECT stem || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.txt' AS name, unnest(string_split(CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'گزارش ' || source ELSE text END, chr(10))) AS line FROM n)
SELECT name, count(*) AS n_lines, sum(regexp_matches(line, '[\\x{0590}-\\x{08FF}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]')::INT)::BIGINT AS n_rtl, sum(length(line))::BIGINT AS n_chars FROM l GROUP BY 1""")
def written_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under names that many of them share, written as files and read back line by line."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit("\nگزارش "), F.col("source"))).otherwise(F.col("text"))
    named = table(spark, sf_dir, "documents").select("doc_id", C.output_name(F.col("source"), [F.lit("gemini:x")], ".txt").alias("name"), text.alias("text"))
    out = scratch.scratch_dir(spark)
    documents.write_documents(named, out, key="doc_id")
    lines = recordings.report_lines(documents.read_documents(spark, out))
    return lines.groupBy("name").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("rtl").cast("long")).alias("n_rtl"), F.sum(F.length("line").cast("long")).alias("n_chars"))


@query("""
WITH u AS (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS last FROM pages),
s AS (SELECT page_id, CASE WHEN regexp_matches(last, '^\\.*[^.].*\\.[^.]*$') THEN regexp_replace(last, '\\.[^.]*$', '') ELSE last END AS stem,
  trim(regexp_replace(CASE WHEN url LIKE 'openai:%' THEN substr(url, 8) ELSE url END, '[\\\\/:*?"<>|]', '-', 'g'), '-_') AS part FROM u)
SELECT page_id, list_aggregate(list_filter([stem, part, 'gemini-x', 'whisper'], lambda x: x <> ''), 'string_agg', '_') || '.docx' AS name FROM s""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = [F.col("url"), F.lit("gemini:x"), F.lit(None).cast("string"), F.lit("openai:whisper")]
    return table(spark, sf_dir, "pages").select("page_id", C.output_name(F.col("url"), models).alias("name"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A separate request for every document: three slots, the third null where doc_id is a multiple of 5."""
    slot = lambda model, lang: F.struct(F.lit(model).alias("model"), F.lit(None).cast("string").alias("api_key"), F.lit(None).cast("string").alias("base_url"), F.lit(lang).cast("string").alias("language"))
    three = F.array(slot("seamless", None), slot("whisper", "en"), F.when(F.col("doc_id") % 5 != 0, slot("mms-all", "")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording_id"), F.lit("separate").alias("pipeline"), F.lit("aya-expanse-8b").alias("llm_model"), F.col("lang").alias("language"), three.alias("stt_slots"), F.lit("audio.wav").alias("file_name"))


@query("""
SELECT doc_id AS recording_id, 1 AS slot_no, 'seamless' AS model, nullif(lang, '') AS language FROM documents
UNION ALL SELECT doc_id, 2, 'whisper', 'en' FROM documents
UNION ALL SELECT doc_id, 3, 'mms-all', nullif(lang, '') FROM documents WHERE doc_id % 5 <> 0""")
def slot_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.fan_out_slots(requests(spark, sf_dir)).select("recording_id", "slot_no", "model", "language")


@query(f"""
WITH {SLOTS_SQL}
SELECT recording_id, max(text) FILTER (slot_no = 1) AS transcript_1, max(text) FILTER (slot_no = 2) AS transcript_2, max(text) FILTER (slot_no = 3) AS transcript_3,
  string_agg('transcript_' || slot_no, ',' ORDER BY slot_no) AS keys FROM slots GROUP BY 1""")
def assembled_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = slots.assemble_transcripts(transcripts(spark, sf_dir))
    return found.select("recording_id", "transcript_1", "transcript_2", "transcript_3", F.array_join(F.map_keys("transcripts"), ",").alias("keys"))


@query(f"""
WITH {SLOTS_SQL}
SELECT recording_id, string_agg('STT engine ' || slot_no || ' transcript:' || chr(10) || text, chr(10) || chr(10) ORDER BY slot_no) AS user_text,
  string_agg('Reference transcript ' || slot_no || ' (from a separate STT engine — may contain errors):' || chr(10) || text, chr(10) || chr(10) ORDER BY slot_no) AS reference_text
FROM slots GROUP BY 1""")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prompts.build_messages(slots.assemble_transcripts(transcripts(spark, sf_dir)))
    return found.select("recording_id", F.get("messages", F.lit(1))["content"].alias("user_text"), prompts.reference_sections(F.col("transcripts")).alias("reference_text"))


@query("""
WITH d AS (SELECT doc_id, source, ['openai:x','gemini:y','gemma-4-e4b'][doc_id % 3 + 1] AS m, to_base64(encode(text)) AS b FROM documents),
n AS (SELECT *, CASE WHEN m LIKE 'openai:%' OR m LIKE 'gemini:%' THEN substr(m, 8) ELSE m END AS model FROM d)
SELECT doc_id, shape, CASE WHEN shape = 'inline' THEN NULL ELSE model END AS model, 'Listen.' AS system,
  CASE shape WHEN 'chat' THEN source WHEN 'audio_chat' THEN source ELSE 'Listen.' || chr(10) || chr(10) || source END AS user_text,
  CASE WHEN shape <> 'chat' THEN md5(b) END AS sound, CASE shape WHEN 'audio_chat' THEN 'wav' WHEN 'inline' THEN 'audio/wav' END AS format,
  CASE WHEN shape = 'inline' THEN 'application/json' ELSE 'json_object' END AS kind
FROM n, (VALUES ('chat'), ('audio_chat'), ('inline')) s(shape)""")
def rendered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the request bodies that are rendered for every document."""
    df = table(spark, sf_dir, "documents")
    sound, system, user = F.col("text").cast("binary"), F.lit("Listen."), F.col("source")
    shapes = F.array(*[F.struct(F.lit(s).alias("shape"), prompts.render_request(s, pick("openai:x", "gemini:y", "gemma-4-e4b"), system, user, sound, F.lit("wav")).alias("body")) for s in ("chat", "audio_chat", "inline")])
    got = lambda *paths: F.coalesce(*[F.get_json_object("body", p) for p in paths])
    part, inline = "$.messages[1].content", "$.contents[0].parts"
    said = F.when(F.col("shape") == "chat", got(part)).otherwise(got(f"{part}[1].text", f"{inline}[0].text"))
    return df.select("doc_id", F.inline(shapes)).select(
        "doc_id", "shape", got("$.model").alias("model"), got("$.messages[0].content", "$.system_instruction.parts[0].text").alias("system"), said.alias("user_text"),
        F.md5(got(f"{part}[0].input_audio.data", f"{inline}[1].inline_data.data")).alias("sound"), got(f"{part}[0].input_audio.format", f"{inline}[1].inline_data.mime_type").alias("format"),
        got("$.response_format.type", "$.generationConfig.response_mime_type").alias("kind"),
    )


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 3 AS found, 0 AS missing FROM events""")
def response_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.col("props")
    bodies = {
        "local": F.to_json(F.struct(said.alias("reply"))),
        "chat": F.to_json(F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices"))),
        "inline": F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(said.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))),
    }
    texts = F.array(*[replies.reply_text(b, s) for s, b in bodies.items()])
    wrong = F.array(replies.reply_text(bodies["chat"], "inline"), replies.reply_text(bodies["local"], "transcription"))
    number = F.get_json_object(F.get(texts, F.lit(2)), "$.k").cast("long")
    count = lambda xs: F.size(F.filter(xs, lambda x: x.isNotNull()))
    return table(spark, sf_dir, "events").select("event_id", number.alias("k"), F.size(F.filter(texts, lambda x: x == said)).alias("found"), count(wrong).alias("missing"))


@query("""
WITH r AS (SELECT event_id, event_id % 6 AS c, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE WHEN c IN (2, 3, 5) THEN 502 END AS status, CASE WHEN c NOT IN (2, 3, 5) THEN k END AS notes,
  CASE WHEN c IN (2, 3, 5) THEN NULL WHEN c = 4 THEN 'notes,final_text' ELSE 'notes' END AS keys FROM r""")
def reply_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    good = F.concat(F.lit('{"notes": "'), k, F.lit('"}'))
    case = (F.col("event_id") % 6).cast("int")
    reply = (
        F.when(case == 0, good).when(case == 1, F.concat(F.lit("Sure.\n```json\n"), good, F.lit("\n```\nDone {.")))
        .when(case == 2, F.concat(good, F.lit(" and "), good)).when(case == 3, F.concat(F.lit("{'notes': "), k, F.lit("}")))
        .when(case == 4, F.concat(F.lit('so {"notes": "x", "notes": "'), k, F.lit('", "final_text": NaN} ok'))).otherwise(F.lit("no braces"))
    )
    found = replies.extract_json(table(spark, sf_dir, "events").select("event_id", reply.alias("reply")))
    return found.select("event_id", "status", F.col("report.notes").alias("notes"), F.array_join("present_keys", ",").alias("keys"))


@query(f"""
WITH {SLOTS_SQL}, t AS (SELECT recording_id, max(text) FILTER (slot_no = 1) AS t1, max(text) FILTER (slot_no = 2) AS t2, max(text) FILTER (slot_no = 3) AS t3 FROM slots GROUP BY 1)
SELECT recording_id, CASE WHEN recording_id % 4 = 0 THEN 'replaced' ELSE t1 END AS transcript_1, t2 AS transcript_2, t3 AS transcript_3,
  'ok ' || recording_id AS final_text, NULL::VARCHAR AS notes FROM t""")
def merged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = slots.attach_references(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording_id")), slots.assemble_transcripts(transcripts(spark, sf_dir)))
    also = F.when(F.col("recording_id") % 4 == 0, ', "transcript_1": "replaced"').otherwise("")
    reply = F.concat(F.lit('{"final_text": "ok '), F.col("recording_id").cast("string"), F.lit('"'), also, F.lit("}"))
    parsed = replies.extract_json(found.select("recording_id", "transcript_1", "transcript_2", "transcript_3", reply.alias("reply")))
    return slots.merge_report(parsed).select("recording_id", "transcript_1", "transcript_2", "transcript_3", "final_text", "notes")


@query("""
SELECT conv_id, max(turn) FILTER (role = 'user') AS turn, arg_max(text, turn) FILTER (role = 'user') AS text FROM conversations GROUP BY 1""")
def last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.last_user_turn(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "text")


@query("""
WITH s AS (SELECT * FROM conversations WHERE length(trim(coalesce(text, ''))) > 0),
h AS (SELECT conv_id, turn, role, string_agg(role || ':' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY (role <> 'system')::INT, turn ROWS UNBOUNDED PRECEDING) AS history,
  bool_or(role = 'system') OVER (PARTITION BY conv_id) AS has FROM s)
SELECT conv_id, turn, CASE WHEN has THEN history ELSE 'system:Be brief.' || chr(10) || history END AS history FROM h WHERE role = 'user'""")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations.chat_history(table(spark, sf_dir, "conversations"), "Be brief.")
    said = F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return found.select("conv_id", "turn", F.array_join(said, "\n").alias("history"))


#: Conversations are asked turn by turn; those of a model without an engine fail at their first turn.
CHAT_MODELS = ("recounter", "other", "nope")
REPLIES_SQL = """
WITH RECURSIVE u AS (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations
  WHERE role = 'user' AND length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) > 0),
s AS (SELECT conv_id, count(*) AS n, sum(length(trim(text, ' ' || chr(9) || chr(10) || chr(13)))) AS c FROM conversations
  WHERE role = 'system' AND length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) > 0 GROUP BY 1),
b AS (SELECT DISTINCT conv_id, coalesce(n, 1) AS n, coalesce(c, 9) AS c FROM u LEFT JOIN s USING (conv_id)),
r AS (SELECT conv_id, 0::BIGINT AS k, 0::BIGINT AS turn, n::BIGINT AS n, c::BIGINT AS c, '' AS reply FROM b
  UNION ALL SELECT u.conv_id, u.k, u.turn, r.n + 1 + (r.k > 0)::BIGINT, r.c + length(r.reply) + length(u.said),
    (r.n + 1 + (r.k > 0)::BIGINT) || ' messages, ' || (r.c + length(r.reply) + length(u.said)) || ' letters: ' || left(u.said, 20) FROM r JOIN u ON u.conv_id = r.conv_id AND u.k = r.k + 1)
SELECT conv_id, turn, CASE WHEN conv_id % 3 < 2 THEN n WHEN k = 1 THEN n ELSE 0 END::INT AS n_messages, CASE WHEN conv_id % 3 < 2 THEN reply END AS reply,
  CASE WHEN conv_id % 3 = 2 THEN CASE WHEN k = 1 THEN 502 ELSE 424 END END AS status FROM r WHERE k > 0"""


def modelled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.get(F.array(*[F.lit(m) for m in CHAT_MODELS]), F.pmod("conv_id", F.lit(3)).cast("int"))
    return table(spark, sf_dir, "conversations").withColumn("model", model)


@query(REPLIES_SQL)
def chat_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reply becomes part of what the next turn is asked with."""
    found = conversations.chat_replies(modelled_turns(spark, sf_dir), standins.CHAT, system="Be brief.")
    return found.select("conv_id", "turn", "n_messages", "reply", "status")


@query(REPLIES_SQL)
def chat_reply_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream whose turns come in two batches, some of them twice; what was said waits in keyed state."""
    turns = modelled_turns(spark, sf_dir)
    source, out, state = (scratch.scratch_dir(spark) for _ in range(3))
    for part in (turns.filter("turn < 3"), turns.filter("turn > 1")):
        part.write.mode("append").parquet(source)
        stream = conversations.chat_stream(spark.readStream.schema(turns.schema).parquet(source), standins.CHAT, system="Be brief.")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select("conv_id", "turn", "n_messages", "reply", "status")


@query("""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
l AS (SELECT conv_id, max(i) FILTER (role = 'user') AS last FROM m GROUP BY 1),
p AS (SELECT m.conv_id, i, role, text, i = last AS heard FROM m JOIN l USING (conv_id))
SELECT conv_id, i AS message_no, family, part_no, kind, CASE WHEN kind = 'audio' THEN NULL ELSE text END AS text FROM (
  SELECT conv_id, i, text, 'gemma' AS family, 0 AS part_no, CASE WHEN role = 'system' THEN 'plain' ELSE 'text' END AS kind FROM p
  UNION ALL SELECT conv_id, i, text, 'gemma', 1, 'audio' FROM p WHERE heard AND role <> 'system'
  UNION ALL SELECT conv_id, i, text, 'qwen', CASE WHEN heard THEN 1 ELSE 0 END, 'text' FROM p
  UNION ALL SELECT conv_id, i, text, 'qwen', 0, 'audio' FROM p WHERE heard)""")
def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    said = turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("m"))
    users = F.filter(F.transform("m", lambda x, i: F.when(x["role"] == "user", i)), lambda i: i.isNotNull())
    said = said.withColumn("last", F.array_max(users))
    rows = [said.select("conv_id", F.lit(f).alias("family"), F.posexplode(prompts.to_parts(F.col("m"), f, F.lit("take.wav"), F.col("last"))).alias("message_no", "p")) for f in ("gemma", "qwen")]
    parts = rows[0].unionByName(rows[1]).select("conv_id", F.col("message_no").cast("long").alias("message_no"), "family", F.posexplode("p.parts").alias("part_no", "part"))
    return parts.select("conv_id", "message_no", "family", "part_no", F.col("part.type").alias("kind"), "part.text")


@query("""
SELECT doc_id, m AS model, CASE WHEN doc_id % 3 = 0 THEN 0.0 WHEN doc_id % 3 = 1 THEN 0.3 ELSE 0.9 END > 0.01 AS do_sample FROM
  (SELECT doc_id, ['gemma-4-e4b','aya-expanse-8b','qwen3-omni-30b','nope'][doc_id % 4 + 1] AS m FROM documents) WHERE m IN ('gemma-4-e4b', 'gemma-4-12b', 'qwen3-omni-30b')""")
def audio_models_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", pick("gemma-4-e4b", "aya-expanse-8b", "qwen3-omni-30b", "nope").alias("model"), F.get(F.array(F.lit(0.0), F.lit(None).cast("double"), F.lit(0.9)), (F.col("doc_id") % 3).cast("int")).alias("t"))
    able = F.broadcast(slots.audio_models(schemas.llm_registry(spark)))
    return df.join(able, F.col("model") == F.col("key"), "left_semi").select("doc_id", "model", C.generation_params(F.col("t"))["do_sample"].alias("do_sample"))


@query(f"""
WITH {SLOTS_SQL}, e AS (SELECT CASE slot_no WHEN 1 THEN 'seamless' WHEN 2 THEN 'whisper' ELSE 'mms-all' END AS model, d.lang AS condition,
    len(regexp_extract_all(d.text, '[^ \\t\\n\\x0B\\f\\r]+')) AS words,
    CASE slot_no WHEN 1 THEN 0 WHEN 2 THEN (length(d.text) - length(replace(d.text, ' the ', ''))) // 5 ELSE (length(d.text) - length(replace(d.text, ' of ', ''))) // 4 END AS edits
  FROM slots JOIN documents d ON doc_id = recording_id),
w AS (SELECT model, condition, sum(edits)::BIGINT AS edits, sum(words)::BIGINT AS ref_words FROM e GROUP BY 1, 2)
SELECT *, edits / ref_words AS wer, row_number() OVER (PARTITION BY condition ORDER BY edits / ref_words, model)::INT AS rank FROM w""")
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording_id"), "text", F.col("lang").alias("condition"))
    paired = quality.pair_for_scoring(transcripts(spark, sf_dir), truth, keep=("condition",))
    ranked = quality.rank_models(quality.wer_by_model(quality.token_edits(paired)))
    return ranked.select("model", "condition", "edits", "ref_words", "wer", "rank")


@query("""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(replace(text, ' the ', ' zqx ') || ' ' || source), '[^ \\t\\n\\x0B\\f\\r]+')) AS own, regexp_extract_all(lower(text), '[^ \\t\\n\\x0B\\f\\r]+') AS known FROM documents),
u AS (SELECT doc_id, len(own) AS n_output, list_sort(list_filter(own, lambda x: NOT list_contains(known, x))) AS un FROM w)
SELECT doc_id, n_output, coalesce(array_to_string(un, ','), '') AS unsupported, len(un) / n_output AS share FROM u""")
def unsupported_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    said = F.concat_ws(" ", F.replace(F.col("text"), F.lit(" the "), F.lit(" zqx ")), F.col("source"))
    found = quality.unsupported_tokens(df.select("doc_id", said.alias("final_text"), F.col("text").alias("transcript_1")), sources=("transcript_1",))
    return found.select("doc_id", "n_output", F.array_join("unsupported", ",").alias("unsupported"), "share")


#: Outputs of models by doc_id: the text itself with changed words, with inserted words, and in another order.
SAID_SQL = """said AS (SELECT doc_id, ['plain','adds','turns'][doc_id % 3 + 1] AS model, replace(text, ' of ', ' ') AS heard_1, text AS heard_2,
  [replace(text, ' the ', ' zqx '), replace(text, ' and ', ' and qzf zqx '), replace(text, ' in the ', ' the in ')][doc_id % 3 + 1] || ' ' || source AS final FROM documents)"""


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, model, final_text, transcript_1, transcript_2)."""
    text, changed = F.col("text"), lambda old, new: F.replace(F.col("text"), F.lit(old), F.lit(new))
    said = F.get(F.array(changed(" the ", " zqx "), changed(" and ", " and qzf zqx "), changed(" in the ", " the in ")), (F.col("doc_id") % 3).cast("int"))
    model = pick("plain", "adds", "turns").alias("model")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording_id"), model, F.concat(said, F.lit(" "), "source").alias("final_text"), changed(" of ", " ").alias("transcript_1"), text.alias("transcript_2"))


@query(f"""
WITH {SAID_SQL}, w AS (SELECT doc_id, model, regexp_extract_all(lower(final), '[^ \\t\\n\\x0B\\f\\r]+') AS o, [regexp_extract_all(lower(heard_1), '[^ \\t\\n\\x0B\\f\\r]+'), regexp_extract_all(lower(heard_2), '[^ \\t\\n\\x0B\\f\\r]+')] AS hs FROM said),
k AS (SELECT doc_id, model, o, len(o) AS n, least(3, len(o)) AS p, hs FROM w),
h AS (SELECT doc_id, p, unnest(hs) AS ws FROM k),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + p - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - p + 2)) AS i FROM h)),
i AS (SELECT doc_id, model, n, p, i, o FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM k)),
s AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, p, i FROM (SELECT doc_id, p, i, array_to_string(o[i:i + p - 1], ' ') AS gram FROM i WHERE i + p - 1 <= n) JOIN g USING (doc_id, gram)), range(3) AS t(j) WHERE j < p),
u AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM i ANTI JOIN s USING (doc_id, i)),
r AS (SELECT doc_id, run, count(*) AS n FROM u GROUP BY 1, 2),
d AS (SELECT doc_id, sum(n) AS n, count(*) AS runs, max(n) AS longest FROM r GROUP BY 1)
SELECT model, sum(k.n)::BIGINT AS n_output, coalesce(sum(d.n), 0)::BIGINT AS n_unsupported, coalesce(sum(runs), 0)::BIGINT AS n_runs, coalesce(max(longest), 0)::BIGINT AS longest,
  coalesce(sum(d.n), 0) / sum(k.n) AS rate FROM k LEFT JOIN d USING (doc_id) GROUP BY 1""")
def unsupported_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stand in an order that no transcript has, by model."""
    return quality.unsupported_by_model(quality.unsupported_runs(outputs(spark, sf_dir), sources=("transcript_1", "transcript_2")))


@query("""
SELECT doc_id::VARCHAR AS request_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN source || ': ' || length(text) END AS reply,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 502 END AS status,
  CASE WHEN doc_id % 7 = 0 THEN 'no answer' WHEN doc_id % 11 = 0 THEN '2 answers' WHEN doc_id % 13 = 0 THEN 'answer has status 500' END AS error FROM documents""")
def batch_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a line of a batch file; of the answers to what the files hold some are lost (doc_id a multiple of 7), double (of 11) or failures (of 13)."""
    path = scratch.scratch_dir(spark)
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("request_id"), prompts.render_request("chat", F.lit("aya-expanse-8b"), F.col("source"), F.col("text"), json_reply=False).alias("body"))
    batches.write_batches(asked.select(batches.batch_line(F.col("request_id"), F.col("body")).alias("line")), path, 1 << 20)
    at = lambda p: F.get_json_object("value", p)
    number = F.col("custom_id").cast("long")
    said = F.concat(at("$.body.messages[0].content"), F.lit(": "), F.length(at("$.body.messages[1].content")).cast("string"))
    got = spark.read.text(path).select(at("$.custom_id").alias("custom_id"), said.alias("content"))
    body = F.struct(F.array(F.struct(F.struct("content").alias("message"))).alias("choices"))
    response = F.struct(F.when(number % 13 == 0, 500).otherwise(200).alias("status_code"), body.alias("body"))
    answers = got.filter(number % 7 != 0).select(F.to_json(F.struct("custom_id", response.alias("response"))).alias("value"), F.explode(F.sequence(F.lit(1), F.when(number % 11 == 0, 2).otherwise(1))).alias("copy"))
    return batches.match_answers(asked.select("request_id"), answers)


WORDS_SQL = f"""{SLOTS_SQL}, w AS (SELECT recording_id, slot_no, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM slots),
t AS (SELECT recording_id, slot_no, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS i FROM w)"""


@query(f"""
WITH {WORDS_SQL}
SELECT recording_id, 2 * i AS position, string_agg(slot_no || '=' || token, ',' ORDER BY slot_no) AS variants FROM t GROUP BY recording_id, i HAVING min(token) <> max(token)""")
def transcript_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.discrepancies(transcripts(spark, sf_dir))
    listed = F.transform(F.map_entries("variants"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return found.select("recording_id", "position", F.array_join(F.array_sort(listed), ",").alias("variants"))


@query(f"""
WITH {WORDS_SQL}, c AS (SELECT recording_id, i, token, count(*) AS n, min(slot_no) AS s FROM t GROUP BY 1, 2, 3),
b AS (SELECT recording_id, i, token, row_number() OVER (PARTITION BY recording_id, i ORDER BY n DESC, s) AS r FROM c)
SELECT recording_id, coalesce(v, '') AS voted_text FROM (SELECT DISTINCT recording_id FROM slots) LEFT JOIN (SELECT recording_id, string_agg(token, ' ' ORDER BY i) AS v FROM b WHERE r = 1 GROUP BY 1) USING (recording_id)""")
def voted_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.vote_transcript(transcripts(spark, sf_dir))


#: Slot 1 has lost words, slot 2 has got some, slot 3 has others in their place.
LOST, GOT, CHANGED = (" of ", " "), (" the ", " the zqx "), (" and ", " qzf ")
EDITED_SQL = f"""said AS (
  SELECT doc_id, [replace(text, '{LOST[0]}', '{LOST[1]}'), replace(text, '{GOT[0]}', '{GOT[1]}'), replace(text, '{CHANGED[0]}', '{CHANGED[1]}')] AS slots, text, doc_id % 5 <> 0 AS third FROM documents)"""
WORD_LIST = r"'[^ \t\n\x0B\f\r]+'"


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, slot_no, text, truth): transcripts with deletions, insertions and replaced words; the third is missing where doc_id is a multiple of 5."""
    told = F.array(*[F.struct(F.lit(n).alias("slot_no"), F.replace(F.col("text"), F.lit(old), F.lit(new)).alias("text")) for n, (old, new) in enumerate((LOST, GOT, CHANGED), 1)])
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording_id"), F.col("text").alias("truth"), F.inline(told))
    return rows.filter("slot_no < 3 or recording_id % 5 <> 0")


@query(f"""
WITH {EDITED_SQL}
SELECT doc_id AS recording_id, array_to_string(regexp_extract_all(CASE WHEN third THEN text ELSE slots[1] END, {WORD_LIST}), ' ') AS voted_text FROM said""")
def network_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With three slots the majority has every word of the text; with two the first one's words, or its lack of them, count."""
    return quality.vote_transcript(edited(spark, sf_dir))


@query(f"""
WITH d AS (SELECT doc_id, doc_id % 5 <> 0 AS third, regexp_extract_all(replace(replace(replace(text, ' of ', ' of\x01 '), ' the ', ' the zqx\x02 '), ' and ', ' and\x03 '), {WORD_LIST}) AS ws FROM documents),
t AS (SELECT doc_id, third, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT doc_id, third, i, rtrim(w, '\\x01\\x02\\x03') AS w, CASE right(w, 1) WHEN '\\x01' THEN 1 WHEN '\\x02' THEN 2 WHEN '\\x03' THEN CASE WHEN third THEN 3 ELSE 0 END ELSE 0 END AS edit FROM t),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS run FROM k),
o AS (SELECT doc_id, third, w, edit, min(i) OVER (PARTITION BY doc_id, w, run) + row_number() OVER (PARTITION BY doc_id, w, run ORDER BY (edit <> 1)::INT, i) AS i FROM r),
p AS (SELECT *, sum((edit NOT IN (1, 2))::INT) OVER w - (edit NOT IN (1, 2))::INT AS place, sum((edit = 0)::INT) OVER w AS island FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, third, island, min(place)::BIGINT AS start, string_agg(w, ' ' ORDER BY i) FILTER (edit = 3) AS one,
    string_agg(w, ' ' ORDER BY i) AS two, string_agg(CASE WHEN edit = 3 THEN 'qzf' ELSE w END, ' ' ORDER BY i) FILTER (edit <> 2) AS three FROM p WHERE edit > 0 GROUP BY 1, 2, 3)
SELECT doc_id AS recording_id, start, coalesce(one, '') AS slot_1, coalesce(two, '') AS slot_2, CASE WHEN third THEN coalesce(three, '') END AS slot_3 FROM s""".replace("\\x01", "\x01").replace("\\x02", "\x02").replace("\\x03", "\x03"))
def transcript_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal neighbours the first ones count as lost, since any of them might be."""
    found = quality.discrepancy_spans(edited(spark, sf_dir)).select("recording_id", F.explode("spans").alias("s"))
    said = [F.array_join(F.col("s.variants")[n], " ").alias(f"slot_{n}") for n in (1, 2, 3)]
    return found.select("recording_id", "s.start", *said)


@query(f"""
WITH {EDITED_SQL}, c AS (SELECT len(regexp_extract_all(text, {WORD_LIST})) AS n, third, (length(text) - length(slots[1])) // 3 AS lost, (length(slots[2]) - length(text)) // 4 AS got,
    (length(text) - length(replace(text, '{CHANGED[0]}', ''))) // 5 AS changed FROM said)
SELECT 1 AS slot_no, sum(n)::BIGINT AS ref_words, 0::BIGINT AS substitutions, 0::BIGINT AS insertions, sum(lost)::BIGINT AS deletions FROM c
UNION ALL SELECT 2, sum(n)::BIGINT, 0, sum(got)::BIGINT, 0 FROM c UNION ALL SELECT 3, sum(n)::BIGINT, sum(changed)::BIGINT, 0, 0 FROM c WHERE third""")
def edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.token_edits(edited(spark, sf_dir), ref="truth")
    return found.groupBy("slot_no").agg(*[F.sum(c).alias(c) for c in ("ref_words", "substitutions", "insertions", "deletions")])


@query(f"""
WITH {EDITED_SQL}, c AS (SELECT doc_id, len(regexp_extract_all(text, {WORD_LIST})) AS n, third, (length(text) - length(slots[1])) // 3 AS lost, (length(slots[2]) - length(text)) // 4 AS got,
    (length(text) - length(replace(text, '{CHANGED[0]}', ''))) // 5 AS changed FROM said),
e AS (SELECT x.*, lang AS condition FROM (SELECT doc_id, 'seamless' AS model, n AS ref_words, lost AS edits FROM c UNION ALL SELECT doc_id, 'whisper', n, got FROM c UNION ALL SELECT doc_id, 'mms-all', n, changed FROM c WHERE third) x JOIN documents USING (doc_id)),
p AS (SELECT unnest({quality.poisson_limits()}) AS l),
k AS (SELECT DISTINCT doc_id FROM e),
g AS (SELECT doc_id, i * 8 + j AS replicate, ('0x' || md5('1:' || doc_id || ':' || i)[j * 4 + 1 : j * 4 + 4])::INT AS draw FROM k, range(25) AS a(i), range(8) AS b(j)),
w AS (SELECT doc_id, replicate, (SELECT count(*) FROM p WHERE l <= draw) AS n FROM g),
d AS (SELECT model, condition, replicate, sum(edits * n) / sum(ref_words * n) AS wer FROM e JOIN w USING (doc_id) WHERE n > 0 GROUP BY 1, 2, 3 HAVING sum(ref_words * n) > 0),
i AS (SELECT model, condition, list_sort(list(wer)) AS ws FROM d GROUP BY 1, 2),
r AS (SELECT *, edits / ref_words AS wer, row_number() OVER (PARTITION BY condition ORDER BY edits / ref_words, model)::INT AS rank FROM (SELECT model, condition, sum(edits)::BIGINT AS edits, sum(ref_words)::BIGINT AS ref_words FROM e GROUP BY 1, 2)),
m AS (SELECT d.condition, replicate, min(d.wer) FILTER (rank = 1) AS own, min(d.wer) FILTER (rank > 1) AS other FROM d JOIN r USING (model, condition) GROUP BY 1, 2),
h AS (SELECT condition, avg((other IS NULL OR own < other)::INT) AS lead FROM m WHERE own IS NOT NULL GROUP BY 1)
SELECT model, condition, edits, ref_words, wer, rank, ws[floor(len(ws) * 0.025 + 1e-9)::INT + 1] AS low, ws[len(ws) - floor(len(ws) * 0.025 + 1e-9)::INT] AS high,
  CASE WHEN rank = 1 THEN lead END AS lead, rank = 1 AND lead >= 0.95 AS is_default FROM r JOIN i USING (model, condition) JOIN h USING (condition)""")
def model_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models on transcripts with insertions and deletions, with intervals of a paired bootstrap over the recordings."""
    model = F.get(F.array(F.lit("seamless"), F.lit("whisper"), F.lit("mms-all")), F.col("slot_no") - 1)
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording_id"), F.col("lang").alias("condition"))
    scored = quality.token_edits(edited(spark, sf_dir), ref="truth").select("recording_id", model.alias("model"), "edits", "ref_words").join(langs, "recording_id")
    return quality.rank_with_confidence(scratch.written(scored))


@query("""
WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type FROM events)
SELECT user_id::VARCHAR AS recording_id, CASE WHEN user_id % 4 = 0 THEN 'incomplete' ELSE 'complete' END AS status, count(*) AS n_chunks, string_agg(event_type, '' ORDER BY seq) AS content FROM c GROUP BY user_id""")
def chunk_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = event_chunks(spark, sf_dir).drop("ts")
    found = assemble_batch(chunks.unionAll(chunks))
    return found.select("recording_id", "status", "n_chunks", F.col("content").cast("string").alias("content"))


def event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as chunks of a recording, which lacks its last mark where user_id is a multiple of 4."""
    own = Window.partitionBy("user_id")
    seq = F.row_number().over(own.orderBy("event_id")) - 1
    last = (seq == F.count(F.lit(1)).over(own) - 1) & (F.col("user_id") % 4 != 0)
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("recording_id"), seq.cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").cast("binary").alias("bytes"), last.alias("is_last"))


@query("""
WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type FROM events WHERE user_id % 4 <> 0)
SELECT user_id::VARCHAR AS recording_id, count(*) AS n_chunks, string_agg(event_type, '' ORDER BY seq) AS content FROM c GROUP BY user_id""")
def chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recordings that a stream of the same chunks completes, each chunk coming twice."""
    source, out, state = (scratch.scratch_dir(spark) for _ in range(3))
    chunks = event_chunks(spark, sf_dir)
    chunks.unionAll(chunks).write.parquet(source)
    stream = assemble_chunks(spark.readStream.schema(chunks.schema).parquet(source))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(stream.schema).parquet(out).filter("status = 'complete'")
    return found.select("recording_id", "n_chunks", F.substring("content", 45, 1 << 30).cast("string").alias("content"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 8 IN (1, 4, 5, 6) THEN 400 END AS status,
  CASE doc_id % 8 WHEN 0 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 7 THEN 4 END AS n_slots,
  CASE WHEN doc_id % 8 IN (0, 7) THEN 'whisper' END AS last_model FROM documents""")
def slots_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ('[null, {"model": "whisper"}]', '{"a": 1}', "{}", "", "3", "[{}]", '[{"model": "a"', '[{"model":"a"},null,{"model":"b"},{"model":"whisper"}]')
    df = recordings.read_requests(table(spark, sf_dir, "documents").select("doc_id", pick(*texts).alias("stt_slots_json"), F.lit(None).cast(schemas.SLOTS).alias("stt_slots")))
    n = F.when(F.col("status").isNull(), F.coalesce(F.size("stt_slots"), F.lit(0)))
    return df.select("doc_id", "status", F.when(n < 0, 0).otherwise(n).alias("n_slots"), F.get("stt_slots", F.size("stt_slots") - 1)["model"].alias("last_model"))


@query(f"""
WITH {SLOTS_SQL}, t AS (SELECT recording_id, max(text) FILTER (slot_no = 1) AS t1, max(text) FILTER (slot_no = 2) AS t2, max(text) FILTER (slot_no = 3) AS t3 FROM slots GROUP BY 1)
SELECT recording_id, 'separate' AS pipeline, CASE WHEN known THEN t1 END AS transcript_1, CASE WHEN known THEN t2 END AS transcript_2, CASE WHEN known THEN t3 END AS transcript_3,
  CASE WHEN known THEN t1 END AS raw_transcript, NULL::VARCHAR AS final_text, CASE WHEN known THEN length(t1)::VARCHAR END AS notes, CASE WHEN NOT known THEN 502 END AS status
FROM t JOIN (SELECT doc_id AS recording_id, coalesce(nullif(lang, ''), 'fa') IN ('fa', 'en') AS known FROM documents) USING (recording_id)""")
def separate_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local slots; those whose language their service doesn't know fail, and their recordings with them."""
    heard = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording_id"), "text")
    found = run_pipelines(requests(spark, sf_dir), heard.withColumnRenamed("text", "said"), standins.STT, standins.LLM, audio="said", check_languages=True)
    return found.select("recording_id", "pipeline", "transcript_1", "transcript_2", "transcript_3", "raw_transcript", "final_text", "notes", "status")


@query("""
SELECT doc_id AS recording_id, ['multimodal','hybrid','separate','other'][doc_id % 4 + 1] AS pipeline,
  CASE WHEN bad THEN 400 WHEN unknown THEN 502 END AS status, CASE WHEN NOT bad AND NOT unknown THEN text END AS raw_transcript
FROM (SELECT *, doc_id % 4 = 3 OR (doc_id % 4 IN (0, 1) AND doc_id % 3 = 0) AS bad, doc_id % 4 IN (1, 2) AND coalesce(nullif(lang, ''), 'fa') NOT IN ('fa', 'en') AS unknown FROM documents)""")
def mixed_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("multimodal", "hybrid", "separate", "other"))), (F.col("recording_id") % 4).cast("int"))
    asked = requests(spark, sf_dir).withColumns({"pipeline": kind, "llm_model": F.when(kind == "separate", "aya-expanse-8b").otherwise("gemma-4-e4b"), "file_name": F.when(F.col("recording_id") % 3 == 0, "a.m4a").otherwise("a.wav")})
    heard = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording_id"), F.col("text").alias("said"))
    found = run_pipelines(asked, heard, standins.STT, standins.LLM, audio="said", check_languages=True)
    return found.select("recording_id", "pipeline", "status", "raw_transcript")


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, content): the events of each user as samples of a WAV file of 8000 a second."""

    @F.pandas_udf("binary")
    def wav(pcm):  # noqa: ANN001, ANN202
        return pcm.map(lambda x: to_wav(bytes(x), 8000))

    sample = F.unhex(F.lpad(F.hex(F.pmod(F.col("value").cast("long"), F.lit(65536))), 4, "0"))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", sample.alias("s"))
    sound = events.groupBy("user_id").agg(F.expr("listagg(s) within group (order by event_id)").alias("p"))
    return sound.select(F.col("user_id").cast("string").alias("recording_id"), wav("p").alias("content"))


@query("""
SELECT user_id::VARCHAR AS recording_id, NULL::INT AS status, 2 * count(*)::INT AS n_samples, 16000 AS sample_rate FROM events GROUP BY user_id""")
def recordings_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded as scanned recordings are."""
    found = inference.decode_audio(event_files(spark, sf_dir))
    return found.select("recording_id", "status", F.size("samples").alias("n_samples"), "sample_rate")


@query("""
SELECT user_id::VARCHAR AS recording_id, 'separate' AS pipeline, NULL::INT AS status, 2 * count(*) || ' samples' AS raw_transcript FROM events GROUP BY user_id""")
def streamed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that come in a stream, heard and reported batch by batch, read back from the sink."""
    source, out, state = (scratch.scratch_dir(spark) for _ in range(3))
    files = event_files(spark, sf_dir)
    files.write.parquet(source)
    slot = F.struct(F.lit("seamless").alias("model"), *[F.lit(None).cast("string").alias(k) for k in ("api_key", "base_url", "language")])

    def asked(batch: DataFrame) -> DataFrame:
        return batch.select("recording_id", F.lit("separate").alias("pipeline"), F.lit("aya-expanse-8b").alias("llm_model"), F.lit("fa").alias("language"), F.array(slot).alias("stt_slots"), F.lit("audio.wav").alias("file_name"))

    run_stream(spark.readStream.schema(files.schema).parquet(source), asked, standins.STT, standins.LLM, out, state).awaitTermination()
    return spark.read.parquet(out).select("recording_id", "pipeline", "status", F.get_json_object("result", "$.raw_transcript").alias("raw_transcript"))


@query("""
SELECT user_id::VARCHAR AS recording_id, CASE WHEN user_id % 3 = 0 THEN 'hybrid' ELSE 'separate' END AS pipeline, CASE WHEN user_id % 4 = 0 OR user_id % 5 = 0 THEN 404 END AS status,
  CASE WHEN user_id % 4 <> 0 AND user_id % 5 <> 0 THEN 2 * count(*) || ' samples' END AS raw_transcript FROM events GROUP BY user_id""")
def streamed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of requests meets a stream of recordings: some are missing (user_id a multiple of 4), some an hour late (of 5)."""
    said, heard, out, state = (scratch.scratch_dir(spark) for _ in range(4))
    slot = F.struct(F.lit("seamless").alias("model"), *[F.lit(None).cast("string").alias(k) for k in ("api_key", "base_url", "language")])
    kind = F.when(F.col("user") % 3 == 0, "hybrid").otherwise("separate")
    files = event_files(spark, sf_dir).withColumn("user", F.col("recording_id").cast("long"))
    begin = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = begin + F.make_dt_interval(F.lit(0), F.lit(0), F.pmod("user", F.lit(7)).cast("int"))
    last = spark.range(1).select(F.lit("end").alias("recording_id"), F.lit(None).cast("binary").alias("content"), F.lit(1).cast("long").alias("user"))
    late = F.when(F.col("user") % 5 == 0, at + F.expr("interval 1 hour")).otherwise(at + F.expr("interval 2 minutes"))
    day = F.expr("interval 1 day")
    files.filter("user % 4 <> 0").withColumn("recorded_at", late).unionByName(last.withColumn("recorded_at", begin + day)).drop("user").write.parquet(heard)
    asked = files.withColumn("requested_at", at).unionByName(last.withColumn("requested_at", begin + day)).withColumns({"pipeline": kind, "llm_model": F.when(kind == "hybrid", "gemma-4-e4b").otherwise("aya-expanse-8b"), "language": F.lit("fa"), "stt_slots": F.array(slot), "file_name": F.lit("audio.wav")})
    asked.drop("user", "content").write.parquet(said)
    streams = (spark.readStream.schema(spark.read.parquet(p).schema).parquet(p) for p in (said, heard))
    run_request_stream(*streams, standins.STT, standins.LLM, out, state).awaitTermination()
    found = spark.read.option("basePath", out).parquet(f"{out}/batch=*").filter("recording_id <> 'end'")
    return found.select("recording_id", "pipeline", "status", F.get_json_object("result", "$.raw_transcript").alias("raw_transcript"))
