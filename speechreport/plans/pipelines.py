"""The three report pipelines over a request table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechreport.functions.columns import DEFAULT_LANGUAGE, generation_params, redact_slots, text_route
from speechreport.operators import inference, prompts, replies, slots
from speechreport.operators.inference import Engines
from speechreport.operators.validate import check_audio_format, check_language, split_valid, validate_requests
from speechreport.sources.scratch import dropped, written

KEY = "request_id"
REJECT = (KEY, "recording_id", "pipeline", "status", "error")
#: What a language model's call takes from its request besides the messages.
CALL = ("params", "api_key", "base_url")


def identified(requests: DataFrame) -> DataFrame:
    """requests with request_id: their own, or a digest of the request, its keys as a digest of their own.

    One recording may have many requests. Equal requests share an id and have equal results; requests that differ in their
    keys alone don't.
    """
    if KEY in requests.columns:
        return requests
    told = [redact_slots(F.col(c)).alias(c) if c == "stt_slots" else F.col(c) for c in sorted(requests.columns) if not c.endswith("api_key")]
    keys = [F.transform(c, lambda s: s["api_key"]).alias(c) if c == "stt_slots" else F.col(c) for c in sorted(requests.columns) if c == "stt_slots" or c.endswith("api_key")]
    return requests.withColumn(KEY, F.sha2(F.to_json(F.struct(*told, *([F.sha2(F.to_json(F.struct(*keys)), 256).alias("_keys")] if keys else []))), 256))


def with_call(requests: DataFrame) -> DataFrame:
    """Adds params from the request's temperature, and the language model's api_key and base_url."""
    has = lambda c: F.col(c) if c in requests.columns else F.lit(None)
    return requests.withColumns({"params": generation_params(has("temperature")), "api_key": has("llm_api_key").cast("string"), "base_url": has("llm_base_url").cast("string")})


def with_audio(df: DataFrame, recordings: DataFrame, audio: str) -> DataFrame:
    """df's rows with their recording's audio and its bytes, which can be read without it; Spark broadcasts df where it is small."""
    size = F.col("length") if "length" in recordings.columns else inference.weight(audio, recordings)
    return recordings.select("recording_id", audio, size.alias("_bytes")).join(df, "recording_id")


def transcripts_of(requests: DataFrame, recordings: DataFrame, engines: Engines, audio: str, on_slot_error: str, check_languages: bool = True, cleanup: list[Callable[[], object]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """(assembled transcripts, keys that have a transcript of slots 1..3, rejects, weights of the language models' calls, tasks) of requests with slots.

    The transcripts are dealt by key to that many tasks, a number that grows with their characters, whatever the session's
    number of partitions. Requests that meet them should be dealt likewise, so that nothing is joined in fewer tasks, and
    without rejected ones, whose other slots are still among the transcripts: leaving them out there would move all texts once more.
    """
    fanned = slots.fan_out_slots(requests.select(KEY, "recording_id", "llm_model", "language", "stt_slots"))
    # only the local speech service has a default language and checks languages; its 400 is the slot's 502
    local = text_route(F.col("model")) == "local"
    asked = check_language(fanned.withColumn("_told", F.col("language")), default=DEFAULT_LANGUAGE)
    asked = asked.withColumn("language", F.when(local, F.col("language")).otherwise(F.col("_told"))).drop("_told")
    unknown = F.lit(check_languages) & F.col("status").isNotNull() & local
    slot = F.struct("slot_no", "model", "language", "api_key", "base_url")
    calls = asked.filter(~unknown).groupBy(KEY, "recording_id", "llm_model").agg(F.array_distinct(F.array_sort(F.collect_list(slot))).alias("slots"))
    heard = with_audio(calls, recordings, audio)
    rows = inference.transcribe(heard, engines, audio, key=KEY, size="_bytes", cleanup=cleanup).drop("_bytes")
    if check_languages:
        error = F.concat(F.lit("unknown language: "), F.col("language"))
        refused = asked.filter(unknown).withColumns({"text": F.lit(None).cast("string"), "status": F.lit(502), "error": error})
        rows = rows.unionByName(refused.select(*rows.columns))
    # with its length beside it, a text is read only where it is told
    rows = written(rows.withColumn("_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")))
    if cleanup is not None:
        cleanup.append(lambda: dropped(rows))
    tasks = inference.tasks_for(rows, "_chars")
    _, rejects = inference.fail_recordings(rows, KEY, on_slot_error)
    good = rows.filter("status is null").select(KEY, "slot_no", "text").repartition(tasks, KEY)
    usable = rows.filter(F.col("status").isNull() & F.col("slot_no").isin(*slots.SLOT_NUMBERS)).select(KEY).distinct()
    weights = rows.groupBy("llm_model", KEY).agg(F.sum("_chars").alias("weight"))
    return slots.assemble_transcripts(good, KEY), usable, rejects, weights, tasks


def finish(asked: DataFrame) -> DataFrame:
    """Reports and failed rows from rows with reply, status and error of the language model."""
    failed = asked.filter("status is not null").select(*REJECT)
    parsed = replies.extract_json(asked.filter("status is null").select(KEY, "recording_id", "pipeline", "transcript_1", "transcript_2", "transcript_3", "reply"))
    return slots.merge_report(parsed).drop("reply").unionByName(failed, allowMissingColumns=True)


def listener_text(pipeline: Column, transcripts: Column) -> Column:
    """What a listening model is told of transcripts: '' unless the pipeline is hybrid."""
    none = F.create_map().cast("map<string,string>")
    return F.coalesce(prompts.reference_sections(F.when(pipeline == "hybrid", F.coalesce(transcripts, none)).otherwise(none)), F.lit(""))


def run_pipelines(requests: DataFrame, recordings: DataFrame, stt: Engines, llm: Engines, audio: str = "samples", on_slot_error: str = "fail", check_languages: bool = True, cleanup: list[Callable[[], object]] | None = None) -> DataFrame:
    """One row for each request: its report, or a status and an error.

    requests: recording_id, pipeline, llm_model, language, stt_slots, file_name, and if wanted request_id,
    temperature, llm_api_key, llm_base_url. recordings: recording_id and a column of audio, either a file's
    bytes, which the stages decode, or something that the engines take as it is. A request whose recording
    is missing gets status 404, one whose audio can't be decoded 400. Slots of the local speech service without a
    language get its default, and fail with 502 where it does not support their language, unless ``check_languages`` is
    off; a cloud slot without a language is called without one. Transcripts and replies are written once each, as several
    branches read them; what deletes them is added to ``cleanup``, which a caller may run once the result is written.
    Credentials are never written.
    """
    checked = validate_requests(with_call(identified(requests)), list(stt), list(llm))
    valid, rejects = split_valid(checked)
    known = recordings.select("recording_id")
    heard = valid.join(known, "recording_id", "left_semi")
    missing = valid.join(known, "recording_id", "left_anti").withColumns({"status": F.lit(404), "error": F.lit("no such recording")})
    # the format is checked before any slot is transcribed
    direct, bad_format = split_valid(check_audio_format(heard.filter(F.col("pipeline") != "separate")))
    rejects = rejects.select(*REJECT).unionByName(missing.select(*REJECT)).unionByName(bad_format.select(*REJECT))

    with_slots = heard.filter("pipeline = 'separate'").unionByName(direct.filter("pipeline = 'hybrid'").drop("audio_format"))
    assembled, usable, failed, weights, tasks = transcripts_of(with_slots, recordings, stt, audio, on_slot_error, check_languages, cleanup)
    rejects = rejects.unionByName(failed.join(valid.select(KEY, "recording_id", "pipeline"), KEY).select(*REJECT))

    # with 'skip' a request whose slots all failed has no transcripts, which build_messages rejects
    asked = (KEY, "recording_id", "pipeline", "llm_model", *CALL)
    separate = heard.filter("pipeline = 'separate'").join(failed.select(KEY), KEY, "left_anti").select(*asked)
    ready, _ = split_valid(prompts.build_messages(slots.attach_references(separate.repartition(tasks, KEY), assembled, KEY)))
    # told by keys alone, so that no text is regrouped once more for them
    without = separate.join(usable, KEY, "left_anti").withColumn("transcripts", F.lit(None).cast("map<string,string>"))
    rejects = rejects.unionByName(split_valid(prompts.build_messages(without))[1].select(*REJECT))
    text = inference.chat(ready.drop("transcripts"), llm, key=KEY, cleanup=cleanup, sized=weights)

    listening = direct.filter("pipeline = 'multimodal'").unionByName(direct.filter("pipeline = 'hybrid'").join(failed.select(KEY), KEY, "left_anti")).select(*asked)
    listening = slots.attach_references(listening.repartition(tasks, KEY), assembled, KEY)
    user = listener_text(F.col("pipeline"), F.col("transcripts"))
    listening = listening.withColumn("messages", prompts.messages(F.lit(prompts.system_prompt(prompts.LISTEN)), user)).drop("transcripts")
    sound = inference.chat_audio(with_audio(listening, recordings, audio), llm, audio, key=KEY, size="_bytes", cleanup=cleanup)
    replied = written(text.unionByName(sound))
    if cleanup is not None:
        cleanup.append(lambda: dropped(replied))
    return finish(replied).unionByName(rejects, allowMissingColumns=True)
