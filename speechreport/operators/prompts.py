"""Prompts and request bodies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechreport.functions.columns import bare_model, mime_type
from speechreport.operators.slots import labelled, references
from speechreport.sources.schemas import REPORT_KEYS

#: Labels of sections, and the line before the template.
ENGINE_LABEL = ("STT engine ", " transcript:\n")
REFERENCE_LABEL = ("Reference transcript ", " (from a separate STT engine — may contain errors):\n")
TEMPLATE_LINE = "\n\nJSON template to fill:\n"
#: What the models are told unless the caller has a text of their own.
RECONCILE = "Reconcile these transcripts of one dictated radiology report. Use nothing that they don't hold. Answer with JSON that fills the template."
LISTEN = "Listen to this dictated radiology report; transcripts, if any, are only evidence. Use nothing that isn't said. Answer with JSON that fills the template."


def template_text() -> str:
    """The report template as JSON with an indent of 2."""
    return json.dumps({k: [] if k == "discrepancies_found" else None for k in REPORT_KEYS}, ensure_ascii=False, indent=2)


def system_prompt(text: str) -> str:
    return text + TEMPLATE_LINE + template_text()


def engine_sections(transcripts: Column) -> Column:
    """Sections of slots 1..3 that are present, joined by a blank line; null if there is none."""
    parts = labelled(transcripts)
    text = F.array_join(F.transform(parts, lambda p: F.concat(F.lit(ENGINE_LABEL[0]), p["slot_no"].cast("string"), F.lit(ENGINE_LABEL[1]), F.coalesce(p["text"], F.lit("")))), "\n\n")
    return F.when(F.size(parts) > 0, text)


def reference_sections(transcripts: Column) -> Column:
    """All transcripts in string order of their keys, numbered from 1; null if there is none."""
    parts = references(transcripts)
    text = F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit(REFERENCE_LABEL[0]), (i + 1).cast("string"), F.lit(REFERENCE_LABEL[1]), F.coalesce(p["value"], F.lit("")))), "\n\n")
    return F.when(F.size(parts) > 0, text)


def messages(system: Column, user: Column) -> Column:
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(said("system", system), said("user", user))


def build_messages(df: DataFrame, prompt: str = RECONCILE) -> DataFrame:
    """Adds messages for text reconciliation, and status 400 where no slot 1..3 has a transcript."""
    user = engine_sections(F.col("transcripts"))
    found = df.withColumn("_user", user)
    return found.withColumns({
        "messages": F.when(F.col("_user").isNotNull(), messages(F.lit(system_prompt(prompt)), F.col("_user"))),
        "status": F.when(F.col("_user").isNull(), 400), "error": F.when(F.col("_user").isNull(), "no usable transcript"),
    }).drop("_user")


def unbroken(audio: Column) -> Column:
    """Base64 in one line."""
    return F.replace(F.base64(audio), F.lit("\r\n"), F.lit(""))


def render_request(shape: str, model: Column, system: Column, user: Column, audio: Column | None = None, fmt: Column | None = None, json_reply: bool = True) -> Column:
    """A request body as JSON text: 'chat', 'audio_chat' (audio part first) or 'inline' (prompt twice).

    Keys without a value are left out.
    """
    name = F.nullif(bare_model(model), F.lit(""))
    if shape == "inline":
        both = F.concat(system, F.when(F.coalesce(F.length(user), F.lit(0)) > 0, F.concat(F.lit("\n\n"), user)).otherwise(F.lit("")))
        text = F.struct(both.alias("text"), F.lit(None).cast("struct<mime_type:string,data:string>").alias("inline_data"))
        media = F.struct(F.lit(None).cast("string").alias("text"), F.struct(mime_type(fmt).alias("mime_type"), unbroken(audio).alias("data")).alias("inline_data"))
        body = [F.struct(F.array(F.struct(system.alias("text"))).alias("parts")).alias("system_instruction"), F.array(F.struct(F.lit("user").alias("role"), F.array(text, media).alias("parts"))).alias("contents")]
        kind = [F.struct(F.lit("application/json").alias("response_mime_type")).alias("generationConfig")] if json_reply else []
        return F.to_json(F.struct(*body, *kind))
    kind = [F.struct(F.lit("json_object").alias("type")).alias("response_format")] if json_reply else []
    if shape == "chat":
        return F.to_json(F.struct(name.alias("model"), messages(system, user).alias("messages"), *kind))
    sound = F.to_json(F.struct(F.lit("input_audio").alias("type"), F.struct(unbroken(audio).alias("data"), fmt.alias("format")).alias("input_audio")))
    text = F.when(F.coalesce(F.length(user), F.lit(0)) > 0, F.to_json(F.struct(F.lit("text").alias("type"), user.alias("text"))))
    content = F.concat(F.lit("["), F.concat_ws(",", sound, text), F.lit("]"))
    # the contents of the two messages differ in type, so the body is put together from JSON texts
    said = F.concat(F.lit("["), F.to_json(F.struct(F.lit("system").alias("role"), system.alias("content"))), F.lit(',{"role":"user","content":'), content, F.lit("}]"))
    inner = lambda *c: F.regexp_extract(F.to_json(F.struct(*c)), r"(?s)^\{(.*)\}$", 1)
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(inner(name.alias("model")), F.concat(F.lit('"messages":'), said), inner(*kind) if kind else F.lit("")), lambda x: x != ""), ","), F.lit("}"))


def to_parts(said: Column, family: str, audio: Column | None = None, last_user: Column | None = None) -> Column:
    """Messages with contents as parts (type, text, ref).

    'gemma': system stays one text, the audio part follows the text; 'qwen': all roles in parts, the
    audio part comes first. Audio goes to the message number ``last_user`` (from 0).
    """
    part = lambda kind, text, ref: F.struct(F.lit(kind).alias("type"), text.alias("text"), ref.alias("ref"))
    none = F.lit(None).cast("string")

    def one(m: Column, i: Column) -> Column:
        text = part("text", m["content"], none)
        parts = F.array(text)
        if audio is not None:
            sound = part("audio", none, audio)
            both = F.array(text, sound) if family == "gemma" else F.array(sound, text)
            parts = F.when((i == last_user) & audio.isNotNull(), both).otherwise(parts)
        if family == "gemma":
            parts = F.when(m["role"] == "system", F.array(part("plain", m["content"], none))).otherwise(parts)
        return F.struct(m["role"].alias("role"), parts.alias("parts"))

    return F.transform(said, one)
