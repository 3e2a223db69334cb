"""Request validation: the first rule that a request breaks gives its status and error."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechreport.functions.columns import audio_format, bare_model, language_known, provider, resolve, text_route

PIPELINES = ("separate", "multimodal", "hybrid")
MAX_SLOTS = 3


def _unserved(model: Column, engines: Iterable[str] | None, route: Column) -> Column:
    """Whether a local model has no engine among ``engines`` (None: all are there)."""
    if engines is None:
        return F.lit(False)
    return (route == "local") & ~F.coalesce(model.isin(*engines) if engines else F.lit(False), F.lit(False))


def validate_requests(df: DataFrame, stt_engines: Iterable[str] | None = None, llm_engines: Iterable[str] | None = None) -> DataFrame:
    """df with status (null: valid) and error, for columns pipeline, llm_model, stt_slots.

    Rules hold in the order given here. The limit of slots is the session's: slots that a run brings itself
    (run_slots, if df has that column) are not counted. Slots that are null count toward the limit of slots but are
    not configured. A status that the row has already stays. A request without a pipeline has no
    session. Only the audio pipelines know the second cloud provider.
    """
    slots, pipeline, model = F.col("stt_slots"), F.col("pipeline"), F.col("llm_model")
    configured = F.coalesce(F.exists(slots, lambda s: s.isNotNull()), F.lit(False))
    session = ~F.coalesce("run_slots", F.lit(False)) if "run_slots" in df.columns else F.lit(True)
    audio = pipeline.isin("multimodal", "hybrid")
    stt_down = F.coalesce(F.exists(slots, lambda s: s.isNotNull() & _unserved(s["model"], stt_engines, text_route(s["model"]))), F.lit(False))
    llm_down = _unserved(model, llm_engines, F.when(audio, provider(model)).otherwise(text_route(model)))
    rules = [
        (pipeline.isNull(), 409, "no session"),
        (~pipeline.isin(*PIPELINES), 400, "unknown pipeline"),
        (session & (F.coalesce(F.size(slots), F.lit(0)) > MAX_SLOTS), 400, "more than 3 slots"),
        (audio & llm_down, 503, "no engine for the language model"),
        ((pipeline == "hybrid") & ~configured, 400, "hybrid needs a configured slot"),
        ((pipeline == "hybrid") & stt_down, 503, "no engine for a slot"),
        ((pipeline == "separate") & ~configured, 400, "separate needs a configured slot"),
        ((pipeline == "separate") & stt_down, 503, "no engine for a slot"),
        ((pipeline == "separate") & llm_down, 503, "no engine for the language model"),
    ]
    status, error = F.lit(None).cast("int"), F.lit(None).cast("string")
    for broken, code, what in reversed(rules):
        status, error = F.when(broken, code).otherwise(status), F.when(broken, what).otherwise(error)
    if "status" in df.columns:
        error, status = F.when(F.col("status").isNotNull(), F.col("error")).otherwise(error), F.coalesce("status", status)
    return df.withColumns({"status": status, "error": error})


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without a status, and the rejects."""
    return df.filter("status is null").drop("status", "error"), df.filter("status is not null")


def check_audio_format(df: DataFrame, name: str = "file_name", model: str = "llm_model") -> DataFrame:
    """Adds audio_format, and status 400 where the provider doesn't take the file's format."""
    found = df.withColumn("audio_format", audio_format(F.col(name), F.col(model)))
    return found.withColumns({"status": F.when(F.col("audio_format").isNull(), 400), "error": F.when(F.col("audio_format").isNull(), "audio format not accepted")})


def check_language(df: DataFrame, language: str = "language", default: str = "fa") -> DataFrame:
    """Resolves the language ('' and null: the default) and adds status 400 where it is not supported."""
    found = df.withColumn(language, resolve(F.col(language), F.lit(default)))
    return found.withColumn("status", F.when(~language_known(F.col(language)), 400))


def routed(df: DataFrame, model: str = "llm_model") -> DataFrame:
    """Adds provider, text_route and bare_model."""
    return df.withColumns({"provider": provider(F.col(model)), "text_route": text_route(F.col(model)), "bare_model": bare_model(F.col(model))})
