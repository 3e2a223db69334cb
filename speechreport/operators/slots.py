"""Fan-out to slots, model lookup, and regrouping of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechreport.sources.schemas import REPORT_KEYS

SLOT_NUMBERS = (1, 2, 3)


def fan_out_slots(df: DataFrame, slots: str = "stt_slots") -> DataFrame:
    """One row for each configured slot: slot_no is its position from 1, null slots are skipped but counted.

    The run's language, if df has one, stands in for a slot's that is null or ''.
    """
    kept = [c for c in df.columns if c != slots]
    out = df.select(*kept, F.posexplode(slots).alias("_pos", "_slot")).filter(F.col("_slot").isNotNull())
    run = F.nullif(F.col("language"), F.lit("")) if "language" in kept else F.lit(None)
    kept = [c for c in kept if c not in ("slot_no", "model", "api_key", "base_url", "language")]
    return out.select(*kept, (F.col("_pos") + 1).alias("slot_no"), "_slot.model", "_slot.api_key", "_slot.base_url", F.coalesce(F.nullif(F.col("_slot.language"), F.lit("")), run).alias("language"))


def attach_model(df: DataFrame, registry: DataFrame, model: str = "model") -> tuple[DataFrame, DataFrame]:
    """(rows with the registry's columns, rejects with status 404). Registries have a row for each model;
    Spark broadcasts one that it knows to be small."""
    known = registry
    rejects = df.join(known, F.col(model) == F.col("key"), "left_anti").withColumns({"status": F.lit(404), "error": F.concat(F.lit("unknown model: "), F.coalesce(F.col(model), F.lit("")))})
    return df.join(known, F.col(model) == F.col("key")), rejects


def audio_models(registry: DataFrame) -> DataFrame:
    return registry.filter("supports_audio")


def assemble_transcripts(df: DataFrame, key: str = "recording_id") -> DataFrame:
    """(key, transcripts map by 'transcript_N', transcript_1..3): empty transcripts are present.

    Of several texts for one slot, as equal requests give, the largest counts.
    """
    entry = F.struct("slot_no", "text")
    grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_slots"))
    last = F.filter("_slots", lambda s, i: ~F.coalesce(F.get("_slots", i + 1)["slot_no"] == s["slot_no"], F.lit(False)))
    name = F.transform(last, lambda s: F.struct(F.concat(F.lit("transcript_"), s["slot_no"].cast("string")).alias("key"), s["text"].alias("value")))
    # the texts are regrouped once and told apart afterwards
    found = grouped.select(key, F.map_from_entries(name).alias("transcripts"))
    return found.select(key, "transcripts", *[F.try_element_at("transcripts", F.lit(f"transcript_{n}")).alias(f"transcript_{n}") for n in SLOT_NUMBERS])


def labelled(transcripts: Column) -> Column:
    """Transcripts 1..3 that are present, as (slot_no, text) in order of slots."""
    pairs = [F.struct(F.lit(n).alias("slot_no"), F.element_at(transcripts, f"transcript_{n}").alias("text"), F.map_contains_key(transcripts, f"transcript_{n}").alias("there")) for n in SLOT_NUMBERS]
    return F.filter(F.array(*pairs), lambda p: p["there"])


def references(transcripts: Column) -> Column:
    """All transcripts in string order of their keys ('transcript_10' before 'transcript_2')."""
    return F.array_sort(F.map_entries(transcripts))


def attach_references(recordings: DataFrame, assembled: DataFrame, key: str = "recording_id") -> DataFrame:
    return recordings.join(assembled, key, "left")


def merge_report(df: DataFrame) -> DataFrame:
    """Transcripts and reply in one row; a key that the reply holds wins, also over a transcript.

    df: transcript_1..3, report (struct of the template), present_keys, extra (map of other keys).
    """
    present = lambda k: F.coalesce(F.array_contains("present_keys", k), F.lit(False))
    columns = {k: F.when(present(k), F.col(f"report.{k}")) for k in REPORT_KEYS}
    columns |= {k: F.when(present(k), F.element_at("extra", k)).otherwise(F.col(k)) for k in (f"transcript_{n}" for n in SLOT_NUMBERS)}
    merged = df.withColumns(columns)
    return merged.withColumn("extra", F.map_filter("extra", lambda k, _: ~k.isin(*[f"transcript_{n}" for n in SLOT_NUMBERS]))).drop("report")
