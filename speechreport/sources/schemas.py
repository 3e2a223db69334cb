"""Schemas and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from speechreport.functions.columns import API_FORMATS, DEFAULT_LANGUAGE, LANGUAGES, MIME_TYPES

SLOT = T.StructType([T.StructField(n, T.StringType()) for n in ("model", "api_key", "base_url", "language")])
SLOTS = T.ArrayType(SLOT, True)

REQUEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("recording_id", "pipeline", "llm_model", "language", "stt_api_key", "stt_base_url", "llm_api_key", "llm_base_url")]
    + [T.StructField("stt_slots", SLOTS)]
)

RECORDINGS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])

#: Models by rank, with type, hub name and language parameter.
STT_MODELS = (
    ("seamless", "seamless_v2", "facebook/seamless-m4t-v2-large", "pes"),
    ("whisper", "whisper", "nezamisafa/whisper-persian-v4", None),
    ("seamless-medium", "seamless_v1", "facebook/hf-seamless-m4t-medium", "pes"),
    ("whisper-halakoo", "whisper", "MohammadReza-Halakoo/persian-whisper-large-v3-10-percent-17-0-one-epoch", None),
    ("mms-all", "mms", "facebook/mms-1b-all", "fas"),
    ("mms-fl102", "mms", "facebook/mms-1b-fl102", "fas"),
    ("whisper-vhdm", "whisper", "vhdm/whisper-large-fa-v1", None),
    ("wav2vec2-xlsr53", "ctc", "jonatasgrosman/wav2vec2-large-xlsr-53-persian", None),
    ("whisper-large-v3", "whisper", "openai/whisper-large-v3", None),
    ("whisper-large-v3-turbo", "whisper", "openai/whisper-large-v3-turbo", None),
)
#: Language models and whether they hear audio.
LLM_MODELS = (
    ("aya-expanse-8b", False),
    ("aya-expanse-32b", False),
    ("gemma-4-31b", False),
    ("gemma-4-e4b", True),
    ("gemma-4-12b", True),
    ("qwen3-omni-30b", True),
)
#: Keys of a report, in order.
REPORT_KEYS = ("raw_transcript", "corrected_transcript", "final_text", "discrepancies_found", "notes")


def report_schema() -> T.StructType:
    """The report template: strings, and a list of strings for the discrepancies."""
    return T.StructType([T.StructField(k, T.ArrayType(T.StringType()) if k == "discrepancies_found" else T.StringType()) for k in REPORT_KEYS])


def stt_registry(spark: SparkSession) -> DataFrame:
    """(key, rank, type, model_id, lang_param), the best model first."""
    return spark.createDataFrame([(k, i, *rest) for i, (k, *rest) in enumerate(STT_MODELS, 1)], "key string, rank int, type string, model_id string, lang_param string")


def llm_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LLM_MODELS), "key string, supports_audio boolean")


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, c == DEFAULT_LANGUAGE) for c, n in LANGUAGES.items()], "code string, name string, is_default boolean")


def audio_formats(spark: SparkSession) -> DataFrame:
    """(ext, mime, provider) of every format that a provider accepts."""
    rows = [(e, m, p) for p in ("local", "gemini") for e, m in MIME_TYPES.items()]
    return spark.createDataFrame(rows + [(e, MIME_TYPES[e], "openai") for e in API_FORMATS], "ext string, mime string, provider string")
