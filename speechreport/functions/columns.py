"""Column expressions: routing, overrides, formats, names. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes that route a model name to a cloud provider.
API_PREFIX, GEMINI_PREFIX = "openai:", "gemini:"
#: Audio formats and their MIME types; the formats of the first cloud provider.
MIME_TYPES = {"wav": "audio/wav", "mp3": "audio/mp3", "aac": "audio/aac", "ogg": "audio/ogg", "flac": "audio/flac", "aiff": "audio/aiff"}
API_FORMATS = ("wav", "mp3")
#: Language codes by model family; other families take none.
FAMILY_LANGUAGES = {
    "whisper": {"fa": "persian", "en": "english"},
    "seamless_v1": {"fa": "pes", "en": "eng"},
    "seamless_v2": {"fa": "pes", "en": "eng"},
}
LANGUAGES = {"fa": "Persian", "en": "English"}
DEFAULT_LANGUAGE = "fa"
#: Ranges of right-to-left letters.
RTL = r"[֐-ࣿיִ-﷿ﹰ-﻿]"
UNSAFE = r'[\\/:*?"<>|]'
#: Characters that count as white space at the ends of a text.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The file name of a run that has none.
DEFAULT_NAME = "audio.wav"
MAX_NEW_TOKENS = 2048
DEFAULT_TEMPERATURE = 0.3
GREEDY_BELOW = 0.01


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def provider(model: Column) -> Column:
    """local, openai or gemini; null and '' are local."""
    return F.when(model.startswith(API_PREFIX), "openai").when(model.startswith(GEMINI_PREFIX), "gemini").otherwise("local")


def bare_model(model: Column) -> Column:
    """The name without its provider prefix."""
    return F.when(provider(model) != "local", F.substring(model, len(API_PREFIX) + 1, 1_000_000)).otherwise(model)


def text_route(model: Column) -> Column:
    """Where text chat and transcription go: only the first cloud provider is known there."""
    return F.when(model.startswith(API_PREFIX), "openai").otherwise("local")


def resolve(*columns: Column) -> Column:
    """The first value that is neither null nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def qualify_model(model: Column, is_cloud: Column, role: str) -> Column:
    """A bare name as typed by a user, qualified: cloud names get the API prefix.

    A language model (role 'llm') that names the other provider stays; a slot always gets the prefix.
    """
    name = stripped(model)
    asis = (name.startswith(GEMINI_PREFIX)) if role == "llm" else F.lit(False)
    return F.when(is_cloud & ~asis, F.concat(F.lit(API_PREFIX), name)).otherwise(name)


def file_suffix(name: Column) -> Column:
    """Lower-case last suffix of a path's last part, without the dot; '' if it has none."""
    last = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(last, r"^.+\.([^.]+)$", 1))


def audio_format(name: Column, model: Column) -> Column:
    """The audio format of a file name if the model's provider accepts it, else null; no name is DEFAULT_NAME."""
    suffix = file_suffix(resolve(name, F.lit(DEFAULT_NAME)))
    allowed = F.when(provider(model) == "openai", suffix.isin(*API_FORMATS)).otherwise(suffix.isin(*MIME_TYPES))
    return F.when(allowed, suffix)


def mime_type(fmt: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(MIME_TYPES), fmt), F.concat(F.lit("audio/"), fmt))


def language_known(language: Column) -> Column:
    return language.isin(*LANGUAGES)


def family_language(family: Column, language: Column) -> Column:
    """The code that a model family takes; unknown codes pass through, other families get null."""
    found = F.lit(None).cast("string")
    for name, codes in FAMILY_LANGUAGES.items():
        found = F.when(family == name, F.coalesce(F.element_at(literal_map(codes), language), language)).otherwise(found)
    return found


def redact_slots(slots: Column) -> Column:
    """Slots without their api_key; null slots stay null."""
    return F.transform(slots, lambda s: F.when(s.isNotNull(), s.dropFields("api_key")))


def is_rtl(text: Column) -> Column:
    return F.coalesce(text.rlike(RTL), F.lit(False))


def sanitize_part(name: Column) -> Column:
    """A model name as part of a file name; '' for null."""
    bare = F.when(name.startswith(API_PREFIX), F.substring(name, len(API_PREFIX) + 1, 1_000_000)).otherwise(name)
    return F.coalesce(F.btrim(F.regexp_replace(bare, UNSAFE, "-"), F.lit("-_")), F.lit(""))


def output_name(path: Column, models: list[Column], ext: str = ".docx") -> Column:
    """stem_part_part.ext; 'report' stands for the stem where there is no path."""
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    # leading dots belong to the stem
    stem = F.when(last.rlike(r"^\.*[^.].*\.[^.]*$"), F.regexp_replace(last, r"\.[^.]*$", "")).otherwise(last)
    stem = F.when(F.nullif(path, F.lit("")).isNull(), F.lit("report")).otherwise(stem)
    parts = F.filter(F.array(stem, *[sanitize_part(m) for m in models]), lambda p: p != "")
    return F.concat(F.array_join(parts, "_"), F.lit(ext))


def headline(final: Column, corrected: Column) -> Column:
    return F.coalesce(resolve(final, corrected), F.lit(""))


def generation_params(temperature: Column) -> Column:
    """(do_sample, temperature, max_new_tokens): greedy at or below 0.01, else sampled."""
    t = F.coalesce(temperature.cast("double"), F.lit(DEFAULT_TEMPERATURE))
    sampled = t > GREEDY_BELOW
    return F.struct(sampled.alias("do_sample"), F.when(sampled, t).alias("temperature"), F.lit(MAX_NEW_TOKENS).alias("max_new_tokens"))
