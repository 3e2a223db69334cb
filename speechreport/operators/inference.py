"""Inference as partitioned Arrow batch stages around engines that the caller supplies.

``engines`` maps a model key to a picklable factory. A factory's object has transcribe(audio, rate,
language, access), chat(messages, params, access) or chat_audio(messages, audio, params, access);
access is a dict of api_key and base_url. An engine that takes many calls at once has the method with
``_all`` at its name's end, which gets a list of such argument tuples and gives a list of texts.

A worker builds an engine when the first row asks for it and keeps the last KEPT ones. Rows are dealt to tasks by
running sums of what they weigh for each engine, bytes of audio or characters of a prompt, so a task has one engine and about
TASK_BYTES or TASK_CHARS of work whatever the size of the input, and rows of like weight are called together. Audio travels as the files' bytes, once for each request, and is decoded in
the stage that hears it, once for all slots.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechreport.sources.scratch import dropped, small, written

Engines = dict[str, Callable[[], Any]]
RATE = 16_000
TAPS = 16
#: Sample rates that are decoded differ from the target by this factor at most.
RATES = 64
#: Samples that are resampled at a time.
CHUNK = 1 << 16
#: Work of one task, and shares of it by which rows are dealt.
TASK_BYTES, TASK_CHARS, SHARES = 64 << 20, 1 << 22, 8
#: Characters of transcripts that a task regroups, and what a row counts besides its text.
REGROUP_CHARS, ROW_CHARS = 1 << 25, 128
#: Engines of one kind that a worker keeps, and rows whose audio it holds at once.
KEPT, PORTION = 3, 64

_built: dict[tuple[str, str, str], Any] = {}


def marked(engines: Engines) -> dict[str, tuple[str, Callable[[], Any]]]:
    """The factories with a digest of each, so that a worker doesn't take an engine that another factory made under the same key."""
    return {k: (hashlib.sha256(cloudpickle.dumps(f)).hexdigest(), f) for k, f in engines.items()}


def _engine(engines: dict[str, tuple[str, Callable[[], Any]]], key: str, kind: str) -> Any:
    """The worker's engine for a key. The one that was used longest ago goes when there are more than KEPT."""
    digest, factory = engines[key]
    made = _built.pop((kind, key, digest), None)
    _built[kind, key, digest] = made = factory() if made is None else made
    for other in [k for k in _built if k[0] == kind][:-KEPT]:
        del _built[other]
    return made


def resample(audio: np.ndarray, rate: int, target: int = RATE) -> np.ndarray:
    """Windowed-sinc resampling; the cut-off is the lower of the two half rates."""
    if rate == target or not len(audio):
        return audio.astype(np.float32)
    scale = min(1.0, target / rate)
    reach, size = int(np.ceil(TAPS / scale)), int(round(len(audio) * target / rate))
    out = np.zeros(size, np.float32)
    for begin in range(0, size, CHUNK):
        at = np.arange(begin, min(begin + CHUNK, size)) * (rate / target)
        near = np.floor(at).astype(int)
        part = np.zeros(len(at))
        for k in range(-reach + 1, reach + 1):
            x = at - (near + k)
            w = np.sinc(x * scale) * scale * np.cos(np.clip(x / reach, -1, 1) * np.pi / 2) ** 2
            part += w * audio[np.clip(near + k, 0, len(audio) - 1)]
        out[begin : begin + CHUNK] = part
    return out


def decode_wav(content: bytes | None, target: int = RATE) -> tuple[np.ndarray | None, str | None]:
    """(mono samples at the target rate, error) of a 16-bit PCM WAV file; channels are averaged.

    A sample rate that differs from the target by more than RATES times is an error, as it is no recording of speech
    and its samples would be many times the file.
    """
    try:
        with wave.open(io.BytesIO(content or b"")) as f:
            if f.getsampwidth() != 2:
                return None, "only 16-bit PCM is decoded"
            channels, rate = f.getnchannels(), f.getframerate()
            if rate < 1:
                return None, "undecodable audio: no sample rate"
            if not target / RATES <= rate <= target * RATES:
                return None, f"undecodable audio: {rate} samples a second"
            raw = np.frombuffer(f.readframes(f.getnframes()), "<i2")
    except (wave.Error, EOFError, ValueError, ArithmeticError, struct.error) as error:
        return None, f"undecodable audio: {error}"
    mono = raw[: len(raw) // channels * channels].reshape(-1, channels).mean(axis=1) / 32768.0
    return resample(mono, rate, target), None


def decode_audio(df: DataFrame, rate: int = RATE) -> DataFrame:
    """df without content, with samples (array<float>), sample_rate, and status 400 and error for bad audio."""
    kept = [c for c in df.columns if c not in ("content", "samples", "sample_rate", "status", "error")]
    schema = df.select(*kept).withColumns({"samples": F.lit(None).cast("array<float>"), "sample_rate": F.lit(rate), "status": F.lit(None).cast("int"), "error": F.lit(None).cast("string")}).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [decode_wav(x, rate) for x in part["content"]]
            bad = pd.array([400 if e else None for _, e in found], dtype="Int32")
            yield part[kept].assign(samples=[a for a, _ in found], sample_rate=np.int32(rate), status=bad, error=[e for _, e in found])

    return df.select(*kept, "content").mapInPandas(run, schema)


def weight(column: str, df: DataFrame) -> Column:
    """Bytes of audio, or characters of a prompt's messages, in a column of df."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("array<struct"):
        found = F.aggregate(column, F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))
    else:
        found = F.size(column) * 4 if kind.startswith("array") else F.length(column)
    return F.coalesce(found, F.lit(0)).cast("long")


def tasks_for(df: DataFrame, chars: str) -> int:
    """Tasks of about REGROUP_CHARS for df's rows, whose characters are in a column, so that a task doesn't grow with the input; small inputs go to all cores."""
    total = df.agg(F.sum(F.col(chars) + ROW_CHARS)).first()[0] or 0
    return max(1, -(-total // max(1, min(REGROUP_CHARS, total // df.sparkSession.sparkContext.defaultParallelism))))


def dealt(df: DataFrame, model: str, key: str, heavy: Column, per_task: int, cleanup: list[Callable[[], object]] | None = None, sized: DataFrame | None = None) -> DataFrame:
    """df's rows, each model's in tasks of about ``per_task`` of the weight ``heavy``, those of like weight together.

    The weights are summed by model and by shares of hashed keys, SHARES to a task's work, and running sums over the shares number
    the tasks: they grow with the weight of a model's rows, and a task has at most one share more than others, unless a
    single row is heavier. Small inputs are dealt over all cores. Only keys and weights are read for this, and
    what reaches the driver is a total for each model. Null models count as one. What deletes the table of shares is added to
    ``cleanup``, which a caller may run once the result is written.
    """
    spark = df.sparkSession
    name = F.coalesce(F.col(model), F.lit(""))
    # rows (model, key, weight) that are known already spare a pass over df
    told = df.withColumn("_weight", heavy) if sized is None else sized.withColumn("_weight", F.col("weight"))
    sized = written(told.select(name.alias("_model"), F.xxhash64(key).alias("_hash"), (F.col("_weight") + 1).alias("_weight")))
    totals = {r["_model"]: r["n"] for r in sized.groupBy("_model").agg(F.sum("_weight").alias("n")).collect()}
    if not totals:
        return df
    each = max(1, min(per_task, sum(totals.values()) // spark.sparkContext.defaultParallelism))
    tasks = {m: -(-n // each) for m, n in totals.items()}
    first, count = {}, 0
    for m, n in tasks.items():
        first[m], count = count, count + n
    numbers = lambda values, m: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[m]
    share = lambda m, h: F.pmod(h, numbers({k: n * SHARES for k, n in tasks.items()}, m))
    by_share = sized.groupBy("_model", share(F.col("_model"), F.col("_hash")).alias("_share")).agg(F.sum("_weight").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_model").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = before + F.col("n") / 2
    own = numbers(first, F.col("_model")) + F.least(F.floor(middle * numbers(tasks, F.col("_model")) / numbers(totals, F.col("_model"))), numbers(tasks, F.col("_model")) - 1)
    placed = written(by_share.select("_model", "_share", own.cast("int").alias("_task")))
    dropped(sized)
    if cleanup is not None:
        cleanup.append(lambda: dropped(placed))
    asked = df.withColumns({"_model": name, "_share": share(name, F.xxhash64(key)), "_weight": heavy})
    found = asked.join(small(placed), ["_model", "_share"], "left").withColumn("_task", F.coalesce("_task", F.pmod("_share", F.lit(count)), F.lit(0)).cast("int")).repartitionById(count, "_task")
    return found.sortWithinPartitions("_model", "_weight").select(*df.columns)


def _text(found: object) -> tuple[str | None, int | None, str | None]:
    """(text, status, error) of what an engine gave, which may be anything."""
    if not isinstance(found, str):
        return None, 502, f"engine gave {type(found).__name__} for a text"
    try:
        found.encode()
    except UnicodeEncodeError:
        return None, 502, "engine gave a text with lone surrogates"
    return found, None, None


def _error(error: Exception) -> tuple[str | None, int | None, str | None]:
    return None, 502, f"{type(error).__name__}: {error}".encode("utf-8", "replace").decode()


def _sounds(column: pa.Array, rate: int) -> list[tuple[Any, str | None]]:
    """(audio, error): binary values are WAV files, lists are samples, other values are given as they are."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return [decode_wav(x, rate) for x in column.to_pylist()]
    if pa.types.is_list(column.type):
        return [(x.values.to_numpy(zero_copy_only=False) if x.is_valid else None, None) for x in column]
    return [(x, None) for x in column.to_pylist()]


def _answers(engines: dict, name: str | None, kind: str, method: str, calls: list[tuple]) -> list[tuple[str | None, int | None, str | None]]:
    """(text, status, error) of each call; an engine's failure is the call's, not the job's."""
    if name not in engines:
        return [(None, 502, f"unknown model: {name}")] * len(calls)
    found = []
    try:
        engine = _engine(engines, name, kind)
        if hasattr(engine, f"{method}_all"):
            return [_text(x) for x, _ in zip(getattr(engine, f"{method}_all")(calls), calls, strict=True)]
    except Exception as error:
        return [_error(error)] * len(calls)
    for call in calls:
        try:
            found.append(_text(getattr(engine, method)(*call)))
        except Exception as error:
            found.append(_error(error))
    return found


def _results(asked: list[tuple[str | None, tuple | None, str | None]], engines: dict, kind: str, method: str) -> list[tuple[str | None, int | None, str | None]]:
    """Results of (model, call, error) in their order, model by model; an error of its own is status 400."""
    found: list = [None if error is None else (None, 400, error) for _, _, error in asked]
    for name in dict.fromkeys(m for m, _, e in asked if e is None):
        at = [i for i, (m, _, e) in enumerate(asked) if e is None and m == name]
        for i, got in zip(at, _answers(engines, name, kind, method, [asked[i][1] for i in at]), strict=True):
            found[i] = got
    return found


def _access(x: dict) -> dict:
    return {"api_key": x.get("api_key"), "base_url": x.get("base_url")}


def answers(asked: list[tuple[str | None, list]], engines: dict) -> list[tuple[str | None, int | None, str | None]]:
    """(text, status, error) of each (model, messages), those of one model asked together; engines are ``marked``."""
    return _results([(m, (said, None, _access({})), None) for m, said in asked], engines, "llm", "chat")


def transcribe(df: DataFrame, engines: Engines, audio: str = "samples", rate: int = RATE, key: str = "recording_id", size: str | None = None, cleanup: list[Callable[[], object]] | None = None) -> DataFrame:
    """One row for each of ``slots`` (array of slot_no, model, language, api_key, base_url) of df's rows.

    df's other columns but audio, with slot_no, model, language, and text, or status and error: 400 for
    audio that can't be decoded, 502 for what an engine didn't do. Credentials reach the engines only. ``size``: a column
    of df with the bytes of the audio, so that calls are dealt without reading it.
    """
    known = marked(engines)
    own = {"slot_no": "int", "model": "string", "language": "string", "text": "string", "status": "int", "error": "string"}
    kept = [c for c in df.columns if c not in (audio, "slots", "_engines", *own)]
    schema = df.select(*kept).withColumns({n: F.lit(None).cast(t) for n, t in own.items()}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PORTION):
                batch = whole.slice(at, PORTION)
                sounds, slots = _sounds(batch.column(len(kept) + 1), rate), batch.column(len(kept)).to_pylist()
                each = [(i, s) for i, found in enumerate(slots) for s in found or []]
                asked = [(s["model"], (sounds[i][0], rate, s["language"], _access(s)), sounds[i][1]) for i, s in each]
                got = _results(asked, known, "stt", "transcribe")
                rows = pa.array([i for i, _ in each], pa.int64())
                columns = [[s[c] for _, s in each] for c in ("slot_no", "model", "language")] + [[g[k] for g in got] for k in range(3)]
                kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(kept))), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*kept, *own])

    models = F.array_join(F.array_sort(F.array_distinct(F.transform("slots", lambda s: F.coalesce(s["model"], F.lit(""))))), ",")
    asked = df.select(*kept, "slots", audio, models.alias("_engines"))
    heavy = (F.coalesce(F.col(size), F.lit(0)).cast("long") if size else weight(audio, df)) * F.greatest(F.size("slots"), F.lit(1))
    return dealt(asked, "_engines", key, heavy, TASK_BYTES, cleanup).mapInArrow(run, schema)


def _reply(df: DataFrame, engines: Engines, method: str, audio: str | None, rate: int, model: str, key: str, cleanup: list[Callable[[], object]] | None, sized: DataFrame | None = None, size: str | None = None) -> DataFrame:
    """df without messages, audio and credentials, with reply, status and error."""
    known = marked(engines)
    used = [c for c in ("messages", "params", "api_key", "base_url") if c in df.columns] + ([audio] if audio else [])
    kept = [c for c in df.columns if c not in (*used, size, "reply", "status", "error")]
    schema = df.select(*kept).withColumns({"reply": F.lit(None).cast("string"), "status": F.lit(None).cast("int"), "error": F.lit(None).cast("string")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PORTION):
                batch = whole.slice(at, PORTION)
                told = batch.select([c for c in used if c != audio]).to_pylist()
                sounds = _sounds(batch.column(audio), rate) if audio else [(None, None)] * batch.num_rows
                asked = []
                for name, x, (sound, error) in zip(batch.column(model).to_pylist(), told, sounds, strict=True):
                    heard = (sound,) if audio else ()
                    asked.append((name, (x["messages"], *heard, x.get("params"), _access(x)), error))
                got = _results(asked, known, "llm", method)
                kinds = (pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds))], [*kept, "reply", "status", "error"])

    heavy, each = (F.coalesce(F.col(size), F.lit(0)).cast("long") if size else weight(audio, df), TASK_BYTES) if audio else (weight("messages", df), TASK_CHARS)
    return dealt(df.select(*kept, *([size] if size else []), *used), model, key, heavy, each, cleanup, sized).mapInArrow(run, schema)


def chat(df: DataFrame, engines: Engines, model: str = "llm_model", key: str = "recording_id", cleanup: list[Callable[[], object]] | None = None, sized: DataFrame | None = None) -> DataFrame:
    """df (messages, a model, and params, api_key, base_url if wanted) with reply, or status 502 and error.

    sized: rows (model, key, weight) of df's calls, if they are at hand, so that df isn't read for its weights.
    """
    return _reply(df, engines, "chat", None, RATE, model, key, cleanup, sized)


def chat_audio(df: DataFrame, engines: Engines, audio: str = "samples", model: str = "llm_model", key: str = "recording_id", rate: int = RATE, size: str | None = None, cleanup: list[Callable[[], object]] | None = None) -> DataFrame:
    """As chat(), with the recording, and ``size`` as in transcribe(). Engines without chat_audio are text-only and give an error row."""
    return _reply(df, engines, "chat_audio", audio, rate, model, key, cleanup, size=size)


def fail_recordings(df: DataFrame, key: str = "recording_id", on_slot_error: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(rows to go on with, one reject for each recording with a failed slot).

    With 'skip' only the failed slots go, and a recording is never rejected for them.
    """
    good, bad = df.filter("status is null").drop("status", "error"), df.filter("status is not null")
    if on_slot_error == "skip":
        return good, bad.limit(0).select(key, "status", "error")
    rejects = bad.groupBy(key).agg(F.min_by("status", "slot_no").alias("status"), F.min_by("error", "slot_no").alias("error"))
    return good.join(rejects.select(key), key, "left_anti"), rejects

