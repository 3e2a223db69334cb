"""Replies of models: text out of a response, a report out of a text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechreport.sources.schemas import REPORT_KEYS

#: Where each response shape holds its text.
PATHS = {
    "transcription": "$.text",
    "local": "$.reply",
    "chat": "$.choices[0].message.content",
    "inline": "$.candidates[0].content.parts[0].text",
}


def reply_text(body: Column, shape: str) -> Column:
    """The text of a response body; null if it isn't there."""
    return F.get_json_object(body, PATHS[shape])


def json_slice(reply: Column) -> Column:
    """The part of a reply that should be JSON: inside the first fence if there is one, from the first
    to the last brace; '' if there is none."""
    body = F.when(F.contains(reply, F.lit("```")), F.get(F.split(reply, "```", 3), F.lit(1))).otherwise(reply)
    return F.regexp_extract(body, r"(?s)\{.*\}", 0)


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _report(piece: str | None) -> dict | None:
    """The parts of a report, or None for what isn't one: no object, too deep for the parser, or with lone surrogates, which are no text."""
    try:
        found = json.loads(piece or "")
        if not isinstance(found, dict):
            return None
        own = {}
        for k in REPORT_KEYS:
            value = found.get(k)
            own[k] = ([_text(x) for x in value] if isinstance(value, list) else None if value is None else [_text(value)]) if k == "discrepancies_found" else _text(value)
        told = {"report": own, "present_keys": list(found), "extra": [(k, _text(v)) for k, v in found.items() if k not in REPORT_KEYS]}
        json.dumps(found, ensure_ascii=False).encode()
    except (ValueError, RecursionError):
        return None
    return told


def extract_json(df: DataFrame, reply: str = "reply") -> DataFrame:
    """df with report, present_keys and extra from the reply, or status 502 and error.

    The slice is cut by Catalyst; json.loads decides in an Arrow stage, as only it keeps to the
    rules: text after the object is an error, NaN is not, of repeated keys the last one counts.
    """
    kept = [c for c in df.columns if c not in ("report", "present_keys", "extra", "status", "error")]
    fields = ", ".join(f"{k}: {'array<string>' if k == 'discrepancies_found' else 'string'}" for k in REPORT_KEYS)
    empty = df.select(*kept).withColumns({"report": F.lit(None).cast(f"struct<{fields}>"), "present_keys": F.lit(None).cast("array<string>"), "extra": F.lit(None).cast("map<string,string>"), "status": F.lit(None).cast("int"), "error": F.lit(None).cast("string")})
    report = pa.struct([(k, pa.list_(pa.string()) if k == "discrepancies_found" else pa.string()) for k in REPORT_KEYS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_report(x) for x in batch.column(len(kept)).to_pylist()]
            get = lambda k: [f and f[k] for f in found]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), pa.array(get("report"), report), pa.array(get("present_keys"), pa.list_(pa.string())), pa.array(get("extra"), pa.map_(pa.string(), pa.string())),
                 pa.array([None if f else 502 for f in found], pa.int32()), pa.array([None if f else "reply is not valid JSON" for f in found], pa.string())],
                [*kept, "report", "present_keys", "extra", "status", "error"],
            )

    return df.select(*kept, json_slice(F.col(reply)).alias("_piece")).mapInArrow(run, empty.schema)
