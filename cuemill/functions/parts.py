"""Parts of messages: JSON objects of any shape, as text, and read by path as VARIANT.

They stay JSON text because a VARIANT forgets the order of keys, which is shown for some of them.  Messages that hold
plain texts alone, most of a history, never leave the JVM; the others go through two Arrow UDFs, whole batches at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Fixed names of kinds and fields of parts, and what they become.
KEYS = {
    "functionCall": "function_call",
    "functionResponse": "function_response",
    "inlineData": "inline_data",
    "fileData": "file_data",
    "codeExecutionResult": "code_execution_result",
    "mimeType": "mime_type",
    "videoMetadata": "video_metadata",
}


def _without_nulls(x):
    if isinstance(x, dict):
        return {k: kept for k, v in x.items() if (kept := _without_nulls(v)) is not None}
    if isinstance(x, list):
        return [kept for v in x if (kept := _without_nulls(v)) is not None]
    return x


def _normal(part: str | None) -> dict:
    try:
        read = json.loads(part or "{}")
    except (ValueError, RecursionError):
        read = {"text": part}
    known = {KEYS.get(k, k): v for k, v in read.items()} if isinstance(read, dict) else {"text": read}
    kept = _without_nulls(known)
    if "text" in kept:
        kept["text"] = str(kept["text"])
    return kept or {"text": ""}


def _plain(value, **how) -> str:
    """Objects and lists as JSON, other values as text; none: empty."""
    if isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False, **how)
    return "" if value is None else str(value)


def _shown(part: str | None) -> str:
    """The text where it isn't blank; a tagged text for parts of the known kinds; else the part as JSON. The tags are fixed texts."""
    p = _normal(part)
    if p.get("text", "").strip():
        return p["text"]
    kind = next((k for k in ("function_call", "function_response", "file_data", "inline_data", "executable_code", "code_execution_result") if k in p), "")
    of = p[kind] if kind and isinstance(p[kind], dict) else {}
    first = lambda *names: next((of[n] for n in names if of.get(n)), None)
    if kind == "function_call":
        return f"[FUNCTION_CALL] name={first('name') or ''} args={_plain(of.get('args'), sort_keys=True)}"
    if kind == "function_response":
        return f"[FUNCTION_RESPONSE] name={first('name') or ''} payload={_plain(of.get('response'))}"
    if kind == "file_data":
        return f"[FILE_DATA] uri={first('file_uri', 'uri') or 'unknown'} mime={first('mime_type', 'mimeType') or 'unknown'}"
    if kind == "inline_data":
        size = first("size_bytes") if first("size_bytes") else of.get("sizeBytes")
        return f"[INLINE_DATA] mime={first('mime_type', 'mimeType') or 'unknown'}{'' if size is None else f' size={size}'}"
    if kind == "executable_code":
        return f"[EXECUTABLE_CODE] language={first('language') or 'unknown'}"
    if kind == "code_execution_result":
        return f"[CODE_RESULT] status={first('status', 'outcome') or 'unknown'}"
    return _plain(p)


def _each(parts: Column, make: Callable[[str | None], str], is_done: Callable[[Column], Column], done: Callable[[Column], Column]) -> Column:
    """``make`` of each part, by Arrow batches; arrays all of whose parts are done natively don't go there. A null array is an empty one."""

    @F.pandas_udf("array<string>")
    def made(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda xs: None if xs is None else [make(x) for x in xs])

    parts = F.coalesce(parts, F.array().cast("array<string>"))
    native = F.forall(parts, lambda p: F.coalesce(is_done(p), F.lit(False)))
    return F.when(native, F.transform(parts, done)).otherwise(made(F.when(~native, parts)))


def part_field(part: Column, path: str, kind: str = "string") -> Column:
    """A field of a part by its path, such as ``function_call.name``; null where it isn't there or of another kind."""
    return F.try_variant_get(F.try_parse_json(part), f"$.{path}", kind)


def has_kind(part: Column, kind: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(part), kind), F.lit(False))


def text_of(part: Column) -> Column:
    """The text of a part that has one, as it is."""
    return F.get_json_object(part, "$.text")


def _text_alone(part: Column) -> Column:
    """Only a text, and not a null one."""
    return (F.json_object_keys(part) == F.array(F.lit("text"))) & (F.schema_of_variant(F.try_variant_get(F.try_parse_json(part), "$.text", "variant")) == "STRING")


def normalized_parts(parts: Column) -> Column:
    """Parts (array of JSON texts) with kinds in snake case, without nulls at any depth, texts as strings; a part of which nothing is left is an empty text.

    Where two keys become one, the later one holds.  What isn't an object becomes a text.
    """
    return _each(parts, lambda p: json.dumps(_normal(p), ensure_ascii=False), _text_alone, lambda p: p)


def part_texts(parts: Column) -> Column:
    """What is shown and counted of each part: its text, or what else it holds (arguments with sorted keys, payload, uri, mime type and size, status)."""
    return _each(parts, _shown, lambda p: _text_alone(p) & (strip(text_of(p)) != ""), text_of)


def text_part(text: Column) -> Column:
    return F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("text")))
