"""Retry delays inside the payloads of errors, at any depth."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: a delay as a value, and in the text of a message.
DELAY_VALUE, DELAY_MESSAGE = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(?:s|sec|seconds)?\s*$", r"(?i)retryDelay['\"]?\s*:\s*'?(\d+(?:\.\d+)?)s"
_VALUE = re.compile(DELAY_VALUE)


def delay_seconds(value) -> float | None:
    """Seconds of a number, at least 0, or of a text with or without a unit; else none."""
    if isinstance(value, (int, float)):
        return max(0.0, float(value))
    found = _VALUE.match(value) if isinstance(value, str) else None
    return float(found[1]) if found else None


def first_delay(payload) -> float | None:
    """The first delay in order: an object's own, then those in its ``details`` (where that is a list); those of a list's items."""
    waiting = [payload]
    while waiting:
        at = waiting.pop()
        if isinstance(at, dict):
            if (own := delay_seconds(at.get("retryDelay"))) is not None:
                return own
            at = at.get("details")
        if isinstance(at, list):
            waiting += reversed(at)
    return None


def payload_delay(payload: Column) -> Column:
    """Seconds that a payload (JSON) asks to wait; null where it says nothing, or isn't JSON.

    A text that stands at the top is read by path; only payloads that say more, or say it deeper, are walked, by Arrow batches.
    """

    @F.pandas_udf("double")
    def walked(payloads: pd.Series) -> pd.Series:
        def walk(text: str | None) -> float | None:
            try:
                return None if text is None else first_delay(json.loads(text))
            except (ValueError, RecursionError):
                return None

        return payloads.map(walk).astype("float64")

    top = F.try_variant_get(F.try_parse_json(payload), "$.retryDelay", "variant")
    said = F.when(F.schema_of_variant(top) == "STRING", F.nullif(F.regexp_extract(top.cast("string"), DELAY_VALUE, 1), F.lit("")).try_cast("double"))
    deeper = F.when(said.isNull() & F.contains(payload, F.lit("retryDelay")), payload)
    return F.coalesce(said, F.nanvl(walked(deeper), F.lit(None).cast("double")))
