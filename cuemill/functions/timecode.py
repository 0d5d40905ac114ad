"""Media times: ``HH:MM:SS,mmm`` and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tc_to_ms(tc: Column) -> Column:
    """Milliseconds; one comma, two colons, the part after the comma is a number of milliseconds; anything else: 0."""
    parts, clock = F.split(tc, ","), F.split(F.split(tc, ",")[0], ":")
    number = lambda x: F.trim(x).try_cast("int")
    total = (number(clock[0]) * 3600 + number(clock[1]) * 60 + number(clock[2])) * 1000 + number(parts[1])
    return F.coalesce(F.when((F.size(parts) == 2) & (F.size(clock) == 3), total), F.lit(0)).cast("double")


def tc_to_seconds(tc: Column) -> Column:
    return F.greatest(tc_to_ms(tc) / 1000, F.lit(0.0))


def _clock(ms: Column) -> Column:
    ms = ms.cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def ms_to_tc(ms: Column) -> Column:
    """Not below 0, truncated to whole milliseconds; hours may have more than two digits."""
    return _clock(F.floor(F.greatest(ms, F.lit(0.0))))


def seconds_to_tc(seconds: Column) -> Column:
    """Not below 0, rounded half to even; null: 0."""
    return _clock(F.bround(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0)) * 1000, 0))


def seconds_to_tc_truncated(seconds: Column) -> Column:
    """Whole seconds and a truncated fraction; not clamped."""
    whole = F.floor(seconds)
    return _clock(whole * 1000 + F.floor((seconds - whole) * 1000))
