"""Text helpers with Unicode-aware trimming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def truncated(text: Column, limit: int) -> Column:
    """Stripped; longer texts are cut three short of the limit and end in dots."""
    s = strip(text)
    return F.when(F.length(s) > limit, F.concat(F.regexp_replace(F.left(s, F.lit(limit - 3)), r"(?U)\s+$", ""), F.lit("..."))).otherwise(s)


def preview(text: Column, limit: int = 80) -> Column:
    """Like truncated, but neither stripped before nor after the cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition."""
    return texts.str.normalize("NFC")


@F.pandas_udf(StringType())
def decode_legacy(contents: pd.Series) -> pd.Series:
    """Bytes by the first of the charsets that fits; the last always does."""

    def one(raw):
        if raw is None:
            return None
        for charset in ("utf-8-sig", "utf-8", "cp949", "euc-kr"):
            try:
                return bytes(raw).decode(charset)
            except UnicodeDecodeError:
                continue
        return bytes(raw).decode("iso-8859-1")

    return contents.map(one)


#: Fixed characters that file names don't keep.
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'


def sanitized_filename(name: Column, fallback: str = "file", normalize: bool = True) -> Column:
    """Base name, composed, without forbidden characters and leading dots, at most 255 long; if nothing is left, the fallback."""
    base = strip(F.regexp_extract(F.regexp_replace(name, r"\\", "/"), r"([^/]*)$", 1))
    base = nfc(base) if normalize else base
    clean = strip(F.regexp_replace(base, FORBIDDEN, "_"))
    clean = F.left(F.regexp_replace(clean, r"^\.+", ""), F.lit(255))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def label(text: Column) -> Column:
    """Runs of anything but letters, digits, _ and - become -; at most 80; never empty."""
    return F.coalesce(F.nullif(F.left(F.regexp_replace(text, r"[^A-Za-z0-9_-]+", "-"), F.lit(80)), F.lit("")), F.lit("session"))
