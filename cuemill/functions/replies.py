"""Objects with an index, found in the text of a reply that need not be whole or valid JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A brace, or quoted text (with its closing quote, where that has come).
_TOKEN = re.compile(r'[{}]|"[^"\\]*(?:\\.[^"\\]*)*("?)', re.S)
#: Fixed name of the key that marks an object.
INDEX = '"index"'


def scan_objects(buffer: str) -> tuple[list[str], str]:
    """The whole objects that have the word "index" in quotes, as text, and what must be kept until more comes.

    The object begins at the innermost brace that is open where its index stands, and ends at that brace's match: objects nested behind the index belong to
    it, and so do those before it.  Braces in quoted text don't count; outside of objects nothing is kept, quotes included.
    What stands around an object that has ended is let go.
    """
    found, open_at, marked, at = [], [], 0, 0
    while True:
        if not open_at:
            at = buffer.find("{", at)
            if at < 0:
                return found, ""
        m = _TOKEN.search(buffer, at)
        if m is None or m[1] == "":
            return found, buffer[open_at[marked - 1 if marked else 0] :]
        at = m.end()
        if m[0] == "{":
            open_at.append(m.start())
        elif m[0] == "}":
            start = open_at.pop()
            if marked and len(open_at) < marked:
                found.append(buffer[start:at])
                open_at, marked = [], 0
        elif m[0] == INDEX and not marked:
            marked = len(open_at)


def entry_of(text: str) -> tuple[int, str | None] | None:
    """Index and text of an object; None if it isn't JSON or its index is no whole number.

    Whole numbers are those that equal one (3.0, and true, which is 1); a text that is no string is its JSON; without one: null.
    """
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    index, said = found.get("index"), found.get("text")
    if not isinstance(index, (int, float)) or index != index or abs(index) >= 2**31 or index != int(index):
        return None
    return int(index), said if said is None or isinstance(said, str) else json.dumps(said, ensure_ascii=False)


def reply_entries(text: Column) -> Column:
    """Of a whole reply: its entries (entry_index, text) in order, as an array."""

    @F.pandas_udf("array<struct<entry_index:int,text:string>>")
    def entries(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [{"entry_index": e[0], "text": e[1]} for o in scan_objects(x or "")[0] if (e := entry_of(o))])

    return entries(text)
