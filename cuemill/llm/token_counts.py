"""Token counts of whole texts, equal to what the tokenizer gives for the text in one piece.

Byte-level pre-tokenisation never puts white space after anything else into one token: a
place with white space on its right and none on its left is a token boundary whatever
stands further away, and both sides are encoded as if they stood alone (*stable boundary*).

* Texts of ordinary length: the text falls into units at its stable boundaries before
  spaces and newlines; a unit is encoded once a worker and its count remembered.
* Huge texts: overlapping chunks are encoded with offsets.  Two neighbours are spliced at a
  stable boundary inside their overlap that both encodings have; the last such one is
  taken.  Where the overlap has none, it is widened until it has, or the text ends.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text, map_texts
from .vocabularies import REMEMBERED, kept, load_tokenizer, vocabulary

#: Texts of more characters than this are encoded in overlapping chunks (a quarter of all text in the check tool's tables).
HUGE_CHARS = 1 << 14
CHUNK_CHARS = 1 << 13
OVERLAP_CHARS = 256

#: A space or newline after other white space is no stable boundary (\\s is wider than the tokenizer's class, so this errs on the safe side).
_NOT_STABLE = re.compile(r"\s[ \n]|\x00")


def stable_boundaries(text: str, low: int, high: int) -> list[int]:
    """Places p in [low, high], low > 0, with a non-space before and a space or newline at p."""
    return [m.start() + low for m in re.finditer(r"\S(?=[ \n])", text[low - 1 : high + 1])]


def chunked_count(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Number of tokens by overlapping chunks; equal to that of the text encoded whole."""
    total, begin, length = 0, 0, len(text)
    while begin < length:
        reach, width = min(length, begin + chunk), overlap
        while True:
            # this chunk up to the end of the overlap, the next one from the start of it
            end = min(length, reach + width)
            here = tokenizer.encode(text[begin:end], add_special_tokens=False)
            if end == length:
                return total + len(here)
            there = tokenizer.encode(text[reach:end], add_special_tokens=False)
            # the character before a stable boundary is no space, so that offsets, trimmed of spaces or not, end there
            starts, ends = zip(*here.offsets)  # both ascend: only ends in the overlap are looked at
            ends_here = {begin + e for e in ends[bisect_left(ends, reach - begin) :]}
            ends_there = {reach} | {reach + o[1] for o in there.offsets}
            common = [p for p in stable_boundaries(text, reach, end - 1) if p in ends_here and p in ends_there]
            if common:
                break
            width *= 4
        cut = common[-1]
        total += bisect_left(starts, cut - begin)
        begin = cut
    return total


class UnitCounts:
    """Counts of units, remembered up to a bound."""

    def __init__(self, path: str):
        self.tokenizer, self.known = load_tokenizer(path), {}

    def learn(self, units: set[str]) -> None:
        if len(self.known) + len(units) > REMEMBERED:
            self.known = {}
        new = [u for u in units if u not in self.known]
        if new:
            self.known.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", huge_chars: int = HUGE_CHARS, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens: one row for each row of ``docs``; no shuffle.

    Null text: as empty (0 bytes, 0 tokens).  Null ids stay null; repeated rows stay repeated.
    An empty table gives an empty table.  Other columns are ignored.
    """

    def make():
        counts = kept(("units", tokenizer_path), lambda: UnitCounts(tokenizer_path))

        def work(ids, texts):
            units, direct = [None] * len(texts), {}
            for i, raw in enumerate(texts):
                text = raw.decode("utf-8", "replace")
                if len(text) > huge_chars:
                    direct[i] = chunked_count(counts.tokenizer, text, chunk_chars, overlap_chars)
                elif _NOT_STABLE.search(text):
                    direct[i] = len(counts.tokenizer.encode(text, add_special_tokens=False))
                elif text:
                    units[i] = text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")
            counts.learn({u for us in units if us for u in us})
            get = counts.known.__getitem__
            return ids, [len(t) for t in texts], [direct[i] if i in direct else sum(map(get, us)) if us else 0 for i, us in enumerate(units)]

        return work

    return map_texts(id_and_text(docs, id_col, text_col), "doc_id long, n_bytes long, n_tokens long", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
