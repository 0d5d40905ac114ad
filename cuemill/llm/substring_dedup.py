"""Substring dedup: passages that came before, anywhere in the corpus, are removed.

Units are lines, paragraphs and sentences; what is hashed are *spans* of words:

* every whole line and every whole paragraph of at least ``line_words`` words;
* from every beginning of a sentence, as few whole sentences as give ``min_words`` words, and from
  every end of a sentence the same backwards.  So each repeated passage of whole sentences is covered to its
  ends, whatever stands before and behind it in its line, and short sentences that many
  documents share by chance don't count alone.

A sentence begins at the beginning of a text, after a word that ends in ``.``, ``!`` or ``?``, after a blank
line, and with a word in upper case (so that a passage that was set into another sentence begins where it
began).  Spans are normalised: A-Z in lower case, white space as one space.  Digests are grouped
over all documents, the earliest occurrence (doc_id, place) stays, and the words of all other occurrences are
removed, each with the white space behind it.  Of each removed word the same word of an earlier span
stays, so nothing goes without one occurrence being left.

Tasks read texts once.  A task keeps the earliest occurrence of what it has read for the
shuffle and knows all others to be removed; so a digest of very many spans is no large group.
Digests travel in packed columns, by ranges of digests; there is a range for every ``RANGE_BYTES`` of text, and
one for every shuffle partition at least, so that what a task holds is bounded whatever the session's settings.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .vocabularies import kept

#: Words of a span of sentences, and of a line or paragraph, at least.
MIN_WORDS, LINE_WORDS = 20, 5
#: Spans that a task holds before it hands them on, and words whose hashes it remembers.
HELD_SPANS, REMEMBERED = 1 << 19, 250_000
#: Bytes of text whose digests make a range: some three million spans in running text.
RANGE_BYTES = 128 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), list(b".!?"))
#: Code points of upper-case letters.
_UPPER = np.array([unicodedata.category(chr(c)) == "Lu" for c in range(min(sys.maxunicode, 0x1FFFF) + 1)])
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Stands for a null id, and ranks first.
_NO_ID = -(1 << 63)


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word."""
    known = kept("word digests", lambda: ({}, [np.zeros((1 << 16, 2), np.uint64)]))
    at, table = known
    if len(at) > REMEMBERED:
        at.clear()
    for w in set(words).difference(at):
        if len(at) == len(table[0]):
            table[0] = np.concatenate([table[0], np.zeros_like(table[0])])
        table[0][len(at)] = xxhash.xxh64_intdigest(w, 1), xxhash.xxh64_intdigest(w, 2)
        at[w] = len(at)
    rows = table[0][np.fromiter(map(at.__getitem__, words), np.int64, len(words))]
    return rows[:, 0], rows[:, 1]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _BASES[0]
    x = (x ^ (x >> np.uint64(29))) * _BASES[1]
    return x ^ (x >> np.uint64(32))


def _runs(fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the units that begin where ``fresh`` is true."""
    first = np.flatnonzero(fresh)
    return first, np.append(first[1:], len(fresh))


def spans(texts: list[bytes], min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> dict[str, np.ndarray]:
    """doc (number of the text), start and end (code points; the end is where the next word begins, or the text ends), d1, d2 of all spans."""
    data = b"\n\n".join([*texts, b""])
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    begin = np.flatnonzero(~space & np.append(True, space[:-1])) if len(raw) else np.zeros(0, np.int64)
    if not len(begin):
        return {k: np.zeros(0, t) for k, t in (("doc", np.int64), ("start", np.int64), ("end", np.int64), ("d1", np.uint64), ("d2", np.uint64))}
    stop = np.append(begin[1:], len(raw))  # where the next word begins
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    doc_begin = np.cumsum(sizes) - sizes
    doc = np.searchsorted(doc_begin, begin, "right") - 1
    fresh_doc = np.append(True, doc[1:] != doc[:-1])
    # line breaks before each word, sentence ends before it, upper case at its beginning
    breaks = np.cumsum(raw == 10, dtype=np.int32)[begin]
    lines = np.append(0, np.diff(breaks))
    last = np.flatnonzero(~space & np.append(space[1:], True))
    b = [raw[np.minimum(begin + i, len(raw) - 1)].astype(np.int64) for i in range(4)]
    two, three, four = ((b[0] & 31) << 6) | (b[1] & 63), ((b[0] & 15) << 12) | ((b[1] & 63) << 6) | (b[2] & 63), ((b[0] & 7) << 18) | ((b[1] & 63) << 12) | ((b[2] & 63) << 6) | (b[3] & 63)
    point = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four)))
    sentence = fresh_doc | np.append(True, _STOP[raw[last[:-1]]]) | (lines > 1) | _UPPER[np.minimum(point, len(_UPPER) - 1)]
    first, end = _runs(sentence)
    doc_first, doc_end = _runs(fresh_doc)
    n_docs = np.cumsum(fresh_doc) - 1
    found = []
    j = np.searchsorted(end, first + min_words)
    ok = j < len(end)
    ok[ok] = end[j[ok]] <= doc_end[n_docs[first[ok]]]
    found.append((first[ok], end[j[ok]]))
    i = np.searchsorted(first, end - min_words, "right") - 1
    ok = i >= 0
    ok[ok] = first[i[ok]] >= doc_first[n_docs[end[ok] - 1]]
    found.append((first[i[ok]], end[ok]))
    for least in (1, 2):  # lines, paragraphs
        a, e = _runs(fresh_doc | (lines >= least))
        ok = e - a >= line_words
        found.append((a[ok], e[ok]))
    pairs = np.unique(np.concatenate([a.astype(np.uint64) << np.uint64(32) | e.astype(np.uint64) for a, e in found]))
    a, e = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    out = {"doc": doc[a]}
    words = data.translate(_LOWER).split()
    for name, base, h in zip(("d1", "d2"), _BASES, _hashes(words)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(base, len(words))[:-1])])
        inverse = _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(words))
        out[name] = _mixed((sums[e] - sums[a]) * inverse[a])
    # code points before a byte, within its text
    points = np.zeros(len(raw) + 1, np.int32)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    ends = np.minimum(stop[e - 1], (doc_begin + sizes - 2)[doc[a]])
    return out | {"start": points[begin[a]] - points[doc_begin[doc[a]]], "end": points[ends] - points[doc_begin[doc[a]]]}


_COLUMNS = (("d1", "<u8"), ("d2", "<u4"), ("doc", "<u4"), ("start", "<u4"), ("length", "<u4"))


def _packed(columns: dict[str, np.ndarray], ids: np.ndarray, fps: np.ndarray) -> bytes:
    """The columns byte by byte (high bytes are mostly zeros, which compression takes), behind the documents that they are of."""
    used, doc = np.unique(columns["doc"], return_inverse=True)
    parts = [np.array([len(doc), len(used)], "<u8").tobytes()]
    for values, kind in [(ids[used], "<i8"), (fps[used], "<i8"), *((doc if name == "doc" else columns[name], kind) for name, kind in _COLUMNS)]:
        values = np.ascontiguousarray(values.astype(kind))
        parts.append(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())
    return b"".join(parts)


def _unpacked(blob: bytes) -> dict[str, np.ndarray]:
    n, docs = np.frombuffer(blob, "<u8", 2).tolist()
    at, out = 16, {}
    for name, kind, rows in [("id", "<i8", docs), ("fp", "<i8", docs), *((*c, n) for c in _COLUMNS)]:
        size = np.dtype(kind).itemsize * rows
        out[name] = np.frombuffer(blob, np.uint8, size, at).reshape(-1, rows).T.copy().view(kind).ravel()
        at += size
    out["id"], out["fp"] = out["id"][out["doc"]], out["fp"][out["doc"]]
    return out


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document, sorted, those that overlap or touch as one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    reach = np.maximum.accumulate(end + doc * (1 << 33)) - doc * (1 << 33) if len(doc) else end
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1]))[: len(doc)]
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(doc) - 1)[: fresh.sum()]
    return doc[fresh], start[fresh], reach[last]


def _later(fresh: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Of rows sorted by digest and place, those that are another occurrence than the first of their digest; repeats of a row are the same one."""
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    return np.logical_or.reduce([x != x[first] for x in place])


def span_rows(rows: DataFrame, min_words: int, line_words: int, ranges: int) -> DataFrame:
    """bucket (range of digests; below 0: spans known to be removed), spans (packed): what tasks hand on. rows: doc, fp, text."""

    def handed_on(held: list[dict[str, np.ndarray]], ids: np.ndarray, fps: np.ndarray):
        all_ = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        doc, start = all_["doc"], all_["start"]
        order = np.lexsort((start, fps[doc], ids[doc], all_["d2"], all_["d1"]))
        all_ = {k: v[order] for k, v in all_.items()}
        fresh = np.append(True, (all_["d1"][1:] != all_["d1"][:-1]) | (all_["d2"][1:] != all_["d2"][:-1]))[: len(order)]
        later = _later(fresh, ids[all_["doc"]], fps[all_["doc"]], all_["start"])
        gone = _merged(all_["doc"][later], all_["start"][later], (all_["start"] + all_["length"])[later])
        all_ = {k: v[fresh] for k, v in all_.items()}
        bucket = ((all_["d1"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        bounds = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]).tolist()
        for a, b in zip(bounds, [*bounds[1:], len(bucket)]):
            yield int(bucket[a]), _packed({k: v[a:b] for k, v in all_.items()}, ids, fps)
        for a in range(0, len(gone[0]), 1 << 16):
            doc, start, end = (x[a : a + (1 << 16)] for x in gone)
            none = np.zeros(len(doc), np.uint64)
            yield -1 - int(ids[doc[0]]) % ranges, _packed({"d1": none, "d2": none, "doc": doc, "start": start, "length": end - start}, ids, fps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, fps, n, n_docs = [], [], [], 0, 0

        def batch_of():
            for bucket, blob in handed_on(held, np.concatenate(ids), np.concatenate(fps)):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "spans"])

        for batch in batches:
            got = spans(batch.column("text").cast(pa.binary()).to_pylist(), min_words, line_words)
            held.append({"d1": got["d1"], "d2": got["d2"] & np.uint64(0xFFFFFFFF), "doc": got["doc"] + n_docs, "start": got["start"], "length": got["end"] - got["start"]})
            ids.append(batch.column("doc").fill_null(_NO_ID).to_numpy())
            fps.append(batch.column("fp").to_numpy())
            n, n_docs = n + len(got["d1"]), n_docs + batch.num_rows
            if n >= HELD_SPANS:
                yield from batch_of()
                held, ids, fps, n, n_docs = [], [], [], 0, 0
        if n:
            yield from batch_of()

    return rows.mapInArrow(run, "bucket long, spans binary")


def removed_spans(handed: DataFrame) -> DataFrame:
    """doc, fp, start, end of all spans that came before."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x) for x in table.column("spans").to_pylist()]
        x = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        gone = np.ones(len(x["id"]), bool)
        if table.column("bucket")[0].as_py() >= 0:
            order = np.lexsort((x["start"], x["fp"], x["id"], x["d2"], x["d1"]))
            x = {k: v[order] for k, v in x.items()}
            fresh = np.append(True, (x["d1"][1:] != x["d1"][:-1]) | (x["d2"][1:] != x["d2"][:-1]))
            gone = _later(fresh, x["id"], x["fp"], x["start"])
        start = x["start"][gone].astype(np.int32)
        return pa.table({"doc": pa.array(x["id"][gone]), "fp": pa.array(x["fp"][gone]), "start": pa.array(start), "end": pa.array(start + x["length"][gone].astype(np.int32))})

    return handed.groupBy("bucket").applyInArrow(run, "doc long, fp long, start int, end int")


def cut(text: str, gone: list[tuple[int, int]]) -> tuple[str, list[dict[str, int]]]:
    """What is left of a text, and the ranges of words removed from it, without the white space behind them."""
    merged: list[list[int]] = []
    for start, end in sorted(gone):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    left, at, removed = [], 0, []
    for start, end in merged:
        left.append(text[at:start])
        at = end
        removed.append({"start": start, "end": start + len(text[start:end].rstrip("\t\n\x0b\x0c\r "))})
    left.append(text[at:])
    out = "".join(left)
    return (out.rstrip("\t\n\x0b\x0c\r ") if not text[at:].strip("\t\n\x0b\x0c\r ") else out), removed


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text cut, and removed_units (array of start and end in code points of the original text).

    A null text stays null, with nothing removed; so does an empty one, or one of white space.  Where the end of a text
    is removed, the white space before it goes too.  A null id ranks before all
    others.  Rows with the same id and text are the same document: they are ranked once and get the same
    result.  An empty table gives an empty table.  Texts are taken whole, however long.
    Columns named like the ones used inside don't clash: the rows' own columns are held in one struct.  A column
    removed_units of ``docs`` gives way to the result's.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("fp", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(partitions, -(-size // RANGE_BYTES))
    handed = span_rows(rows.where(F.length("text") > 0).select("doc", "fp", "text"), min_words, line_words, ranges)
    if ranges > partitions:  # else Spark's own shuffle, which adaptive execution may coalesce
        handed = handed.repartition(ranges, "bucket")
    gone = removed_spans(handed).groupBy("doc", "fp").agg(F.collect_set(F.struct("start", "end")).alias("gone"))
    gone = gone.select(F.col("doc").alias("g_doc"), F.col("fp").alias("g_fp"), "gone")
    out = rows.join(gone, (F.coalesce("doc", F.lit(_NO_ID)) == F.col("g_doc")) & (F.col("fp") == F.col("g_fp")), "left")

    @F.arrow_udf("struct<text:string,removed:array<struct<start:int,end:int>>>")
    def cut_all(texts: pa.Array, gone: pa.Array) -> pa.Array:
        kind = pa.struct([("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        found = ((t, r) if r is None else cut(t, [(x["start"], x["end"]) for x in r]) for t, r in zip(texts.to_pylist(), gone.to_pylist()))
        return pa.array([{"text": t, "removed": r} for t, r in found], kind)

    # a deterministic function would run a second time, in a second Python worker of each task, for a filter on its result
    done = out.withColumn("cut", cut_all.asNondeterministic()(F.when(F.col("gone").isNotNull(), F.col("text")), F.col("gone")))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.col("cut.text")).alias(text_col)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return done.select(*[text if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != "removed_units"], F.coalesce("cut.removed", none).alias("removed_units"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (what is left), n_removed, removed (``start-end`` of each removed range, comma-joined)."""
    done = substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    span = F.transform("removed_units", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return done.select("doc_id", "text", F.size("removed_units").cast("long").alias("n_removed"), F.array_join(span, ",").alias("removed"))


_WS = r"\x20\x09-\x0D"
ORACLE_SQL = rf"""
WITH texts AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS d, * FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text <> '') x),
pieces AS (
  SELECT d, unnest(p) AS piece, generate_subscripts(p, 1) AS k, length(text) - length(regexp_replace(text, '^[{_WS}]+', '')) AS lead
  FROM (SELECT d, text, regexp_extract_all(text, '[^{_WS}]+[{_WS}]*') AS p FROM texts) x),
words AS (
  SELECT *, regexp_replace(piece, '[{_WS}]+$', '') AS w, lead + coalesce(sum(length(piece)) OVER (PARTITION BY d ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pieces),
marked AS (
  SELECT *, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, coalesce(lag(length(piece) - length(replace(piece, chr(10), ''))) OVER (PARTITION BY d ORDER BY k), 9) AS breaks,
         k = 1 OR regexp_matches(w, '^\p{{Lu}}') OR regexp_matches(lag(w) OVER (PARTITION BY d ORDER BY k), '[.!?]$') AS own
  FROM words),
numbered AS (
  SELECT *, sum(CASE WHEN own OR breaks > 1 THEN 1 ELSE 0 END) OVER o AS sentence, sum(CASE WHEN breaks > 0 THEN 1 ELSE 0 END) OVER o AS line, sum(CASE WHEN breaks > 1 THEN 1 ELSE 0 END) OVER o AS para
  FROM marked WINDOW o AS (PARTITION BY d ORDER BY k)),
sentences AS (SELECT d, sentence, min(k) AS a, max(k) + 1 AS e FROM numbered GROUP BY ALL),
spans AS (
  SELECT s.d, s.a, t.e FROM sentences s ASOF JOIN sentences t ON s.d = t.d AND s.a + {MIN_WORDS} <= t.e
  UNION SELECT s.d, t.a, s.e FROM sentences s ASOF JOIN sentences t ON s.d = t.d AND s.e - {MIN_WORDS} >= t.a
  UNION SELECT d, min(k), max(k) + 1 FROM numbered GROUP BY d, line HAVING count(*) >= {LINE_WORDS}
  UNION SELECT d, min(k), max(k) + 1 FROM numbered GROUP BY d, para HAVING count(*) >= {LINE_WORDS}),
lists AS (SELECT d, list(low ORDER BY k) AS ws FROM numbered GROUP BY d),
again AS (
  SELECT d, a, e FROM (SELECT s.d, a, e, row_number() OVER (PARTITION BY array_to_string(ws[a : e - 1], ' ') ORDER BY s.d, a) AS nth FROM spans s JOIN lists USING (d)) x WHERE nth > 1),
reach AS (SELECT d, a, max(e) AS e FROM again GROUP BY d, a),
judged AS (SELECT n.*, coalesce(max(r.e) OVER (PARTITION BY n.d ORDER BY n.k) > n.k, false) AS gone FROM numbered n LEFT JOIN reach r ON r.d = n.d AND r.a = n.k),
islands AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY d ORDER BY k) AS island FROM judged),
ranges AS (SELECT d, min(start) AS s, arg_max(start + length(w), k) AS e FROM islands WHERE gone GROUP BY d, island),
listed AS (SELECT d, count(*) AS n, string_agg(CAST(s AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY s) AS removed FROM ranges GROUP BY d),
left_over AS (SELECT d, any_value(lead) AS lead, coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE NOT gone), '') AS kept, arg_max(gone, k) AS at_end FROM judged GROUP BY d),
cut AS (
  SELECT t.doc_id, t.text, n, removed, CASE WHEN at_end THEN regexp_replace(left(t.text, lead) || kept, '[{_WS}]+$', '') ELSE left(t.text, lead) || kept END AS kept
  FROM texts t JOIN listed USING (d) JOIN left_over USING (d))
SELECT o.doc_id, coalesce(kept, o.text) AS text, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents o LEFT JOIN cut c ON o.doc_id IS NOT DISTINCT FROM c.doc_id AND o.text = c.text
"""
