"""Queries over cue files, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timecode as tc
from ..functions.shipping import ship_package
from ..functions.tables import shared_path
from ..operators import cues as cu
from ..sources.fixtures import view, with_views
from ..sources.named_files import read_named_files, write_named_files
from .media import _TC, DURATION_MS, _media

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, run, sql: str, *views: str) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(sql, *views)


def _v1(s, d):
    return view(s, d, "v1_cues")


def _lines(s, d):
    """V3: line k of a document as cue k."""
    docs = view(s, d, "documents").select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.trim("line") != "")
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("media_id").orderBy("at"))
    return docs.select("media_id", k.alias("pos"), k.alias("entry_index"), (k * 2000.0).alias("start_ms"), (k * 2000.0 + 1500).alias("end_ms"), F.trim("line").alias("text"))


def _files(s, d):
    return cu.export_cues(_lines(s, d)).withColumnRenamed("content", "text")


_V3 = """v3 AS (SELECT doc_id AS media_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS INT) AS pos, trim(line) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents) x WHERE trim(line) <> '')"""
_BLOCK = "concat(CAST({n} AS VARCHAR), chr(10), {s}, ' --> ', {e}, chr(10), {t}, chr(10))"


def _files_decoded(s, d):
    ship_package(s)
    raw = view(s, d, "documents").select(F.col("doc_id").alias("media_id"), F.encode("text", "UTF-8").alias("content"))
    return cu.decoded(raw).select("media_id", F.md5("text").alias("digest"))


add("src_cue_files", _files_decoded, "SELECT doc_id AS media_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
add("src_cue_text", lambda s, d: cu.strict_text(view(s, d, "documents").select(F.col("doc_id").alias("media_id"), F.encode("text", "UTF-8").alias("content"))).select("media_id", F.length("text").alias("n")), "SELECT doc_id AS media_id, length(text) AS n FROM documents")
add("parse_cues", lambda s, d: cu.parse_cues(_files(s, d)), f"WITH {_V3} SELECT media_id, pos, pos AS entry_index, {_TC('pos * 2000')} AS start, {_TC('pos * 2000 + 1500')} AS end, text FROM v3")
add("cues_to_ms", lambda s, d: cu.cues_to_ms(cu.parse_cues(_files(s, d))), f"WITH {_V3} SELECT media_id, pos, pos AS entry_index, pos * 2e3 AS start_ms, pos * 2e3 + 1500 AS end_ms, text FROM v3")
add("load_job_entries", lambda s, d: cu.load_job_entries(cu.parse_cues(_files(s, d))), f"WITH {_V3} SELECT media_id, pos AS entry_index, pos * 2e0 AS start_s, pos * 2e0 + 1.5 AS end_s, text, text AS original_text FROM v3")
_P = lambda s, e, t, n="pos", src="v1_cues", order="pos": f"SELECT media_id, string_agg({_BLOCK.format(n=n, s=s, e=e, t=t)}, chr(10) ORDER BY {order}) AS content FROM {src} GROUP BY media_id"
_TRUNC = lambda ms: _TC(f"(floor({ms} / 1000) * 1000 + floor(({ms} / 1000 - floor({ms} / 1000)) * 1000))")
add("export_cues", lambda s, d: cu.export_cues(_v1(s, d)), _P(_TC("start_ms"), _TC("end_ms"), "text", "entry_index"))
add("export_transcript", lambda s, d: cu.export_transcript(_v1(s, d)), f"SELECT media_id, concat(trim(content, concat(' ', chr(10))), chr(10)) AS content FROM ({_P(_TC('round_even(start_ms, 0)'), _TC('round_even(end_ms, 0)'), 'text')}) x", "v1_cues")
add("export_asr_plain", lambda s, d: cu.export_asr_plain(_v1(s, d)), _P(_TRUNC("start_ms"), _TRUNC("end_ms"), "text"))


def _translated(s, d):
    return _v1(s, d).select("media_id", "entry_index", tc.ms_to_tc(F.col("start_ms")).alias("start"), tc.ms_to_tc(F.col("end_ms")).alias("end"), F.col("text").alias("original"), F.upper("text").alias("translated"), (F.col("event_id") % 5 == 0).alias("error"))


def _translated_files(s, d):
    """The files as they are found under their names."""
    path = shared_path(s, "translated")
    write_named_files(cu.export_translated(_translated(s, d), F.concat(F.lit("show "), F.col("media_id").cast("string"), F.lit(".SRT"))), path)
    return read_named_files(s, path)


add("export_translated", _translated_files, f"SELECT concat('[번역] show ', CAST(media_id AS VARCHAR), '.srt') AS file_name, content FROM ({_P(_TC('start_ms'), _TC('end_ms'), 'CASE WHEN event_id % 5 = 0 THEN text ELSE upper(text) END', 'entry_index')}) x", "v1_cues")
_tc_ms = _TC("start_ms")
add("tc_to_ms", lambda s, d: _v1(s, d).select("event_id", tc.tc_to_ms(tc.ms_to_tc(F.col("start_ms"))).alias("ms"), tc.tc_to_ms(F.col("text")).alias("bad")), "SELECT event_id, start_ms AS ms, CAST(0 AS DOUBLE) AS bad FROM v1_cues")
add("ms_to_tc", lambda s, d: _v1(s, d).select("event_id", tc.ms_to_tc(F.col("end_ms") * 1000.25).alias("t")), f"SELECT event_id, {_TC('floor(end_ms * 1000.25)')} AS t FROM v1_cues")
add("sec_to_tc_round", lambda s, d: _v1(s, d).select("event_id", tc.seconds_to_tc(F.col("end_ms") / 1000).alias("t")), f"SELECT event_id, {_TC('end_ms')} AS t FROM v1_cues")
add("sec_to_tc_trunc", lambda s, d: _v1(s, d).select("event_id", tc.seconds_to_tc_truncated(F.col("end_ms") / 8000).alias("t")), f"SELECT event_id, {_TC('floor(end_ms / 8000) * 1000 + floor((end_ms / 8000 - floor(end_ms / 8000)) * 1000)')} AS t FROM v1_cues")
add("fixed_batches", lambda s, d: cu.fixed_batches(_v1(s, d)).select("media_id", "pos", "batch_no"), "SELECT media_id, pos, CAST((pos - 1) // 10 AS INT) AS batch_no FROM v1_cues")
_B = "b AS (SELECT media_id, CAST((pos - 1) // 10 AS INT) AS batch_no, count(*) AS n, greatest(min(start_ms) / 1000, 0) AS start_s, greatest(max(end_ms) / 1000, greatest(min(start_ms) / 1000, 0) + 0.5) AS end_s FROM v1_cues GROUP BY 1, 2)"


def _bounds(s, d):
    return cu.chunk_time_bounds(cu.fixed_batches(_v1(s, d)))


add("chunk_time_bounds", _bounds, f"WITH {_B} SELECT * FROM b", "v1_cues")
_K = "1 + greatest((n - 10) // 10, 0)"
add("snapshot_count", lambda s, d: _v1(s, d).groupBy("media_id").agg(cu.snapshot_count(F.count("*")).alias("k")), f"SELECT media_id, CAST({_K} AS INT) AS k FROM (SELECT media_id, count(*) AS n FROM v1_cues GROUP BY 1) x")
add("snapshot_times", lambda s, d: cu.snapshot_times(_bounds(s, d)).withColumn("at_s", F.round("at_s", 6)), f"WITH {_B} SELECT media_id, batch_no, i, round(start_s + (end_s - start_s) * i / (k + 1), 6) AS at_s FROM (SELECT *, {_K} AS k, unnest(range(1, CAST({_K} AS BIGINT) + 1)) AS i FROM b) x", "v1_cues")
add("even_times", lambda s, d: cu.even_times(_media(s, d), 5).withColumn("at_s", F.round("at_s", 6)), f"SELECT media_id, i, round(0.2e0 + ({DURATION_MS / 1000}e0 - 0.4e0) * i / 6, 6) AS at_s FROM (SELECT DISTINCT media_id FROM v1_cues) m, (SELECT unnest(range(1, 6)) AS i) r")
add("time_bin_entries", lambda s, d: cu.time_bin_entries(_v1(s, d), 0.5), """WITH span AS (SELECT media_id, arg_min(start_ms, pos) AS f, arg_max(end_ms, pos) AS l FROM v1_cues GROUP BY 1),
bins AS (SELECT media_id, f, l, unnest(range(0, CAST(ceil((l - f) / 30000) AS BIGINT))) AS bin FROM span),
g AS (SELECT b.media_id, bin, count(*) AS n, arg_min(start_ms, pos) AS start_ms, arg_max(end_ms, pos) AS end_ms FROM bins b JOIN v1_cues c ON c.media_id = b.media_id AND c.start_ms < f + (bin + 1) * 30000 AND c.end_ms > f + bin * 30000 GROUP BY 1, 2)
SELECT media_id, n, start_ms, end_ms, row_number() OVER (PARTITION BY media_id ORDER BY bin) - 1 AS group_no FROM g""", "v1_cues")
add("renumber_entries", lambda s, d: cu.renumber_entries(_v1(s, d)), "SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, pos) AS entry_index, start_ms, end_ms, text, text AS original_text FROM v1_cues")
add("speech_windows", lambda s, d: cu.speech_windows(view(s, d, "v2_speech"), 1, 0.25), """SELECT media_id, seg_id, piece, round_even(CASE WHEN piece = 0 THEN greatest(s - 0.25, 0) ELSE s + piece END, 3) AS start_s, round_even(CASE WHEN piece = k - 1 THEN e + 0.25 ELSE s + piece + 1 END, 3) AS end_s
FROM (SELECT *, unnest(range(0, CAST(k AS BIGINT))) AS piece FROM (SELECT media_id, seg_id, start_ms / 1000 AS s, end_ms / 1000 AS e, greatest(ceil((end_ms - start_ms) / 1000), 1) AS k FROM v2_speech) x) y""", "v2_speech")
add("segment_prompt_lines", lambda s, d: cu.segment_prompt_lines(_v1(s, d)), f"SELECT media_id, string_agg(concat('- #', CAST(entry_index AS VARCHAR), ' [', {_TC('start_ms')}, ' --> ', {_TC('end_ms')}, ']: ', text), chr(10) ORDER BY pos) AS prompt FROM v1_cues GROUP BY 1")
