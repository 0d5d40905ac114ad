"""Speech-recognition segments: absolute times, padding, text and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timecode as tc
from ..functions.text import preview, strip, truncated
from . import cues, intervals, sync

CLIP_S = 30.0
#: Fixed first line.
CONTEXT_HEADER = "Preliminary Whisper transcript (context only):"


def nonempty_text(asr: DataFrame) -> DataFrame:
    return asr.where(strip(F.coalesce("text", F.lit(""))) != "")


def rebase_absolute(asr: DataFrame, clip_s: float = CLIP_S) -> DataFrame:
    """Clip times clamped, at least 0.05 s long, and moved by the segment's start, with timecodes of both."""
    s = F.greatest("start_s", F.lit(0.0))
    e = F.greatest("end_s", s + 0.05)
    base = F.col("segment_index") * clip_s
    return asr.select("media_id", "clip_index", tc.seconds_to_tc(s).alias("start_tc"), tc.seconds_to_tc(e).alias("end_tc"), (base + s).alias("abs_start"), (base + e).alias("abs_end"), tc.seconds_to_tc(base + s).alias("abs_start_tc"), tc.seconds_to_tc(base + e).alias("abs_end_tc"))


def asr_format(asr: DataFrame) -> DataFrame:
    """Numbers from 1 in each clip, null times as 0, text stripped, two timecodes."""
    w = Window.partitionBy("media_id", "segment_index").orderBy("start_s", "clip_index")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return asr.select("media_id", "segment_index", "clip_index", F.row_number().over(w).alias("number"), tc.seconds_to_tc(zero("start_s")).alias("start"), tc.seconds_to_tc(zero("end_s")).alias("end"), strip(F.col("text")).alias("text"))


def asr_windows(asr: DataFrame, most: int = 80) -> DataFrame:
    """Clip times not below 0 and at least 0.05 s long, rounded, with numbers from 1 in each clip and short texts; a missing end: 0.1 s after the start; a missing text: empty."""
    text = F.coalesce("text", F.lit(""))
    s = F.greatest(F.coalesce("start_s", F.lit(0.0)), F.lit(0.0))
    e = F.greatest(F.coalesce(F.col("end_s"), s + 0.1), s + 0.05)
    w = Window.partitionBy("media_id", "segment_index").orderBy("start_s", "clip_index")
    return asr.select("media_id", "clip_index", F.row_number().over(w).alias("number"), F.bround(s, 3).alias("start_s"), F.bround(e, 3).alias("end_s"), truncated(text, most).alias("text"), preview(text, most).alias("preview"))


def joined_text(asr: DataFrame) -> DataFrame:
    rows = nonempty_text(asr).groupBy("media_id", "segment_index").agg(F.array_sort(F.collect_list(F.struct("start_s", "clip_index", strip(F.col("text")).alias("t")))).alias("rows"))
    return rows.select("media_id", "segment_index", F.array_join(F.transform("rows", lambda r: r["t"]), " ").alias("text"))


def asr_context_lines(asr: DataFrame, keep: int = 20) -> DataFrame:
    """The first non-empty lines of each clip behind a header; clips without any: no text."""
    w = Window.partitionBy("media_id", "segment_index").orderBy("start_s", "clip_index")
    line = F.concat(F.lit("- ["), tc.seconds_to_tc(F.col("start_s")), F.lit(" --> "), tc.seconds_to_tc(F.col("end_s")), F.lit("] "), truncated(F.col("text"), 200))
    first = nonempty_text(asr).withColumn("k", F.row_number().over(w)).where(F.col("k") <= keep)
    rows = first.groupBy("media_id", "segment_index").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("rows"))
    text = F.concat(F.lit(CONTEXT_HEADER + "\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return asr.select("media_id", "segment_index").distinct().join(rows, ["media_id", "segment_index"], "left").select("media_id", "segment_index", F.coalesce(text, F.lit("")).alias("text"))


def padding_adjust(absolute: DataFrame, limit: Column, padding: float = 0.2) -> DataFrame:
    """absolute (media_id, clip_index, start_s, end_s, text) widened, not below 0 nor beyond the limit where that lies behind the start."""
    s = F.greatest(F.col("start_s") - padding, F.lit(0.0))
    e = F.when(limit > s, F.least(F.col("end_s") + padding, limit)).otherwise(s + max(0.001, padding))
    return absolute.select("media_id", "clip_index", s.alias("start_s"), F.when(e <= s, s + 0.001).otherwise(e).alias("end_s"), "text")


def absolute_entries(asr: DataFrame, clip_s: float = CLIP_S) -> DataFrame:
    base = F.col("segment_index") * clip_s
    return nonempty_text(asr).select("media_id", "clip_index", F.greatest(base + F.col("start_s"), F.lit(0.0)).alias("start_s"), F.greatest(base + F.col("end_s"), F.lit(0.0)).alias("end_s"), strip(F.col("text")).alias("text"))


def transcript_entries(asr: DataFrame, media: DataFrame, speech: DataFrame | None, padding: float = 0.2, clip_s: float = CLIP_S) -> DataFrame:
    """media_id, pos, start_ms, end_ms, text: absolute, padded, never overlapping; without silent ones if speech is given."""
    absolute = absolute_entries(asr, clip_s)
    padded = padding_adjust(absolute, F.lit(float("inf")), padding) if padding else absolute
    clamped = sync.monotone_clamp(padded, media)
    w = Window.partitionBy("media_id").orderBy("start_s", "clip_index")
    entries = clamped.select("media_id", F.row_number().over(w).alias("pos"), (F.col("start_s") * 1000).alias("start_ms"), (F.col("end_s") * 1000).alias("end_ms"), "text")
    return intervals.filter_silent_entries(entries, speech) if speech is not None else entries


def transcript_pipeline(asr: DataFrame, media: DataFrame, speech: DataFrame | None) -> DataFrame:
    """media_id and the transcript file's text."""
    return cues.export_transcript(transcript_entries(asr, media, speech))
