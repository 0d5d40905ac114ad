"""Cue files: parsing, rendering, batches, bins and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timecode as tc
from ..functions.text import decode_legacy, strip, truncated

#: Fixed pattern of a cue block.
CUE_PATTERN = r"(?sU)(\d+)\s+(\d{2}:\d{2}:\d{2},\d{3})\s-->\s(\d{2}:\d{2}:\d{2},\d{3})\s+(.*?)\s*(?=\n\d+\s|\z)"

#: The same of one block taken out of its file.
_ONE_CUE = CUE_PATTERN.removesuffix(r"(?=\n\d+\s|\z)") + r"\z"


def read_cue_files(spark: SparkSession, path: str) -> DataFrame:
    """media_id (path) and text of cue files: UTF-8 as it is, without a byte-order mark; anything else by the first legacy charset that fits."""
    return decoded(spark.read.format("binaryFile").load(path).select(F.col("path").alias("media_id"), "content"))


def decoded(files: DataFrame) -> DataFrame:
    text = F.col("content").cast("string")
    legacy = decode_legacy(F.when(~F.is_valid_utf8(text), F.col("content")))
    return files.select("media_id", F.when(F.is_valid_utf8(text), F.regexp_replace(text, "^\ufeff", "")).otherwise(legacy).alias("text"))


def strict_text(uploads: DataFrame) -> DataFrame:
    """Uploads that are valid UTF-8; others fail the job."""
    return uploads.select("media_id", F.validate_utf8(F.col("content").cast("string")).alias("text"))


def parse_cues(files: DataFrame) -> DataFrame:
    """media_id, pos, entry_index, start, end, text from files (media_id, text)."""
    whole = files.select("media_id", F.posexplode(F.regexp_extract_all("text", F.lit(CUE_PATTERN), F.lit(0))).alias("pos", "block"))
    group = lambda i: F.regexp_extract("block", _ONE_CUE, i)
    return whole.select("media_id", (F.col("pos") + 1).alias("pos"), group(1).try_cast("int").alias("entry_index"), group(2).alias("start"), group(3).alias("end"), strip(F.regexp_replace(group(4), "\n", " ")).alias("text"))


def cues_to_ms(parsed: DataFrame) -> DataFrame:
    return parsed.where("entry_index IS NOT NULL").select("media_id", "pos", "entry_index", tc.tc_to_ms(F.col("start")).alias("start_ms"), tc.tc_to_ms(F.col("end")).alias("end_ms"), "text")


def load_job_entries(parsed: DataFrame) -> DataFrame:
    """Fresh index from 1, times in seconds, the text once more as original_text."""
    w = Window.partitionBy("media_id").orderBy("pos")
    return parsed.select("media_id", F.row_number().over(w).alias("entry_index"), tc.tc_to_seconds(F.col("start")).alias("start_s"), tc.tc_to_seconds(F.col("end")).alias("end_s"), "text", F.col("text").alias("original_text"))


def render(cues: DataFrame, number: Column, start: Column, end: Column, text: Column, order: tuple[str, ...]) -> DataFrame:
    """media_id and the cue file's text; blocks in the order given."""
    block = F.concat(number.cast("string"), F.lit("\n"), start, F.lit(" --> "), end, F.lit("\n"), text, F.lit("\n"))
    rows = cues.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct(*order, block.alias("block")))).alias("rows"))
    return rows.select("media_id", F.array_join(F.transform("rows", lambda r: r["block"]), "\n").alias("content"))


def export_cues(cues: DataFrame) -> DataFrame:
    """Stored indexes and truncated times."""
    return render(cues, F.col("entry_index"), tc.ms_to_tc(F.col("start_ms")), tc.ms_to_tc(F.col("end_ms")), F.col("text"), ("pos",))


def _numbered(cues: DataFrame) -> DataFrame:
    return cues.withColumn("number", F.row_number().over(Window.partitionBy("media_id").orderBy("pos")))


def export_transcript(cues: DataFrame) -> DataFrame:
    """Numbers from 1, times rounded half to even, [BLANK] for empty texts."""
    text = F.coalesce(F.nullif(strip(F.col("text")), F.lit("")), F.lit("[BLANK]"))
    out = render(_numbered(cues), F.col("number"), tc.seconds_to_tc(F.col("start_ms") / 1000), tc.seconds_to_tc(F.col("end_ms") / 1000), text, ("pos",))
    return out.withColumn("content", F.concat(strip(F.col("content")), F.lit("\n")))


def export_asr_plain(cues: DataFrame) -> DataFrame:
    return render(_numbered(cues), F.col("number"), tc.seconds_to_tc_truncated(F.col("start_ms") / 1000), tc.seconds_to_tc_truncated(F.col("end_ms") / 1000), strip(F.col("text")), ("pos",))


def export_translated(results: DataFrame, name: Column | None = None) -> DataFrame:
    """media_id, content, file_name of results (media_id, entry_index, start, end, original, translated, error). Error rows print the original.

    name: of the file that was translated (a column that is the same for all rows of a medium), without its ending .srt; the medium's id where there is none.
    """
    text = F.when(F.col("error"), F.col("original")).otherwise(F.col("translated"))
    shown = render(results, F.col("entry_index"), F.col("start"), F.col("end"), text, ("entry_index",))
    if name is None:
        base = F.col("media_id").cast("string")
    else:
        names = results.groupBy("media_id").agg(F.regexp_replace(F.max(name), r"(?i)\.srt$", "").alias("base"))
        shown, base = shown.join(names, "media_id"), F.coalesce("base", F.col("media_id").cast("string"))
    return shown.select("media_id", "content", F.concat(F.lit("[번역] "), base, F.lit(".srt")).alias("file_name"))


def fixed_batches(cues: DataFrame, size: int = 10) -> DataFrame:
    w = Window.partitionBy("media_id").orderBy("pos")
    return cues.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def chunk_time_bounds(batches: DataFrame) -> DataFrame:
    """media_id, batch_no, n, start_s, end_s: start not below 0, at least half a second long."""
    start = F.greatest(F.min("start_ms") / 1000, F.lit(0.0))
    out = batches.groupBy("media_id", "batch_no").agg(F.count("*").alias("n"), start.alias("start_s"), (F.max("end_ms") / 1000).alias("e"))
    return out.select("media_id", "batch_no", "n", "start_s", F.greatest("e", F.col("start_s") + 0.5).alias("end_s"))


def snapshot_count(n: Column) -> Column:
    return (1 + F.greatest(F.floor((n - 10) / 10), F.lit(0))).cast("int")


def snapshot_times(bounds: DataFrame) -> DataFrame:
    """Points that divide each batch's span evenly."""
    k = snapshot_count(F.col("n"))
    at = bounds.select("media_id", "batch_no", "start_s", "end_s", k.alias("k"), F.explode(F.sequence(F.lit(1), k)).alias("i"))
    return at.select("media_id", "batch_no", "i", (F.col("start_s") + (F.col("end_s") - F.col("start_s")) * F.col("i") / (F.col("k") + 1)).alias("at_s"))


def even_times(media: DataFrame, count: int, margin_s: float = 0.2) -> DataFrame:
    """Points that divide a whole duration, without a margin at both ends, evenly. media: media_id, duration_ms."""
    start = max(0.0, margin_s)
    length = F.greatest(F.lit(start + margin_s), F.col("duration_ms") / 1000 - margin_s) - start
    points = media.select("media_id", "duration_ms", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("i")) if count > 0 else media.select("media_id", "duration_ms", F.lit(1).alias("i")).limit(0)
    return points.select("media_id", "i", (start + length * F.col("i") / (count + 1)).alias("at_s"))


def time_bin_entries(cues: DataFrame, minutes: float) -> DataFrame:
    """media_id, group_no (from 0, without empty bins), n, start_ms (first member's), end_ms (last member's)."""
    width = minutes * 60_000
    span = cues.groupBy("media_id").agg(F.min_by("start_ms", "pos").alias("first"), F.max_by("end_ms", "pos").alias("last"))
    at = cues.join(span, "media_id")
    low = F.greatest(F.floor((F.col("start_ms") - F.col("first")) / width), F.lit(0))
    high = F.least(F.ceil((F.col("end_ms") - F.col("first")) / width) - 1, F.ceil((F.col("last") - F.col("first")) / width) - 1)
    binned = at.where(high >= low).select("media_id", "pos", "start_ms", "end_ms", F.explode(F.sequence(low, high)).alias("bin"))
    groups = binned.groupBy("media_id", "bin").agg(F.count("*").alias("n"), F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"))
    return groups.withColumn("group_no", F.row_number().over(Window.partitionBy("media_id").orderBy("bin")) - 1).drop("bin")


def renumber_entries(cues: DataFrame) -> DataFrame:
    w = Window.partitionBy("media_id").orderBy("start_ms", "pos")
    return cues.select("media_id", F.row_number().over(w).alias("entry_index"), "start_ms", "end_ms", "text", F.col("text").alias("original_text"))


def speech_windows(speech: DataFrame, max_s: float = 10, pad_s: float = 0.25) -> DataFrame:
    """Each segment in pieces of at most ``max_s``, padded at its first start and last end; a length is taken in milliseconds, since a difference of seconds is rounded."""
    s, e = F.col("start_ms") / 1000, F.col("end_ms") / 1000
    pieces = F.greatest(F.ceil((F.col("end_ms") - F.col("start_ms")) / (max_s * 1000)), F.lit(1)).cast("int")
    cut = speech.where("end_ms > start_ms").select("media_id", "seg_id", s.alias("s"), e.alias("e"), pieces.alias("k"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    start = F.when(F.col("piece") == 0, F.greatest(F.col("s") - pad_s, F.lit(0.0))).otherwise(F.col("s") + F.col("piece") * max_s)
    end = F.when(F.col("piece") == F.col("k") - 1, F.col("e") + pad_s).otherwise(F.col("s") + (F.col("piece") + 1) * max_s)
    return cut.select("media_id", "seg_id", "piece", F.bround(start, 3).alias("start_s"), F.bround(end, 3).alias("end_s"))


def segment_prompt_lines(cues: DataFrame) -> DataFrame:
    """One prompt text a medium: a line for each entry, its text cut to 200."""
    line = F.concat(F.lit("- #"), F.col("entry_index").cast("string"), F.lit(" ["), tc.ms_to_tc(F.col("start_ms")), F.lit(" --> "), tc.ms_to_tc(F.col("end_ms")), F.lit("]: "), truncated(F.col("text"), 200))
    rows = cues.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("rows"))
    return rows.select("media_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("prompt"))
