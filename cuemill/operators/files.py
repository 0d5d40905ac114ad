"""Files: a text a medium or conversation, lines of events, nested segment tables, listings of folders.

Spark lays the files out: a folder for each key, and rows of a key together.  What is written can be read back by the reader beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label
from .responses import parse_event_lines, to_event_lines
from .telemetry import retention_old


def write_texts(contents: DataFrame, path: str, key: str = "media_id") -> None:
    """A text file in a folder of its key for each row of ``contents`` (key, content: one row a key); a last line break is added where there is none."""
    contents.select(key, F.regexp_replace("content", r"\n\z", "").alias("value")).write.partitionBy(key).text(path)


def read_texts(spark: SparkSession, path: str, key: str = "media_id", kind: str = "string") -> DataFrame:
    files = spark.read.schema(f"value string, {key} {kind}").text(path, wholetext=True)
    return files.select(key, F.col("value").alias("content"))


def write_event_lines(results: DataFrame, path: str) -> None:
    to_event_lines(results).write.mode("append").text(path)


def stream_event_lines(results: DataFrame, path: str, checkpoint: str):
    """The started query that appends the lines of a stream of results."""
    return to_event_lines(results).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).start()


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_event_lines(spark.read.text(path))


def history_files(messages: DataFrame, stamp: Column) -> DataFrame:
    """conv_id, file_name, content: a history's roles and parts as JSON, in order of turns. messages: conv_id, turn, role, parts (JSON texts)."""
    rows = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "parts"))).alias("rows"))
    name = F.concat(F.lit("history_"), label(F.col("conv_id").cast("string")), F.lit("_"), stamp, F.lit(".json"))
    return rows.select("conv_id", name.alias("file_name"), F.to_json(F.transform("rows", lambda r: F.struct(r["role"].alias("role"), F.transform(r["parts"], F.try_parse_json).alias("parts")))).alias("content"))


def nested_segments(segments: DataFrame, speech: DataFrame) -> DataFrame:
    """Segments (media_id, segment_idx, ...) with their speech (media_id, segment_idx, start_ms, end_ms) as an array in order of time, empty where there is none.

    speech_from_ms and speech_to_ms are the first start and the last end, null where there is no speech: row groups that can't hold what is asked for are skipped by them.
    """
    items = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("speech")
    own = speech.groupBy("media_id", "segment_idx").agg(items, F.min("start_ms").alias("speech_from_ms"), F.max("end_ms").alias("speech_to_ms"))
    return segments.join(own, ["media_id", "segment_idx"], "left").withColumn("speech", F.coalesce("speech", F.array().cast(own.schema["speech"].dataType)))


def write_segments(nested: DataFrame, path: str) -> None:
    """The table of segments, in order of their times within each file, so that its statistics tell the files and row groups apart."""
    nested.repartitionByRange("media_id", "segment_idx").sortWithinPartitions("media_id", "segment_idx").write.mode("overwrite").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spoken_between(nested: DataFrame, from_ms: float, to_ms: float, least_ms: float = 0) -> DataFrame:
    """Segments with a piece of speech of ``least_ms`` at least that overlaps the time given. The bounds of each segment's speech are compared by the scan, its pieces after it."""
    overlaps = F.exists("speech", lambda s: (s["start_ms"] < to_ms) & (s["end_ms"] > from_ms) & (s["end_ms"] - s["start_ms"] >= least_ms))
    return nested.where((F.col("speech_from_ms") < to_ms) & (F.col("speech_to_ms") > from_ms) & overlaps)


def speech_of(nested: DataFrame) -> DataFrame:
    return nested.select("media_id", "segment_idx", F.explode("speech").alias("s")).select("media_id", "segment_idx", "s.start_ms", "s.end_ms")


def old_files(spark: SparkSession, roots: list[str], as_of: Column, days: int = 3) -> DataFrame:
    """path, modificationTime, length of files older than so many days, to be deleted; only the listing is read, and nothing is deleted."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", "modificationTime", "length")
    return retention_old(listing, "modificationTime", as_of, days, strict=True)
