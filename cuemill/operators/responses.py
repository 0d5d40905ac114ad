"""Matching model replies with the entries that were requested.

requests: file_id, entry_index, original.  responses: file_id, entry_index, attempt, seq, text.
Which of several replies wins is the operator's name, never a switch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

KEY = ["file_id", "entry_index"]
#: Fixed text of a failed entry, around the reason.
FAILED_TEXT = "-- 번역 실패: no reply --"


def match_first_wins(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests that have a reply, with the first one; a reply without text stands for the original."""
    first = responses.groupBy(*KEY).agg(F.min_by(F.struct("text", "attempt"), F.struct("attempt", "seq")).alias("r"))
    return requests.join(first, KEY).select(*KEY, "original", F.coalesce("r.text", "original").alias("translated"), F.col("r.attempt").alias("attempt"))


def valid_updates(requests: DataFrame, raw: DataFrame) -> DataFrame:
    """Replies (entry_index as text) whose index is a number that was requested and whose text isn't blank."""
    parsed = raw.withColumn("entry_index", F.trim("entry_index").try_cast("int")).where(F.col("entry_index").isNotNull() & (strip(F.col("text")) != ""))
    return parsed.join(requests.select(*KEY), KEY)


def apply_updates_last_wins(requests: DataFrame, updates: DataFrame) -> DataFrame:
    last = updates.groupBy(*KEY).agg(F.max_by("text", F.struct("attempt", "seq")).alias("new"))
    return requests.join(last, KEY, "left").select(*KEY, F.coalesce("new", "original").alias("text"), F.col("new").isNotNull().alias("updated"))


def missing_entries(requests: DataFrame, responses: DataFrame) -> DataFrame:
    return requests.join(responses, KEY, "left_anti").select(*KEY)


def failed_fill(requests: DataFrame, responses: DataFrame, text: str = FAILED_TEXT) -> DataFrame:
    """Every request: its first reply, or an error row."""
    got = match_first_wins(requests, responses).select(*KEY, "translated")
    return requests.join(got, KEY, "left").select(*KEY, "original", F.coalesce("translated", F.lit(text)).alias("translated"), F.col("translated").isNull().alias("error"))


def enrich_pairs(requests: DataFrame, translated: DataFrame, most_source: int = 1000, most_target: int = 1200) -> DataFrame:
    return requests.join(translated.select(*KEY, "translated"), KEY).select(*KEY, F.left("original", F.lit(most_source)).alias("source"), F.left("translated", F.lit(most_target)).alias("target"))


def attempt_state(requests: DataFrame, responses: DataFrame, attempts: int = 5) -> DataFrame:
    """file_id, attempt, confirmed (entries answered up to it), requested, done."""
    first = responses.where(F.col("attempt") <= attempts).join(requests.select(*KEY), KEY).groupBy(*KEY).agg(F.min("attempt").alias("attempt"))
    each = requests.groupBy("file_id").agg(F.count("*").alias("requested")).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts))))
    new = first.groupBy("file_id", "attempt").agg(F.count("*").alias("new"))
    w = Window.partitionBy("file_id").orderBy("attempt")
    out = each.join(new, ["file_id", "attempt"], "left").withColumn("confirmed", F.sum(F.coalesce("new", F.lit(0))).over(w))
    return out.select("file_id", "attempt", "confirmed", "requested", (F.col("confirmed") == F.col("requested")).alias("done"))


def segment_outcome(requests: DataFrame, updates: DataFrame, errors: DataFrame) -> DataFrame:
    """file_id, status, updated: by file as the segment. errors: file_id, attempt (of request errors); a later success leaves the failed set."""
    applied = apply_updates_last_wins(requests, updates).groupBy("file_id").agg(F.count_if("updated").alias("updated"))
    last_ok = updates.groupBy("file_id").agg(F.max("attempt").alias("ok"))
    last_bad = errors.groupBy("file_id").agg(F.max("attempt").alias("bad"))
    out = applied.join(last_ok, "file_id", "left").join(last_bad, "file_id", "left")
    failed = F.col("bad").isNotNull() & (F.col("ok").isNull() | (F.col("bad") > F.col("ok")))
    return out.select("file_id", F.when(failed, "error").otherwise("completed").alias("status"), F.when(failed, F.lit(0)).otherwise(F.col("updated")).cast("long").alias("updated"))


def refresh_transcript(requests: DataFrame, updates: DataFrame) -> DataFrame:
    """file_id and all its texts in order after updates."""
    rows = apply_updates_last_wins(requests, updates).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("entry_index", "text"))).alias("rows"))
    return rows.select("file_id", F.array_join(F.transform("rows", lambda r: F.concat(r["entry_index"].cast("string"), F.lit(": "), r["text"])), "\n").alias("content"))


def file_counts(requests: DataFrame, responses: DataFrame) -> DataFrame:
    got = match_first_wins(requests, responses).groupBy("file_id").agg(F.count("*").alias("received"))
    total = requests.groupBy("file_id").agg(F.count("*").alias("total"))
    out = total.join(got, "file_id", "left").withColumn("received", F.coalesce("received", F.lit(0)))
    return out.withColumn("percent", F.floor(100 * F.col("received") / F.col("total") + 0.5).cast("int"))


def batch_payload(requests: DataFrame, size: int = 10) -> DataFrame:
    """file_id, batch_no, payload: a JSON array of the batch's index and text, without carriage returns."""
    w = Window.partitionBy("file_id").orderBy("entry_index")
    dealt = requests.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    rows = dealt.groupBy("file_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct(F.col("entry_index").alias("index"), F.regexp_replace("original", "\r", "").alias("text")))).alias("rows"))
    return rows.select("file_id", "batch_no", F.to_json("rows").alias("payload"))


def rebuild_full_turn(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """One full request and one full reply for each file, as JSON in index order."""
    done = failed_fill(requests, responses)
    pack = lambda c: F.to_json(F.array_sort(F.collect_list(F.struct(F.col("entry_index").alias("index"), F.col(c).alias("text")))))
    return done.groupBy("file_id").agg(pack("original").alias("request"), pack("translated").alias("reply"))


def _clipped(text: str, most: int):
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.left(flat, F.lit(most - 3))), F.lit("..."))).otherwise(flat)


#: Fixed texts of a reconstruction: its mark, and what stands for a file without pairs.
RECON_MARK, NO_PAIRS = "[RECON_ENTRIES]", "번역된 자막이 아직 없습니다."
#: Fixed: pairs that a summary is made from.
SUMMARY_PAIRS = 400


def recon_entries(pairs: DataFrame, keep: int = 100, files: DataFrame | None = None, most: int = SUMMARY_PAIRS) -> DataFrame:
    """file_id, digest, summary_input of files. pairs: file_id, entry_index, source, target.

    digest: a header with counts, then the last ``keep`` pairs, clipped; a fixed text for files without pairs.  summary_input: the last ``most`` pairs whole, as the messages
    of which a summary is made; empty without pairs.  files: those to give rows for (file_id); None: those that have pairs.
    Spark keeps the last pairs of each file before they are shuffled, so that no more than those of a task meet; the numbers of pairs are summed up beside them.
    """
    back = Window.partitionBy("file_id").orderBy(F.desc("entry_index"))
    line = F.concat(F.lit("#$"), F.col("entry_index").cast("string"), F.lit("\nORIG: "), _clipped("source", 300), F.lit("\nTRANS: "), _clipped("target", 400))
    said = F.concat(F.lit("#"), F.col("entry_index").cast("string"), F.lit(" 원문: "), F.coalesce("source", F.lit("")), F.lit("\n번역: "), F.coalesce("target", F.lit("")))
    recent = pairs.withColumn("back", F.row_number().over(back)).where(F.col("back") <= max(keep, most))
    in_order = lambda within, text: F.transform(F.array_sort(F.collect_list(F.when(F.col("back") <= within, F.struct("entry_index", text.alias("t"))))), lambda r: r["t"])
    rows = recent.groupBy("file_id").agg(in_order(keep, line).alias("lines"), in_order(most, said).alias("said"))
    total = pairs.groupBy("file_id").agg(F.count("*").alias("total"))
    out = rows.join(total, "file_id")
    out = out if files is None else files.select("file_id").distinct().join(out, "file_id", "left")
    header = F.concat(F.lit(f"{RECON_MARK}\n총 "), F.col("total").cast("string"), F.lit("개 중 최신 "), F.size("lines").cast("string"), F.lit("개"))
    digest = F.when(F.col("total").isNull(), f"{RECON_MARK}\n{NO_PAIRS}").otherwise(F.array_join(F.concat(F.array(header), F.col("lines")), "\n"))
    return out.select("file_id", digest.alias("digest"), F.coalesce("said", F.array().cast("array<string>")).alias("summary_input"))


#: Schema of a line of a result stream; every field may be absent.
EVENT = "file_id BIGINT, index INT, original STRING, translated STRING, error BOOLEAN, count BIGINT, file_completed STRING, _corrupt STRING"


def to_event_lines(results: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return results.select(F.to_json(F.struct("file_id", F.col("entry_index").alias("index"), "original", "translated", "error")).alias("value"))


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """Rows of the lines that are JSON objects; blank and malformed lines are skipped. Batch or stream."""
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    return parsed.where(F.col("e._corrupt").isNull()).select("e.*").drop("_corrupt")
