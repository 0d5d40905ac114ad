"""Interval algebra between cues and speech segments, for all media at once.

cues: media_id, pos, entry_index, start_ms, end_ms, text.  speech: media_id, seg_id, start_ms, end_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the time buckets of interval joins: a medium of very many cues and segments is joined bucket by bucket.
BUCKET_MS = 60_000


def merge_close_segments(speech: DataFrame, gap_ms: float = 150) -> DataFrame:
    """Islands of segments whose gaps are at most ``gap_ms``: media_id, seg_id (of the first), start_ms, end_ms."""
    order = Window.partitionBy("media_id").orderBy("start_ms", "seg_id")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start_ms") - before <= gap_ms, 0).otherwise(1)
    islands = speech.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    return islands.groupBy("media_id", "island").agg(F.min_by("seg_id", F.struct("start_ms", "seg_id")).alias("seg_id"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def valid_segments(speech: DataFrame) -> DataFrame:
    return speech.where("end_ms > start_ms")


def filter_short_segments(speech: DataFrame, min_ms: float = 200) -> DataFrame:
    return speech.where(F.col("end_ms") - F.col("start_ms") >= min_ms)


def clamp_segments(speech: DataFrame, duration_ms: Column) -> DataFrame:
    """Inside the medium, in seconds rounded to 3 places."""
    inside = speech.select("media_id", "seg_id", F.greatest("start_ms", F.lit(0.0)).alias("s"), F.least("end_ms", duration_ms).alias("e")).where("e > s")
    return inside.select("media_id", "seg_id", F.bround(F.col("s") / 1000, 3).alias("start_s"), F.bround(F.col("e") / 1000, 3).alias("end_s"))


def interval_pairs(left: DataFrame, right: DataFrame, bucket_ms: float = BUCKET_MS) -> DataFrame:
    """Pairs of rows of a medium that overlap: all columns of ``left``, and seg_id, seg_start, seg_end of ``right``.

    Both sides are dealt to the buckets that they touch; a pair is kept in the bucket of its later start.
    """
    touched = lambda s, e: F.explode(F.sequence(F.floor(s / bucket_ms), F.floor(F.greatest(s, e) / bucket_ms))).alias("bucket")
    a = left.select("*", touched(F.col("start_ms"), F.col("end_ms")))
    b = right.select(F.col("media_id"), "seg_id", F.col("start_ms").alias("seg_start"), F.col("end_ms").alias("seg_end"), touched(F.col("start_ms"), F.col("end_ms")))
    both = a.join(b, ["media_id", "bucket"]).where("start_ms < seg_end AND seg_start < end_ms")
    return both.where(F.floor(F.greatest("start_ms", "seg_start") / bucket_ms) == F.col("bucket")).drop("bucket")


def paired_rows(cues: DataFrame, speech: DataFrame, key: tuple[str, ...] = ("media_id", "pos"), bucket_ms: float = BUCKET_MS) -> DataFrame:
    """Every cue with the segments that it overlaps: row (all its columns), key, start_ms, end_ms, seg_id, seg_start, seg_end; null ones without any.

    The rows go along, so that no join back is needed; a cue lies in one bucket mostly.
    """
    touched = lambda s, e: F.explode_outer(F.sequence(F.floor(s / bucket_ms), F.floor(F.greatest(s, e) / bucket_ms))).alias("bucket")
    a = cues.select(F.struct(*cues.columns).alias("row"), *key, "start_ms", "end_ms", touched(F.col("start_ms"), F.col("end_ms"))).alias("a")
    b = speech.select("media_id", "seg_id", F.col("start_ms").alias("seg_start"), F.col("end_ms").alias("seg_end"), touched(F.col("start_ms"), F.col("end_ms"))).alias("b")
    meet = (F.col("a.media_id") == F.col("b.media_id")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("start_ms") < F.col("seg_end")) & (F.col("seg_start") < F.col("end_ms"))
    meet &= F.floor(F.greatest("start_ms", "seg_start") / bucket_ms) == F.col("a.bucket")
    return a.join(b, meet, "left").select("row", *[F.col(f"a.{k}").alias(k) for k in key], "start_ms", "end_ms", "seg_id", "seg_start", "seg_end")


def with_overlap(cues: DataFrame, speech: DataFrame, key: tuple[str, ...] = ("media_id", "pos")) -> DataFrame:
    """cues with overlap_ms: the sum over segments, 0 without any.  The key tells cues apart."""
    common = F.when(F.col("seg_start").isNotNull(), F.least("end_ms", "seg_end") - F.greatest("start_ms", "seg_start"))
    sums = paired_rows(cues, speech, key).groupBy(*key).agg(F.first("row").alias("row"), F.sum(common).alias("overlap_ms"))
    return sums.select("row.*", F.coalesce("overlap_ms", F.lit(0.0)).alias("overlap_ms"))


def silence_measures(cues: DataFrame, speech: DataFrame, edge_ms: float = 50) -> DataFrame:
    """cues with overlap_ms, and of their stretches without speech total and longest (ms; 0 without any) and at_edge (one begins or ends near an end of the cue)."""
    met = F.col("seg_start").isNotNull()
    pairs = paired_rows(cues, speech).withColumns({"s": F.when(met, F.greatest("start_ms", "seg_start")), "e": F.when(met, F.least("end_ms", "seg_end"))})
    order = Window.partitionBy("media_id", "pos").orderBy("s", "seg_id")
    reached = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("start_ms"))
    gap = F.when(F.col("s").isNotNull(), F.greatest(F.col("s") - F.col("reached"), F.lit(0.0)))
    edge = (gap > 0) & ((F.abs(F.col("reached") - F.col("start_ms")) < edge_ms) | (F.abs(F.col("s") - F.col("end_ms")) < edge_ms))
    sums = pairs.withColumn("reached", reached).groupBy("media_id", "pos").agg(
        F.first("row").alias("row"), F.first("end_ms").alias("end_ms"), F.sum(F.col("e") - F.col("s")).alias("overlap_ms"), F.sum(gap).alias("inner"), F.max(gap).alias("longest"), F.bool_or(edge).alias("edge"), F.coalesce(F.max("e"), F.first("start_ms")).alias("last")
    )
    tail, zero = F.greatest(F.col("end_ms") - F.col("last"), F.lit(0.0)), F.lit(0.0)
    return sums.select("row.*", F.coalesce("overlap_ms", zero).alias("overlap_ms"), (F.coalesce("inner", zero) + tail).alias("total"), F.greatest(F.coalesce("longest", zero), tail).alias("longest"), (F.coalesce("edge", F.lit(False)) | (tail > 0)).alias("at_edge"))


def entries_for_segment(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """Each segment's entries: media_id, seg_id, pos; an entry can be in several segments."""
    return interval_pairs(cues.select("media_id", "pos", "start_ms", "end_ms"), segments).select("media_id", "seg_id", "pos")


def silence_gaps(cues: DataFrame, speech: DataFrame) -> DataFrame:
    """Stretches of each cue without speech: media_id, pos, gap_start, gap_end."""
    slim = cues.select("media_id", "pos", "start_ms", "end_ms")
    clipped = interval_pairs(slim, speech).select("media_id", "pos", "start_ms", "end_ms", "seg_id", F.greatest("start_ms", "seg_start").alias("s"), F.least("end_ms", "seg_end").alias("e"))
    order = Window.partitionBy("media_id", "pos").orderBy("s", "seg_id")
    reached = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("start_ms"))
    inner = clipped.select("media_id", "pos", reached.alias("gap_start"), F.col("s").alias("gap_end"))
    last = clipped.groupBy("media_id", "pos").agg(F.max("e").alias("gap_start"), F.max("end_ms").alias("gap_end"))
    none = slim.join(last.select("media_id", "pos"), ["media_id", "pos"], "left_anti").select("media_id", "pos", F.col("start_ms").alias("gap_start"), F.col("end_ms").alias("gap_end"))
    return inner.unionByName(last).unionByName(none).where("gap_end > gap_start")


def silence_totals(gaps: DataFrame) -> DataFrame:
    length = F.col("gap_end") - F.col("gap_start")
    return gaps.groupBy("media_id", "pos").agg(F.sum(length).alias("total_ms"), F.max(length).alias("max_ms"))


def _is_noise(ratio: float) -> Column:
    whole = F.col("end_ms") - F.col("start_ms")
    return (whole > 0) & (F.col("total") > 0) & ((F.col("total") / whole <= ratio) | (~F.col("at_edge") & (F.col("longest") / whole <= ratio)))


def silence_noise_flag(cues: DataFrame, speech: DataFrame, ratio: float = 0.15, edge_ms: float = 50) -> DataFrame:
    """cues with is_noise: little silence in all, or only short ones away from both ends; no silence: false."""
    return silence_measures(cues, speech, edge_ms).select(*cues.columns, F.coalesce(_is_noise(ratio), F.lit(False)).alias("is_noise"))


def filter_silent_entries(cues: DataFrame, speech: DataFrame, share: float = 0.1, least_ms: float = 120, ratio: float = 0.15) -> DataFrame:
    """Entries with enough speech, or whose silence is noise; media without speech pass whole."""
    spoken = speech.select("media_id").distinct().withColumn("spoken", F.lit(True))
    enough = F.col("overlap_ms") >= F.greatest(F.lit(float(least_ms)), (F.col("end_ms") - F.col("start_ms")) * share)
    return silence_measures(cues, speech).join(spoken, "media_id", "left").where(F.col("spoken").isNull() | F.coalesce(_is_noise(ratio), F.lit(False)) | enough).select(*cues.columns)


def mark_silent_entries(cues: DataFrame, speech: DataFrame, share: float = 0.1, least_ms: float = 120, short_ms: float = 1200, spoken: Column | None = None) -> DataFrame:
    """cues, cut at the next one's start, with silent: long ones without enough speech.  Media without speech: unchanged, none silent.

    spoken: whether a row's medium has speech, if the rows tell; speech is then read once.
    """
    order = Window.partitionBy("media_id").orderBy("entry_index", "pos")
    following = F.lead("start_ms").over(order)
    end = F.when(F.col("end_ms") > following, F.greatest("start_ms", following)).otherwise(F.col("end_ms"))
    if spoken is None:
        cut = cues.join(speech.select("media_id").distinct().withColumn("spoken", F.lit(True)), "media_id", "left").withColumn("spoken", F.col("spoken").isNotNull())
    else:
        cut = cues.withColumn("spoken", spoken)
    cut = cut.withColumn("cut", end)
    cut = cut.withColumn("cut", F.when(F.col("cut") <= F.col("start_ms"), F.col("start_ms") + 1).otherwise(F.col("cut")))
    cut = cut.withColumn("end_ms", F.when(F.col("spoken"), F.col("cut")).otherwise(F.col("end_ms"))).drop("cut")
    whole = F.col("end_ms") - F.col("start_ms")
    keep = ~F.col("spoken") | (whole < short_ms) | (F.col("overlap_ms") >= F.greatest(F.lit(float(least_ms)), whole * share))
    return with_overlap(cut, speech).select(*cues.columns, (~F.coalesce(keep, F.lit(False))).alias("silent"))


def remove_silent_entries(cues: DataFrame, speech: DataFrame, share: float = 0.1, least_ms: float = 120, short_ms: float = 1200, enabled: bool = True) -> DataFrame:
    """Entries, cut at the next one's start, that are short or have enough speech; media without speech pass unchanged."""
    return mark_silent_entries(cues, speech, share, least_ms, short_ms).where("NOT silent").drop("silent") if enabled else cues


def boundary_score(target: Column, boundary: Column, s: Column, e: Column) -> Column:
    """Nearness of a segment's edge to a boundary, and the segment's length."""
    return 0.7 / (1.0 + F.abs(target - boundary) / 100.0) + 0.3 * F.least((e - s) / 1000.0, F.lit(1.0))


def best_boundary(points: DataFrame, speech: DataFrame, lookback: float, lookahead: float, pad: float, is_start: bool) -> DataFrame:
    """points (media_id, id, boundary) with new_boundary and score: the best segment near, the first on ties; none: null and 0."""
    width = max(BUCKET_MS, 2 * (lookback + lookahead))
    p = points.select("media_id", "id", "boundary", F.explode(F.sequence(F.floor((F.col("boundary") - lookback) / width), F.floor((F.col("boundary") + lookahead) / width))).alias("bucket"))
    s = speech.select("media_id", "seg_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor(F.greatest("start_ms", "end_ms") / width))).alias("bucket"))
    near = p.join(s, ["media_id", "bucket"]).where((F.col("e") >= F.col("boundary") - lookback) & (F.col("s") <= F.col("boundary") + lookahead))
    target = F.col("s") if is_start else F.col("e")
    near = near.withColumn("score", boundary_score(target, F.col("boundary"), F.col("s"), F.col("e"))).withColumn("moved", target + (-pad if is_start else pad))
    best = near.groupBy("media_id", "id").agg(F.max_by(F.struct("moved", "score"), F.struct("score", -F.col("s"), -F.col("seg_id"))).alias("b"))
    out = points.join(best, ["media_id", "id"], "left")
    return out.select("media_id", "id", "boundary", F.col("b.moved").alias("new_boundary"), F.coalesce("b.score", F.lit(0.0)).alias("score"))
