"""Chunks of cues, snapping of their boundaries to speech, repair of overlaps, and whole pipelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from . import intervals


#: Fixed text of a transcript without entries.
NO_SPEECH = "[NO SPEECH DETECTED]"


@dataclass(frozen=True)
class SyncConfig:
    """Names and defaults of the options."""

    chunk_mode: str = "grouped"
    gap_threshold_ms: float = 200
    lookback_start_ms: float = 800
    lookahead_start_ms: float = 400
    lookback_end_ms: float = 400
    lookahead_end_ms: float = 800
    max_left_shift_ms: float = 500
    max_left_expand_ms: float = 800
    max_right_shift_ms: float = 500
    max_right_expand_ms: float = 800
    pad_ms: float = 80
    min_entry_duration_ms: float = 300
    threshold_score: float = 0.3
    min_speech_ms: float = 200
    merge_gap_ms: float = 150
    remove_silent_entries: bool = True
    min_coverage_ratio: float = 0.1
    min_coverage_ms: float = 120
    min_silence_entry_ms: float = 1200
    entry_mode: str = "edge-only"
    fix_overlaps: bool = True
    min_gap_ms: float = 10


def chunk_by_gap(cues: DataFrame, threshold_ms: float = 200, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """cues with chunk_id (from 0): a new chunk where the start is further than the threshold after the previous row's end."""
    w = Window.partitionBy("media_id").orderBy(*order)
    fresh = F.when(F.col("start_ms") - F.lag("end_ms").over(w) > threshold_ms, 1).otherwise(0)
    return cues.withColumn("fresh", fresh).withColumn("chunk_id", F.sum("fresh").over(w).cast("int")).drop("fresh")


def chunk_individual(cues: DataFrame, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    return cues.withColumn("chunk_id", (F.row_number().over(Window.partitionBy("media_id").orderBy(*order)) - 1).cast("int"))


def chunk_bounds(cues: DataFrame, order: str = "pos") -> DataFrame:
    """media_id, chunk_id, start_ms (first row's), end_ms (last row's), n."""
    return cues.groupBy("media_id", "chunk_id").agg(F.min_by("start_ms", order).alias("start_ms"), F.max_by("end_ms", order).alias("end_ms"), F.count("*").alias("n"))


def snap_chunks(chunks: DataFrame, speech: DataFrame, config: SyncConfig = SyncConfig()) -> DataFrame:
    """chunks with new_start and new_end."""
    c = config
    keyed = chunks.withColumnRenamed("chunk_id", "id")
    starts = intervals.best_boundary(keyed.select("media_id", "id", F.col("start_ms").alias("boundary")), speech, c.lookback_start_ms, c.lookahead_start_ms, c.pad_ms, True)
    ends = intervals.best_boundary(keyed.select("media_id", "id", F.col("end_ms").alias("boundary")), speech, c.lookback_end_ms, c.lookahead_end_ms, c.pad_ms, False)
    near = keyed.join(starts.select("media_id", "id", F.col("new_boundary").alias("to_start"), F.col("score").alias("start_score")), ["media_id", "id"]).join(ends.select("media_id", "id", F.col("new_boundary").alias("to_end"), F.col("score").alias("end_score")), ["media_id", "id"])
    order = Window.partitionBy("media_id").orderBy("id")
    near = near.withColumn("before", F.lag("end_ms").over(order)).withColumn("after", F.lead("start_ms").over(order))
    new_start, new_end = _snapped(c)
    return near.select("media_id", F.col("id").alias("chunk_id"), "start_ms", "end_ms", "n", new_start.alias("new_start"), new_end.alias("new_end"))


def _snapped(c: SyncConfig, start: str = "start_ms", end: str = "end_ms") -> tuple[Column, Column]:
    """New ends of a chunk, from to_start, start_score, to_end, end_score (null and 0 without a segment near), before and after (null at the ends of a medium)."""
    moved_start = F.greatest(F.least("to_start", F.col(start) + c.max_left_expand_ms), F.col(start) - c.max_left_shift_ms)
    moved_end = F.greatest(F.least("to_end", F.col(end) + c.max_right_expand_ms), F.col(end) - c.max_right_shift_ms)
    s = F.when(F.col("to_start").isNotNull() & (F.col("start_score") >= c.threshold_score), F.greatest(moved_start, F.col("before"))).otherwise(F.col(start))
    e = F.when(F.col("to_end").isNotNull() & (F.col("end_score") >= c.threshold_score), F.least(moved_end, F.col("after"))).otherwise(F.col(end))
    short = e - s < c.min_entry_duration_ms
    return F.when(short, F.col(start)).otherwise(s), F.when(short, F.col(end)).otherwise(e)


_ENTRY = ("entry_index", "start_ms", "end_ms", "text")


def apply_edge_only(cues: DataFrame, snapped: DataFrame) -> DataFrame:
    """The first entry of a chunk gets its new start, the last its new end; entries equal to them, too."""
    entry = F.struct(*_ENTRY)
    ends = cues.groupBy("media_id", "chunk_id").agg(F.min_by(entry, "pos").alias("first"), F.max_by(entry, "pos").alias("last"))
    joined = cues.join(ends, ["media_id", "chunk_id"]).join(snapped.select("media_id", "chunk_id", "new_start", "new_end"), ["media_id", "chunk_id"])
    return joined.select(*[c for c in cues.columns if c not in ("start_ms", "end_ms")], F.when(entry.eqNullSafe(F.col("first")), F.col("new_start")).otherwise(F.col("start_ms")).alias("start_ms"), F.when(entry.eqNullSafe(F.col("last")), F.col("new_end")).otherwise(F.col("end_ms")).alias("end_ms"))


def apply_proportional(cues: DataFrame, snapped: DataFrame) -> DataFrame:
    """Positions scaled about the chunk's start; chunks of no length stay."""
    at = snapped.select("media_id", "chunk_id", F.col("start_ms").alias("c_start"), F.col("end_ms").alias("c_end"), "new_start", "new_end")
    joined = cues.join(at, ["media_id", "chunk_id"])
    scale = (F.col("new_end") - F.col("new_start")) / (F.col("c_end") - F.col("c_start"))
    moved = lambda x: F.when(F.col("c_end") > F.col("c_start"), F.col("new_start") + (F.col(x) - F.col("c_start")) * scale).otherwise(F.col(x)).alias(x)
    return joined.select(*[c for c in cues.columns if c not in ("start_ms", "end_ms")], moved("start_ms"), moved("end_ms"))


def _fold(rows: DataFrame, order: tuple[str, ...], numbers: tuple[str, ...], step: Callable[[list[list], int], None]) -> DataFrame:
    """Ordered fold over the rows of each run (columns media_id and run): ``step`` gets the columns of ``numbers`` as lists, and the place of a row
    whose run began before it; it changes that row and the one before.

    Runs are dealt over all tasks, and a task holds one row besides its Arrow batches, however long a run is.  Other columns are passed on as they came,
    and so are all columns of batches in which every row begins a run.
    """
    names, schema = rows.columns, rows.schema

    def same(column: pa.Array) -> np.ndarray:
        before, after = column.slice(0, len(column) - 1), column.slice(1)
        return pc.if_else(pc.and_(before.is_null(), after.is_null()), True, pc.fill_null(pc.equal(before, after), False)).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch.cast(held.schema)])
            if batch.num_rows > 1 and len(at := np.flatnonzero(same(batch["media_id"]) & same(batch["run"])) + 1):
                lists = [batch[n].to_pylist() for n in numbers]
                for i in at.tolist():
                    step(lists, i)
                for n, values in zip(numbers, lists):
                    batch = batch.set_column(names.index(n), batch.schema.field(n), pa.array(values, batch.schema.field(n).type))
            if batch.num_rows:
                yield batch.slice(0, batch.num_rows - 1)
                held = batch.slice(batch.num_rows - 1)
        if held is not None:
            yield held

    return rows.repartition("media_id", "run").sortWithinPartitions("media_id", "run", *order).mapInArrow(run, schema).drop("run")


def _runs(rows: DataFrame, order: tuple[str, ...], fresh: Callable[[Window], Column]) -> DataFrame:
    """rows with run: it begins where ``fresh`` is true, or null as on the first row of a medium."""
    w = Window.partitionBy("media_id").orderBy(*order)
    return rows.withColumn("run", F.coalesce(fresh(w), F.lit(True)).cast("long")).withColumn("run", F.sum("run").over(w))


def fix_overlaps(cues: DataFrame, min_duration: float = 300, min_gap: float = 10, untouched: Column | None = None) -> DataFrame:
    """Where an entry begins before the end of the one before, both are cut about the middle, with a least length each.

    untouched: media that stay as they are.  An entry that begins later depends on nothing before it: entries are folded run by run.
    """

    def step(lists: list[list], i: int) -> None:
        starts, ends = lists
        if ends[i - 1] is None or starts[i] is None or not ends[i - 1] > starts[i]:
            return
        middle = (ends[i - 1] + starts[i]) / 2
        end, start = middle - min_gap / 2, middle + min_gap / 2
        if end - starts[i - 1] < min_duration:
            end, start = starts[i - 1] + min_duration, starts[i - 1] + min_duration + min_gap
        if ends[i] - start < min_duration:
            start, end = ends[i] - min_duration, ends[i] - min_duration - min_gap
        ends[i - 1], starts[i] = max(starts[i - 1] + min_duration, end), min(ends[i] - min_duration, start)

    order = ("entry_index", "pos")
    alone = F.lit(False) if untouched is None else untouched
    rows = cues.select("media_id", "entry_index", "pos", F.col("start_ms").cast("double"), F.col("end_ms").cast("double"), "text", alone.alias("alone"))
    return _fold(_runs(rows, order, lambda w: F.col("alone") | ~(F.lag("end_ms").over(w) > F.col("start_ms"))).drop("alone"), order, ("start_ms", "end_ms"), step)


def overlap_count(cues: DataFrame) -> DataFrame:
    order = Window.partitionBy("media_id").orderBy("entry_index", "pos")
    return cues.withColumn("over", F.lag("end_ms").over(order) > F.col("start_ms")).groupBy("media_id").agg(F.count_if("over").alias("overlaps"))


#: A block of packing spans so many times the limit.
PACK_BLOCK = 64


def _block_groups(start: np.ndarray, end: np.ndarray, first: float, max_ms: float) -> dict:
    """What a block of segments makes of the group that is open before it.

    A group opens at the first short segment that ends further than the limit from the start of the group before.  That segment ends later than all short ones before
    it, so only such ones are listed, up to the first that no earlier group could take (``first``: where the block begins): their ends, and for each the start of the
    last group of the block and the number of groups, if a group opens there.
    """
    short = np.flatnonzero(end - start < max_ms)
    begin, latest = start[short], np.maximum.accumulate(end[short]) if len(short) else end[short]

    def next_of(at: np.ndarray) -> np.ndarray:
        found = np.searchsorted(latest, at + max_ms, "right")
        for shift in (-1, 1):  # the sum above may be rounded another way than the difference
            while True:
                near = np.clip(found + min(shift, 0), 0, max(len(latest) - 1, 0))
                beyond = latest[near] - at > max_ms if len(latest) else np.zeros(len(at), bool)
                wrong = (found > 0) & beyond if shift < 0 else (found < len(latest)) & ~beyond
                if not wrong.any():
                    break
                found = found + shift * wrong
        return found

    following, last, count = next_of(begin), begin.copy(), np.ones(len(short), np.int64)
    for j in range(len(short) - 1, -1, -1):
        if (k := following[j]) < len(short):
            last[j], count[j] = last[k], count[k] + 1
    new = np.flatnonzero(np.diff(latest, prepend=-np.inf) > 0)
    wide = np.flatnonzero(latest[new] - first > max_ms)
    new = new[: wide[0] + 1] if len(wide) else new
    k = int(next_of(start[:1])[0])
    fresh = (float(last[k]), int(count[k]) + 1) if k < len(short) else (float(start[0]), 1)
    return {"ends": latest[new].tolist(), "last": last[new].tolist(), "count": count[new].tolist(), "fresh_last": fresh[0], "fresh_count": fresh[1]}


def _open_groups(rows: DataFrame, max_ms: float) -> DataFrame:
    """media_id, block, group_start, groups: the group that is open before each block but a medium's first, and how many have opened. rows: media_id, block, start_ms, seg_id, end_ms."""
    media_type = rows.schema["media_id"].dataType.simpleString()
    blocks = f"media_id {media_type}, block long, ends array<double>, last array<double>, count array<long>, fresh_last double, fresh_count long"

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("start_ms", "ascending"), ("seg_id", "ascending")])
        made = _block_groups(table["start_ms"].to_numpy(), table["end_ms"].to_numpy(), key[1].as_py() * PACK_BLOCK * max(max_ms, 1.0), max_ms)
        return pa.Table.from_pylist([{"media_id": key[0].as_py(), "block": key[1].as_py()} | made], arrow)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        media = start = groups = None
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                if groups is None or b["media_id"] != media:
                    media, start, groups = b["media_id"], b["fresh_last"], b["fresh_count"]
                    continue
                out.append({"media_id": media, "block": b["block"], "group_start": start, "groups": groups})
                at = next((k for k, e in enumerate(b["ends"]) if e - start > max_ms), None)
                if at is not None:
                    start, groups = b["last"][at], groups + b["count"][at]
            yield pa.RecordBatch.from_pylist(out, state)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    states = f"media_id {media_type}, block long, group_start double, groups long"
    arrow, state = (to_arrow_schema(StructType.fromDDL(x)) for x in (blocks, states))
    made = rows.groupBy("media_id", "block").applyInArrow(summed, blocks)
    return made.repartition("media_id").sortWithinPartitions("media_id", "block").mapInArrow(opened, states)


def pack_speech(speech: DataFrame, max_ms: float) -> DataFrame:
    """media_id, start_ms, seg_id, end_ms, group_start, group_id (from 0): a segment joins while the group stays within the limit, or if it alone reaches it.

    Media are cut into blocks of time, which are dealt over all tasks.  Where a medium has several, each block first says what it would make of any group that is open
    before it, in a few numbers; these are followed from block to block, and then every block is packed from the group that is open there.
    """
    ship_package(speech.sparkSession)
    block = F.floor(F.col("start_ms") / (PACK_BLOCK * max(max_ms, 1.0))).alias("block")
    rows = speech.select("media_id", F.col("start_ms").cast("double"), "seg_id", F.col("end_ms").cast("double"), block)
    several = rows.groupBy("media_id").agg((F.min("block") < F.max("block")).alias("several")).where("several").select("media_id")
    opened = _open_groups(rows.join(several, "media_id", "left_semi"), max_ms)
    names = ["media_id", "start_ms", "seg_id", "end_ms", "group_start", "group_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        media = at = start = group = None
        for batch in batches:
            where = list(zip(batch["media_id"].to_pylist(), batch["block"].to_pylist()))
            starts, groups = [], []
            for i, (b, e, before, opened_so_far) in enumerate(zip(*(batch[c].to_pylist() for c in ("start_ms", "end_ms", "group_start", "groups")))):
                if group is None or where[i] != (media, at):
                    (media, at), start, group = where[i], before, -1 if before is None else opened_so_far - 1
                if start is None or not (e - start <= max_ms or e - b >= max_ms):
                    start, group = b, group + 1
                starts.append(start)
                groups.append(group)
            columns = [batch[c] for c in names[:4]] + [pa.array(starts, pa.float64()), pa.array(groups, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    dealt = rows.join(opened, ["media_id", "block"], "left").repartition("media_id", "block").sortWithinPartitions("media_id", "block", "start_ms", "seg_id")
    return dealt.mapInArrow(pack, ", ".join(f"{n} {fields[n]}" for n in names[:4]) + ", group_start double, group_id int")


def split_plan(speech: DataFrame, media: DataFrame, minutes: float) -> DataFrame:
    """media_id, idx (from 1, gaps kept), start_s, end_s, duration_s; media without speech: one whole range. media: media_id, duration_ms."""
    packed = pack_speech(speech, max(1.0, minutes * 60) * 1000)
    groups = packed.groupBy("media_id", "group_id").agg(F.min("group_start").alias("s"), F.max_by("end_ms", F.struct("start_ms", "seg_id")).alias("e"))
    plain = media.join(speech.select("media_id").distinct(), "media_id", "left_anti").select("media_id", F.lit(0).alias("group_id"), F.lit(0.0).alias("s"), F.col("duration_ms").alias("e"))
    r = lambda x: F.bround(x / 1000, 3)
    return groups.unionByName(plain).where("e > s").select("media_id", (F.col("group_id") + 1).alias("idx"), r(F.col("s")).alias("start_s"), r(F.col("e")).alias("end_s"), r(F.col("e") - F.col("s")).alias("duration_s"))


def utterance_segments(speech: DataFrame, media: DataFrame, min_s: float = 0.5) -> DataFrame:
    """One output a segment, numbered before short ones go; media without speech: one whole range."""
    w = Window.partitionBy("media_id").orderBy("start_ms", "seg_id")
    own = speech.select("media_id", F.row_number().over(w).alias("idx"), (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s")).where(F.col("end_s") - F.col("start_s") > min_s)
    plain = media.join(speech.select("media_id").distinct(), "media_id", "left_anti").select("media_id", F.lit(1).alias("idx"), F.lit(0.0).alias("start_s"), (F.col("duration_ms") / 1000).alias("end_s"))
    return own.unionByName(plain)


def monotone_clamp(entries: DataFrame, media: DataFrame, min_s: float = 0.001) -> DataFrame:
    """entries (media_id, clip_index, start_s, end_s, text) in order of start, none before the end of the one before; media without any: a default row."""
    empty = media.select("media_id").join(entries.select("media_id").distinct(), "media_id", "left_anti")
    default = empty.select("media_id", F.lit(0).cast(entries.schema["clip_index"].dataType).alias("clip_index"), F.lit(0.0).alias("start_s"), F.lit(0.5).alias("end_s"), F.lit(NO_SPEECH).alias("text"))
    rows = entries.select("media_id", "clip_index", "start_s", "end_s", "text").unionByName(default).withColumn("at", F.col("start_s"))
    fit = lambda start, end: F.when(end <= start, start + min_s).otherwise(end)
    rows = rows.withColumn("start_s", F.greatest("start_s", F.lit(0.0))).withColumn("end_s", fit(F.col("start_s"), F.col("end_s")))

    def step(lists: list[list], i: int) -> None:
        starts, ends = lists
        starts[i] = max(starts[i], ends[i - 1])
        if ends[i] <= starts[i]:
            ends[i] = starts[i] + min_s

    # each entry before can have pushed an end by ``min_s`` at most
    order = ("at", "clip_index")
    clear = lambda w: F.col("start_s") >= F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1)) + F.row_number().over(w) * min_s + 1e-6
    return _fold(_runs(rows, order, clear), order, ("start_s", "end_s"), step).drop("at")


def prepared_speech(speech: DataFrame, config: SyncConfig = SyncConfig()) -> DataFrame:
    return intervals.filter_short_segments(intervals.merge_close_segments(intervals.valid_segments(speech), config.merge_gap_ms), config.min_speech_ms)


def _retimed(cues: DataFrame, speech: DataFrame, c: SyncConfig, keep_silent: bool = False) -> DataFrame:
    """Cues after the removal of silent ones and the snapping of chunks, with what the statistics count.

    media_id, pos, entry_index, start_ms, end_ms, text, vad_segments (null: no speech, the row is as it came), silent (kept if
    ``keep_silent``, apart from the others), fresh (first of a chunk), corrected (the chunk moved).  One set of rows goes through: a row carries what it needs to the
    next step, so that nothing is computed twice and joined back.
    """
    segments = prepared_speech(speech, c)
    rows = cues.select("media_id", "pos", *_ENTRY).join(segments.groupBy("media_id").agg(F.count("*").alias("vad_segments")), "media_id", "left")
    if c.remove_silent_entries:
        rows = intervals.mark_silent_entries(rows, segments, c.min_coverage_ratio, c.min_coverage_ms, c.min_silence_entry_ms, F.col("vad_segments").isNotNull())
        rows = rows if keep_silent else rows.where("NOT silent")
    else:
        rows = rows.withColumn("silent", F.lit(False))
    w = Window.partitionBy("media_id", "silent").orderBy("pos")
    rows = rows.withColumns({"before": F.lag("end_ms").over(w), "after": F.lead("start_ms").over(w)})
    opens = F.coalesce(F.col("start_ms") - F.col("before") > c.gap_threshold_ms, F.lit(True)) if c.chunk_mode == "grouped" else F.lit(True)
    rows = rows.withColumn("fresh", opens).withColumn("chunk_id", F.sum(F.col("fresh").cast("int")).over(w))
    whole = Window.partitionBy("media_id", "silent", "chunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct(*_ENTRY)
    rows = rows.withColumns({"c_start": F.first("start_ms").over(whole), "c_end": F.last("end_ms").over(whole), "before": F.first("before").over(whole), "after": F.last("after").over(whole), "as_first": entry.eqNullSafe(F.first(entry).over(whole)), "as_last": entry.eqNullSafe(F.last(entry).over(whole))})
    # both boundaries of a chunk are searched in one join, from its first row
    width = max(intervals.BUCKET_MS, 2 * (c.lookback_start_ms + c.lookahead_start_ms), 2 * (c.lookback_end_ms + c.lookahead_end_ms))
    near = lambda at, back, ahead: F.sequence(F.floor((F.col(at) - back) / width), F.floor((F.col(at) + ahead) / width))
    wanted = F.when(F.col("fresh") & ~F.col("silent") & F.col("vad_segments").isNotNull(), F.array_union(near("c_start", c.lookback_start_ms, c.lookahead_start_ms), near("c_end", c.lookback_end_ms, c.lookahead_end_ms)))
    a = rows.select(F.struct(*rows.columns).alias("row"), "media_id", "pos", "c_start", "c_end", F.explode_outer(wanted).alias("bucket")).alias("a")
    b = segments.select("media_id", "seg_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor(F.greatest("start_ms", "end_ms") / width))).alias("bucket")).alias("b")
    at_start = (F.col("e") >= F.col("c_start") - c.lookback_start_ms) & (F.col("s") <= F.col("c_start") + c.lookahead_start_ms)
    at_end = (F.col("e") >= F.col("c_end") - c.lookback_end_ms) & (F.col("s") <= F.col("c_end") + c.lookahead_end_ms)
    pairs = a.join(b, (F.col("a.media_id") == F.col("b.media_id")) & (F.col("a.bucket") == F.col("b.bucket")) & (at_start | at_end), "left")

    def best(use: Column, target: str, boundary: str, pad: float) -> Column:
        score = intervals.boundary_score(F.col(target), F.col(boundary), F.col("s"), F.col("e"))
        return F.max_by(F.struct((F.col(target) + pad).alias("moved"), score.alias("score")), F.when(use, F.struct(score, -F.col("s"), -F.col("seg_id"))))

    found = pairs.groupBy("a.media_id", "a.pos").agg(F.first("row").alias("row"), best(at_start, "s", "c_start", -c.pad_ms).alias("to_s"), best(at_end, "e", "c_end", c.pad_ms).alias("to_e"))
    found = found.select("row.*", "to_s", "to_e").withColumns({"to_s": F.first("to_s").over(whole), "to_e": F.first("to_e").over(whole)})
    found = found.withColumns({"to_start": F.col("to_s.moved"), "start_score": F.coalesce("to_s.score", F.lit(0.0)), "to_end": F.col("to_e.moved"), "end_score": F.coalesce("to_e.score", F.lit(0.0))})
    new_start, new_end = _snapped(c, "c_start", "c_end")
    found = found.withColumns({"new_start": new_start, "new_end": new_end})
    if c.entry_mode == "edge-only":
        start, end = (F.when(F.col(flag), F.col(new)).otherwise(F.col(old)) for flag, new, old in (("as_first", "new_start", "start_ms"), ("as_last", "new_end", "end_ms")))
    else:
        scale = (F.col("new_end") - F.col("new_start")) / (F.col("c_end") - F.col("c_start"))
        start, end = (F.when(F.col("c_end") > F.col("c_start"), F.col("new_start") + (F.col(x) - F.col("c_start")) * scale).otherwise(F.col(x)) for x in ("start_ms", "end_ms"))
    spoken = F.col("vad_segments").isNotNull()
    corrected = (F.abs(F.col("new_start") - F.col("c_start")) > 1) | (F.abs(F.col("new_end") - F.col("c_end")) > 1)
    return found.select("media_id", "pos", "entry_index", F.when(spoken, start).otherwise(F.col("start_ms")).alias("start_ms"), F.when(spoken, end).otherwise(F.col("end_ms")).alias("end_ms"), "text", "vad_segments", "silent", "fresh", (F.col("fresh") & corrected).alias("corrected"))


def sync_pipeline(cues: DataFrame, speech: DataFrame, config: SyncConfig = SyncConfig()) -> DataFrame:
    """Cues re-timed to speech: media_id, entry_index, start_ms, end_ms, text; media without speech come back unchanged."""
    rows = _retimed(cues, speech, config)
    columns = ["media_id", "entry_index", "start_ms", "end_ms", "text"]
    if not config.fix_overlaps:
        return rows.select(*columns)
    return fix_overlaps(rows, config.min_entry_duration_ms, config.min_gap_ms, F.col("vad_segments").isNull()).select(*columns)


def sync_stats(cues: DataFrame, speech: DataFrame, config: SyncConfig = SyncConfig()) -> DataFrame:
    """A row for each medium: status, entries, chunks, vad_segments, corrections, overlaps_fixed, silent_removed."""
    order = Window.partitionBy("media_id", "silent").orderBy("entry_index", "pos")
    rows = _retimed(cues, speech, config, keep_silent=True).withColumn("over", F.lag("end_ms").over(order) > F.col("start_ms"))
    left = ~F.col("silent")
    counts = rows.groupBy("media_id").agg(F.max("vad_segments").alias("spoken"), F.count("*").alias("n_before"), F.count_if(left).alias("left"), *[F.count_if(left & F.col(x)).alias(x) for x in ("fresh", "corrected", "over")])
    of = lambda x: F.when(F.col("spoken").isNotNull(), F.col(x)).otherwise(0).cast("long")
    return counts.select("media_id", F.when(F.col("spoken").isNull(), "no_segments").otherwise("success").alias("status"), F.col("left").alias("entries"), of("fresh").alias("chunks"), of("spoken").alias("vad_segments"), of("corrected").alias("corrections"), of("over").alias("overlaps_fixed"), (F.col("n_before") - F.col("left")).alias("silent_removed"))


def cleanup_pipeline(cues: DataFrame, speech: DataFrame, config: SyncConfig = SyncConfig()) -> DataFrame:
    """Only the silence removal: media_id, total_entries, kept, removed."""
    kept = intervals.remove_silent_entries(cues, intervals.valid_segments(speech), config.min_coverage_ratio, config.min_coverage_ms, config.min_silence_entry_ms)
    n = kept.groupBy("media_id").agg(F.count("*").alias("kept"))
    out = cues.groupBy("media_id").agg(F.count("*").alias("total_entries")).join(n, "media_id", "left")
    return out.select("media_id", "total_entries", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("total_entries") - F.coalesce("kept", F.lit(0))).alias("removed"))
