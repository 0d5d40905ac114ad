"""Structured Streaming twins of the operators, for updates that arrive continuously.

Every job takes a streaming (or batch) DataFrame and returns one; the watermark is a parameter, since the
data has an event time of its own and no rule for late rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.replies import entry_of, reply_entries, scan_objects
from ..operators.responses import FAILED_TEXT, parse_event_lines
from ..operators.sync import chunk_by_gap


#: The store that keyed state needs: Spark's own, on local disks of executors and checkpointed with the stream.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str = "append", time: str = "processingTime") -> DataFrame:
    """Keyed state with timers and life times; the session gets the state store that these need."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, time)


class _Replies(StatefulProcessor):
    """The text of each reply that isn't done with yet; a reply that gets nothing more for ``ttl_ms`` is forgotten."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getValueState("buffer", "text string", self.ttl_ms or None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values("seq")
        kept = self.buffer.get()[0] if self.buffer.exists() else ""
        found, rest = scan_objects(kept + "".join(came["fragment"].dropna()))
        if rest:
            self.buffer.update((rest,))
        elif kept:
            self.buffer.clear()
        entries = [(*key, *e) for o in found if (e := entry_of(o))]
        yield pd.DataFrame(entries, columns=["file_id", "attempt", "entry_index", "text"])

    def close(self) -> None:
        pass


REPLY_ENTRY = "file_id long, attempt int, entry_index int, text string"


def stream_json_objects(fragments: DataFrame, ttl: timedelta = timedelta(hours=1)) -> DataFrame:
    """file_id, attempt, entry_index, text of the objects in fragments of replies (file_id, attempt, seq, fragment).

    State is what a reply (a file's attempt) has of an unfinished object, kept until nothing came for ``ttl`` (0: for ever).
    Fragments of a batch come in the order of seq, those of a later batch after them.  Objects nested in one, before or behind its index, belong
    to it; objects that aren't JSON, and those whose index is no whole number, are left out; what follows them is read.  A null fragment is empty.
    """
    return _keyed(fragments, ["file_id", "attempt"], _Replies(int(ttl.total_seconds() * 1000)), REPLY_ENTRY)


def join_json_objects(fragments: DataFrame) -> DataFrame:
    """The batch twin: fragments in order as one text, and its objects, by the same scanner."""
    rows = fragments.groupBy("file_id", "attempt").agg(F.array_sort(F.collect_list(F.struct("seq", "fragment"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["fragment"]), "")
    return rows.select("file_id", "attempt", F.inline(reply_entries(text)))


def stream_dedupe_results(results: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The first result of each file and index. results: file_id, entry_index, text, at."""
    return results.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["file_id", "entry_index"]) if results.isStreaming else results.groupBy("file_id", "entry_index").agg(F.min_by(F.struct("text", "at"), "at").alias("r")).select("file_id", "entry_index", "r.*")


#: Buckets of a table of last results, unless a job says otherwise, and rows that a file (and so a task that writes one) has at most, but for the unevenness of hashes.
BUCKETS, FILE_ROWS = 64, 500_000


class LastResults:
    """A table of the last result of each key, in buckets by its hash; a bucket is one file, or several once it has more than ``FILE_ROWS`` rows.

    ``merge`` writes the buckets that a batch touches anew, as a version of the number of the batch, and
    takes away what they replace.  A version counts once it is whole; a batch that is tried again changes nothing.
    """

    def __init__(self, path: str, keys: tuple[str, ...] = ("file_id", "entry_index"), buckets: int = BUCKETS):
        self.path, self.keys, self.buckets = path, keys, buckets

    def _list(self, spark: SparkSession, folder: str) -> list[str]:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []

    def _versions(self, spark: SparkSession) -> list[int]:
        named = (n.removeprefix("version=") for n in self._list(spark, self.path))
        return sorted(int(n) for n in named if n.isdigit() and "_SUCCESS" in self._list(spark, f"{self.path}/version={n}"))

    def _current(self, spark: SparkSession) -> dict[int, str]:
        """The folder of each bucket: that of its last version."""
        found = {}
        for version in self._versions(spark):
            for name in self._list(spark, f"{self.path}/version={version}"):
                if name.startswith("bucket="):
                    found[int(name.removeprefix("bucket="))] = f"{self.path}/version={version}/{name}"
        return found

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        folders = list(self._current(spark).values())
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in self._versions(spark):
            return
        hashed = F.xxhash64(*self.keys)
        bucket = F.pmod(hashed, F.lit(self.buckets)).cast("int").alias("bucket")
        came = {r["bucket"]: r["count"] for r in batch.groupBy(bucket).count().collect()}
        touched, current = sorted(came), self._current(spark)
        old = [current[b] for b in touched if b in current]
        new = _last(batch, self.keys)
        kept = spark.read.schema(new.schema).parquet(*old) if old else None
        rows = new if kept is None else _last(new.unionByName(kept), self.keys)
        # a task, and so a file, for each piece of a bucket: a bucket's share of the same hash, cut further
        pieces = max(1, math.ceil((sum(came.values()) + (kept.count() if old else 0)) / max(1, len(touched)) / FILE_ROWS))
        place = F.array_position(F.array(*map(F.lit, touched)), F.col("bucket")) - 1
        piece = F.floor(F.pmod(hashed, F.lit(self.buckets * pieces)) / self.buckets)
        tasks = max(1, len(touched)) * pieces
        rows.withColumn("bucket", bucket).repartitionById(tasks, (place * pieces + piece).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={number}")
        for folder in old:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def store_last_results(results: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """The started query that keeps a table of the last result of each file and index (``LastResults``). results: file_id, entry_index, text, at."""
    table = LastResults(path, buckets=buckets)
    return results.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).start()


def last_results(spark: SparkSession, path: str) -> DataFrame:
    return LastResults(path).read(spark, StructType.fromDDL("file_id long, entry_index int, text string, at timestamp"))


def _last(results: DataFrame, keys: tuple[str, ...] = ("file_id", "entry_index")) -> DataFrame:
    return results.groupBy(*keys).agg(F.max_by(F.struct("text", "at"), F.struct("at", "text")).alias("r")).select(*keys, "r.*")


RESULT = "file_id long, batch_no int, entry_index int, translated string, attempt int, error boolean"


#: Buckets of keyed state that is kept for many small keys together, unless a job says otherwise; fixed for as long as a stream's checkpoint lives.
STATE_BUCKETS = 512


class _Attempts(StatefulProcessor):
    """Of a bucket of batches: the entries that have no reply yet, with their originals, and when each batch is given up; a batch that is done with has no state.

    State is asked for once a bucket, not once a batch: each call to it goes from Python to the JVM and back.
    """

    STATE = pa.schema([("file_id", pa.int64()), ("batch_no", pa.int64()), ("entry_index", pa.int64()), ("original", pa.string()), ("due_ms", pa.int64())])

    def __init__(self, most: int, patience_ms: int, failed_text: str):
        self.most, self.patience_ms, self.failed_text = most, patience_ms, failed_text

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("missing", "rows binary")

    def _load(self) -> tuple[dict, dict]:
        """The missing entries of each batch, and its due time."""
        missing, due = {}, {}
        if held := self.held.get():
            table = pa.ipc.open_stream(pa.py_buffer(held[0])).read_all()
            for file, batch, index, original, at in zip(*(c.to_pylist() for c in table.columns)):
                missing.setdefault((file, batch), {})[index] = original
                due[file, batch] = at
        return missing, due

    def _keep(self, missing: dict, due: dict, timer: int | None) -> None:
        """Keeps what is missing, and one timer, for the batch that is due first. timer: the one that there is."""
        first = min(due.values(), default=None)
        if self.patience_ms and timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if missing:
            rows = [(*which, index, original, due[which]) for which, entries in missing.items() for index, original in entries.items()]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.STATE) as out:
                out.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), self.STATE)], schema=self.STATE))
            self.held.update((sink.getvalue().to_pybytes(),))
        else:
            self.held.clear()

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["file_id", "batch_no", "entry_index", "translated", "attempt", "error"]).astype({"attempt": "Int32"})

    def _failures(self, which: tuple, entries: dict) -> list[tuple]:
        return [(*which, index, self.failed_text, None, True) for index in sorted(entries)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values(["attempt", "seq"], na_position="last")
        missing, due = self._load()
        timer, until = min(due.values(), default=None), timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
        done, out = set(), []
        columns = (came[c].tolist() for c in ("file_id", "batch_no", "requested", "entry_index", "text", "attempt"))
        for file, batch, requested, index, text, attempt in zip(*columns):
            which = file, batch
            if which in done:
                continue
            if (entries := missing.get(which)) is None:
                entries = missing[which] = {r["entry_index"]: r.get("original") for r in json.loads(requested)}
            due[which] = until
            if index is not None and index == index:  # not null
                if (index := int(index)) in entries:
                    original = entries.pop(index)
                    out.append((file, batch, index, text if isinstance(text, str) else original, int(attempt), False))
            elif attempt >= self.most:
                out += self._failures(which, entries)
                entries.clear()
            if not entries:
                done.add(which)
                del missing[which], due[which]
        self._keep(missing, due, timer)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        missing, due = self._load()
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for which in [w for w, at in due.items() if at <= now]:
            out += self._failures(which, missing.pop(which))
            del due[which]
        self._keep(missing, due, None)
        yield self._frame(out)

    def close(self) -> None:
        pass


def stream_attempts(responses: DataFrame, most: int = 5, patience: timedelta = timedelta(hours=1), failed_text: str = FAILED_TEXT, buckets: int = STATE_BUCKETS) -> DataFrame:
    """file_id, batch_no, entry_index, translated, attempt, error: the first reply to each entry of a batch, as it comes, and an error row for each that gets none.

    responses: file_id, batch_no, requested (array of entry_index, original), attempt, seq, entry_index, text.  A row whose entry_index is null says that the attempt has
    ended; when attempt ``most`` has, or when nothing came for ``patience`` (0: wait for ever), the entries that are missing have failed.  Replies without a text stand for the
    original; replies to what wasn't asked, and more than one to an entry, are left out.  A batch of which all entries are answered or failed
    leaves no state, and rows that come for it later begin it anew.

    State is kept for ``buckets`` hashes of batches: what is missing of a bucket is read and written once a micro-batch, and a task holds one bucket at a time.
    """
    bucket = F.pmod(F.xxhash64("file_id", "batch_no"), F.lit(buckets)).cast("int").alias("bucket")
    rows = responses.select(bucket, "file_id", "batch_no", F.to_json("requested").alias("requested"), "attempt", "seq", "entry_index", "text")
    return _keyed(rows, ["bucket"], _Attempts(most, int(patience.total_seconds() * 1000), failed_text), RESULT)


def stream_progress(events: DataFrame) -> DataFrame:
    """file_id, received, completed: running counts of result lines (update mode)."""
    rows = parse_event_lines(events)
    return rows.groupBy("file_id").agg(F.count("index").alias("received"), F.max(F.col("file_completed").isNotNull()).alias("completed"))


def stream_batch_state(updates: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """batch_id with its newest status and message, and how many updates came. updates: batch_id, status, message, at."""
    source = updates.withWatermark("at", watermark) if updates.isStreaming else updates
    return source.groupBy("batch_id").agg(F.max_by(F.struct("status", "message"), F.struct("at", "status", "message")).alias("s"), F.count("*").alias("updates")).select("batch_id", "s.status", "s.message", "updates")


#: Fixed: states in which a batch has ended; updates that a subscriber's queue holds.
ENDED, QUEUE = ("completed", "failed"), 32


class _Updates(StatefulProcessor):
    """The last updates of each batch that goes on."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getListState("queue", "message string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values(["at", "seq"])
        queue, out, status = [m[0] for m in self.queue.get()] if self.queue.exists() else [], [], None
        for status, message in zip(came["status"], came["message"]):
            queue = [*queue, message][-self.keep :]
            if status in ENDED:
                out.append((key[0], status, queue))
                queue = []
        if queue:
            self.queue.put([(m,) for m in queue])
            out.append((key[0], status, queue))
        elif self.queue.exists():
            self.queue.clear()
        yield pd.DataFrame(out, columns=["batch_id", "status", "queue"])

    def close(self) -> None:
        pass


def stream_last_updates(updates: DataFrame, keep: int = QUEUE) -> DataFrame:
    """batch_id, status, queue: whenever updates of a batch come, its newest status and its last ``keep`` messages, the oldest dropped. updates: batch_id, status, message, at, seq.

    An update that a batch is completed or has failed is its last: its queue is given out as it is then, and forgotten; updates after that begin a new one.
    """
    return _keyed(updates, ["batch_id"], _Updates(keep), "batch_id long, status string, queue array<string>")


def last_updates(updates: DataFrame, keep: int = QUEUE) -> DataFrame:
    """The batch twin: batch_id, status, queue at each end."""
    w = Window.partitionBy("batch_id").orderBy("at", "seq")
    ended = F.col("status").isin(*ENDED)
    run = F.coalesce(F.sum(ended.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = updates.withColumn("run", run).withColumn("back", F.row_number().over(Window.partitionBy("batch_id", "run").orderBy(F.desc("at"), F.desc("seq")))).where(F.col("back") <= keep)
    last = rows.groupBy("batch_id", "run").agg(F.max_by("status", F.struct("at", "seq")).alias("status"), F.array_sort(F.collect_list(F.struct("at", "seq", "message"))).alias("q"))
    return last.where(ended).select("batch_id", "status", F.transform("q", lambda x: x["message"]).alias("queue"))


def _used(panes: dict[int, int], after: int, upto: int, span: int) -> list[tuple[int, int]]:
    """until, used of the windows of ``span`` seconds that end after ``after``, up to ``upto``, and hold a request. panes: requests of each second, by its end."""
    out, used, changes = [], 0, {}
    for end, n in panes.items():
        changes[end] = changes.get(end, 0) + n
        changes[end + span] = changes.get(end + span, 0) - n
    points = sorted(changes)
    for point, following in zip(points, [*points[1:], None]):
        used += changes[point]
        if used and following is not None:
            out += [(until, used) for until in range(max(point, after + 1), min(following, upto + 1))]
    return out


class _Rate(StatefulProcessor):
    """Of each client, the requests of each second that windows to come still hold, and how far windows were given out."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "until long", "n long")
        self.given = handle.getValueState("given", "until long")

    def _advance(self, key, panes: dict[int, int], watermark_s: int) -> pd.DataFrame:
        given = self.given.get()[0] if self.given.exists() else 0
        upto = max(given, watermark_s)
        rows = _used(panes, given, upto, self.span)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for end in [e for e in panes if e + self.span <= upto + 1]:
            del panes[end]
            self.panes.removeKey((end,))
        if panes:
            self.given.update((upto,))
            self.handle.registerTimer((max(panes) + self.span) * 1000 + 1)
        else:
            self.given.clear()
        return pd.DataFrame([(key[0], pd.Timestamp(u, unit="s"), n) for u, n in rows], columns=["client_id", "until", "used"])

    def _panes(self) -> dict[int, int]:
        return {k[0]: v[0] for k, v in self.panes.iterator()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        panes = self._panes()
        for end, n in pd.concat(list(rows))[["end_s", "n"]].itertuples(index=False):
            panes[int(end)] = panes.get(int(end), 0) + int(n)
            self.panes.updateValue((int(end),), (panes[int(end)],))
        yield self._advance(key, panes, timerValues.getCurrentWatermarkInMs() // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, self._panes(), timerValues.getCurrentWatermarkInMs() // 1000)

    def close(self) -> None:
        pass


def stream_request_rate(requests: DataFrame, watermark: str = "1 hour", span: int = 60) -> DataFrame:
    """client_id, until, used: requests of the ``span`` seconds before each second (``until`` not included), where there are any. requests: client_id, at.

    Requests are counted by the second first, and the counts of seconds are what windows are put together from: a request is never copied into the windows that hold it.
    In a stream, a window is given out when the watermark has passed its end.
    """
    if requests.isStreaming:
        seconds = requests.withWatermark("at", watermark).groupBy("client_id", F.window("at", "1 second").alias("w")).agg(F.count("*").alias("n"))
        panes = seconds.select("client_id", F.col("w.end").alias("at"), F.unix_seconds("w.end").alias("end_s"), "n")
        return _keyed(panes, ["client_id"], _Rate(span), "client_id long, until timestamp, used long", time="eventTime")
    panes = requests.groupBy("client_id", (F.unix_seconds("at") + 1).alias("end_s")).agg(F.count("*").alias("n"))
    change = F.explode(F.array(F.struct(F.col("end_s").alias("s"), F.col("n").alias("d")), F.struct((F.col("end_s") + span).alias("s"), (-F.col("n")).alias("d"))))
    changes = panes.select("client_id", change.alias("c")).groupBy("client_id", F.col("c.s").alias("s")).agg(F.sum("c.d").alias("d"))
    w = Window.partitionBy("client_id").orderBy("s")
    steps = changes.select("client_id", "s", F.sum("d").over(w).alias("used"), F.lead("s").over(w).alias("following")).where("used > 0")
    return steps.select("client_id", F.explode(F.sequence("s", F.col("following") - 1)).alias("until"), "used").select("client_id", F.timestamp_seconds("until").alias("until"), "used")


class _GapChunks(StatefulProcessor):
    """Of each medium: cues that the watermark hasn't passed, put in order when it does, and the chunk that is open."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, pos long, until long")
        self.chunk = handle.getValueState("chunk", "n long, begin long, until long")

    def _advance(self, key, cues: list[tuple], watermark: int) -> pd.DataFrame:
        """Takes the cues in order up to the watermark; a chunk ends at a cue further than the gap after its last one, or when no such near cue can come any more."""
        cues, out = sorted(cues), []
        chunk = tuple(self.chunk.get()) if self.chunk.exists() else None
        ready = [c for c in cues if c[0] <= watermark]
        for at, _, until in ready:
            if chunk and at - chunk[2] <= self.gap_ms:
                chunk = (chunk[0] + 1, chunk[1], until)
            else:
                out += [chunk] if chunk else []
                chunk = (1, at, until)
        left = cues[len(ready) :]
        if chunk and not any(c[0] - chunk[2] <= self.gap_ms for c in left[:1]) and watermark > chunk[2] + self.gap_ms:
            out.append(chunk)
            chunk = None
        self.waiting.put(left) if left else self.waiting.clear()
        self.chunk.update(chunk) if chunk else self.chunk.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left or chunk:
            self.handle.registerTimer(max(watermark, left[0][0] if left else chunk[2] + self.gap_ms) + 1)
        return pd.DataFrame([(key[0], n, pd.Timestamp(b, unit="ms"), pd.Timestamp(u, unit="ms")) for n, b, u in out], columns=["media_id", "n", "begin", "until"])

    def _waiting(self) -> list[tuple]:
        return [tuple(c) for c in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        ms = lambda column: came[column].astype("datetime64[ms]").astype("int64")
        yield self._advance(key, self._waiting() + list(zip(ms("at").tolist(), came["pos"].tolist(), ms("end_at").tolist())), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, self._waiting(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_gap_chunks(cues: DataFrame, watermark: str = "1 hour", gap_ms: int = 200) -> DataFrame:
    """media_id, n, begin, until (the last cue's end) of chunks: a new one begins where a cue's start is further than the gap after the end of the cue before it.

    cues: media_id, at, end_at (timestamps), pos (order of equal starts).  Cues may come in any order within the watermark; they wait as state until it has passed their
    start, and a chunk is given out when no cue can come that belongs to it.  Times are whole milliseconds.  In batches: the same chunks, at once.
    """
    if cues.isStreaming:
        return _keyed(cues.withWatermark("at", watermark), ["media_id"], _GapChunks(gap_ms), "media_id long, n long, begin timestamp, until timestamp", time="eventTime")
    rows = chunk_by_gap(cues.select("media_id", "pos", F.unix_millis("at").alias("start_ms"), F.unix_millis("end_at").alias("end_ms")), gap_ms, ("start_ms", "pos"))
    last = F.timestamp_millis(F.max_by("end_ms", F.struct("start_ms", "pos"))).alias("until")
    return rows.groupBy("media_id", "chunk_id").agg(F.count("*").alias("n"), F.timestamp_millis(F.min("start_ms")).alias("begin"), last).drop("chunk_id")


def stream_partial_asr(segments: DataFrame) -> DataFrame:
    """media_id, segments, complete: partial segments so far and whether the last one came. segments: media_id, is_last."""
    return segments.groupBy("media_id").agg(F.count("*").alias("segments"), F.max("is_last").alias("complete"))
