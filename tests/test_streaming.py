"""Drained streams give what their batch twins give."""

from __future__ import annotations

import json
import random
import time
from datetime import timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuemill.functions.replies import entry_of, scan_objects
from cuemill.operators import responses
from cuemill.streaming import jobs


def drained(spark, tmp_path, df, build, mode):
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = build(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    return sorted(tuple(r) for r in spark.table("out").collect())


def until_done(spark, stream, tmp_path, mode="append", name="done"):
    """Rows of a stream that was run over all that there is (a few files a batch), and the keys that still have state."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else batches for timers go on for ever
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(100)
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return sorted(map(tuple, spark.table(name).collect()), key=str), query.lastProgress["stateOperators"][0]["numRowsTotal"]


REPLIES = [
    # text, entries (index, text)
    ('[{"index": 1, "text": "a } {"}, {"index": 2, "text": "b"}, {"index": 3, ', [(1, "a } {"), (2, "b")]),
    ('{"translations": [{"index": 4, "text": "x"}', [(4, "x")]),
    ('{"index": 1, "text": "a", "meta": {"k": 1}}', [(1, "a")]),
    ('{"meta": {"k": 1}, "index": 2, "text": "b"}{"index": 3, "text": "c"}', [(2, "b"), (3, "c")]),
    ('{"meta": {"index": 7, "text": "in"}, "index": 2}', [(7, "in")]),  # an object is done with at its end
    ('{"index": 1, "meta": {"index": 7}}', [(1, None)]),
    ('{"index": 1 "text": "no comma"}, {"index": 2, "text": "b"}', [(2, "b")]),
    ('{"index": "x", "text": "a"}{"index": null}{"index": 1.5}{"index": 1e400}{"index": [1]}{"index": 3.0, "text": "c"}', [(3, "c")]),
    ('{"index": 1, "text": 5}{"index": 2, "text": null}{"index": 3, "text": {"b": "é", "a": 1}}', [(1, "5"), (2, None), (3, '{"b": "é", "a": 1}')]),
    ('{"text": "say \\"index\\": 5 }", "index": 6}', [(6, 'say "index": 5 }')]),
    ('no object " here ] , } {"other": 1} "index" {"index": 8, "text": "h"}', [(8, "h")]),
    ('{"index": 1, "index": 2, "text": "last wins"}', [(2, "last wins")]),
    ("", []),
]


@pytest.mark.parametrize("text,expected", REPLIES)
def test_scanner(text, expected):
    found, rest = scan_objects(text)
    assert [e for o in found if (e := entry_of(o))] == expected
    for cut in range(len(text)):  # in two fragments, wherever they are cut
        first, kept = scan_objects(text[:cut])
        second, left = scan_objects(kept + text[cut:])
        assert (first + second, left) == (found, rest)


def test_scanner_keeps_only_what_is_open():
    assert scan_objects('no object here ] , "') == ([], "")
    found, rest = scan_objects('{"index": 1, "text": "a"} , then {"index": 2, ')
    assert len(found) == 1 and rest == '{"index": 2, '
    many = "".join('{"index": %d, "text": "x"},' % i for i in range(50_000))
    found, rest = scan_objects('{"translations": [' + many)
    assert [entry_of(o)[0] for o in found] == list(range(50_000)) and rest == ""
    assert scan_objects('{"a": {"b": {"index": 1, "t')[1] == '{"index": 1, "t'
    deep = '{"index": 1, "text": "x", "meta": ' + '{"k": ' * 100_000 + "1" + "}" * 100_001
    assert [entry_of(o) for o in scan_objects(deep + '{"index": 2}')[0]][1:] == [(2, None)]


def test_stream_json_objects(spark, tmp_path):
    """Replies of every kind, cut into fragments of a few characters that come in four batches."""
    rows = [(n, 1 + n % 2, i, text[i : i + 7]) for n, (text, _) in enumerate(REPLIES) for i in range(0, len(text), 7)]
    schema = "file_id long, attempt int, seq int, fragment string"
    df = spark.createDataFrame([*rows, (0, 1, 10_000, None)], schema)
    expected = sorted(((n, 1 + n % 2, *e) for n, (_, es) in enumerate(REPLIES) for e in es), key=str)
    assert sorted(map(tuple, jobs.join_json_objects(df).collect()), key=str) == expected
    for k in range(4):
        df.where(f"seq >= {k * 21} AND (seq < {(k + 1) * 21} OR {k} = 3)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, left = until_done(spark, jobs.stream_json_objects(files), tmp_path)
    assert got == expected
    assert left == sum(scan_objects(text)[1] != "" for text, _ in REPLIES)  # replies that are done with have no state


def test_stream_progress(spark, tmp_path):
    lines = [json.dumps({"file_id": 1, "index": i}) for i in range(4)] + ["", "{bad", json.dumps({"file_id": 1, "file_completed": "a"})]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = drained(spark, tmp_path, df, jobs.stream_progress, "complete")
    assert got == [(1, 4, True)] == sorted(tuple(r) for r in jobs.stream_progress(df).collect())


def results(spark):
    """Three results of each of ten keys, a second apart."""
    return spark.createDataFrame([(i % 2, i % 10, f"t{i // 10}", 1000 + i) for i in range(30)], "file_id long, entry_index int, text string, s long").select("file_id", "entry_index", "text", F.timestamp_seconds("s").alias("at"))


def test_stream_dedupe_results(spark, tmp_path):
    """The first text of each key wins, in a stream the first that came; what comes in later batches is left out."""
    df = results(spark)
    second = "unix_seconds(at) - 1000"
    stream = in_batches(spark, tmp_path, df, [f"{second} < 10", f"{second} >= 10 AND {second} < 20", f"{second} >= 20"])
    query = jobs.stream_dedupe_results(stream).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    query.stop()
    got = sorted(tuple(r) for r in spark.table("firsts").collect())
    assert got == sorted(tuple(r) for r in jobs.stream_dedupe_results(df).collect()) and {r[2] for r in got} == {"t0"}


def test_last_results(spark, tmp_path):
    """Each batch replaces the files of the buckets that it touches; old results, and batches tried again, change nothing."""
    table = jobs.LastResults(str(tmp_path / "out"), buckets=4)
    files_of = lambda: sorted(str(f) for f in (tmp_path / "out").rglob("*.parquet"))
    make = lambda rows: spark.createDataFrame(rows, "file_id long, entry_index int, text string, s long").select("file_id", "entry_index", "text", F.timestamp_seconds("s").alias("at"))
    expected: dict = {}
    rng = random.Random(7)
    for number in range(6):
        rows = [(rng.randint(0, 3), rng.randint(0, 9), f"b{number} {i}", rng.randint(0, 100)) for i in range(rng.choice([1, 5, 60]))]
        for f, e, text, at in rows:
            expected[f, e] = max(expected.get((f, e), (-1, "")), (at, text))
        table.merge(make(rows), number)
        before = files_of()
        table.merge(make([(0, 0, "again", 10_000)]), number)
        assert files_of() == before and len(before) <= 4  # a file for each bucket
        got = {(r["file_id"], r["entry_index"]): (int(r["at"].timestamp()), r["text"]) for r in jobs.last_results(spark, str(tmp_path / "out")).collect()}
        assert got == expected
    broken = tmp_path / "out" / "version=6" / "bucket=0"  # a version that was never whole
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"half")
    assert jobs.last_results(spark, str(tmp_path / "out")).count() == len(expected)
    table.merge(make([(0, 0, "newest", 10_000)]), 6)
    assert jobs.last_results(spark, str(tmp_path / "out")).where("text = 'newest'").count() == 1 and len(files_of()) <= 4


def test_last_results_of_large_buckets(spark, tmp_path, monkeypatch):
    """A bucket of many rows is several files of a bounded number, which no task exceeds; the next version replaces them all."""
    monkeypatch.setattr(jobs, "FILE_ROWS", 100)
    table = jobs.LastResults(str(tmp_path / "out"), buckets=2)
    for number in range(3):
        made = spark.range(2000 * number, 2000 * number + 3000).selectExpr("id AS file_id", "1 AS entry_index", f"'b{number}' AS text", f"timestamp_seconds({number}) AS at")
        table.merge(made, number)
    got = {r["file_id"]: r["text"] for r in jobs.last_results(spark, str(tmp_path / "out")).collect()}
    assert got == {i: f"b{min(i // 2000, 2)}" for i in range(7000)}
    sizes = [r["count"] for r in jobs.last_results(spark, str(tmp_path / "out")).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 7000 and max(sizes) <= 150 and len({f.parent for f in (tmp_path / "out").rglob("*.parquet")}) == 2


def test_last_results_of_an_empty_batch(spark, tmp_path):
    table = jobs.LastResults(str(tmp_path / "out"), buckets=2)
    empty = spark.createDataFrame([], "file_id long, entry_index int, text string, at timestamp")
    table.merge(empty, 0)
    assert jobs.last_results(spark, str(tmp_path / "out")).count() == 0


def test_store_last_results(spark, tmp_path):
    df = results(spark)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.store_last_results(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 4)
    query.processAllAvailable()
    query.stop()
    got = jobs.last_results(spark, str(tmp_path / "out")).select("file_id", "entry_index", "text").collect()
    assert sorted(map(tuple, got)) == [(i % 2, i, "t2") for i in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]
    assert len(list((tmp_path / "out").rglob("*.parquet"))) <= 4


@pytest.mark.parametrize("name", ["batch_state", "partial_asr"])
def test_streams_give_what_batches_give(spark, tmp_path, name):
    at = lambda c: F.timestamp_seconds(c)
    made = spark.range(60).withColumn("key", F.col("id") % 3)
    df, build = {
        "batch_state": (made.select(F.col("key").alias("batch_id"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("status"), F.col("id").cast("string").alias("message"), at(F.col("id") * 5).alias("at")), jobs.stream_batch_state),
                "partial_asr": (made.select(F.col("key").alias("media_id"), (F.col("id") == 58).alias("is_last")), jobs.stream_partial_asr),
    }[name]
    got = drained(spark, tmp_path, df, build, "complete")
    assert got == sorted(tuple(r) for r in build(df).collect()) and len(got) >= 3


def test_request_rate_slides(spark):
    df = spark.createDataFrame([(1, s) for s in (0, 30, 30, 59, 60)], "client_id long, s long").select("client_id", F.timestamp_seconds("s").alias("at"))
    got = {r["until"]: r["used"] for r in jobs.stream_request_rate(df).select(F.unix_seconds("until").alias("until"), "used").collect()}
    assert (got[1], got[31], got[60], got[61], got[90], got[91], got[120]) == (1, 3, 4, 4, 4, 2, 1) and set(got) == set(range(1, 121))


def test_stream_request_rate(spark, tmp_path):
    """Late requests within the watermark, bursts, pauses longer than a window; every window is given out once, and equals that of the plain sliding window."""
    rng, rows, at = random.Random(6), [], 1000
    for _ in range(80):
        at += rng.choice([0, 0, 1, 3, 20, 59, 61, 150])
        rows.append((rng.randint(0, 2), at))
    order = sorted(rows, key=lambda r: r[1] + rng.randint(0, 30)) + [(9, 100_000 + k * 10_000) for k in range(3)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(order)], "n long, client_id long, s long").select("n", "client_id", F.timestamp_seconds("s").alias("at"))
    stream = in_batches(spark, tmp_path, df.drop("n"), ["false"])
    for where in ("n < 30", "n >= 30 AND n < 80", "n >= 80 AND n < 82", "n >= 82"):
        df.where(where).drop("n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = jobs.stream_request_rate(stream, "60 seconds").writeStream.format("memory").queryName("rate").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    query.stop()
    plain = df.where("client_id < 9").groupBy("client_id", F.window("at", "60 seconds", "1 second").alias("w")).agg(F.count("*").alias("used")).select("client_id", F.col("w.end").alias("until"), "used")
    expected = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, spark.table("rate").where("client_id < 9").collect())) == expected
    assert sorted(map(tuple, jobs.stream_request_rate(df.where("client_id < 9").drop("n")).collect())) == expected and len(expected) > 1000


def in_batches(spark, tmp_path, df, parts):
    """A stream of the rows of each condition, one after the other."""
    for where in parts:
        df.where(where).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_attempts(spark, tmp_path):
    """Batches that are answered at once, in the last attempt, in part, not at all, twice, or without a text; compared with all requests and their first replies."""
    rng, requests, rows = random.Random(3), [], []
    for file in range(12):
        asked = [(i, f"o{i}") for i in range(rng.randint(1, 6))]
        requests += [(file, i, o) for i, o in asked]
        missing, seq = {i for i, _ in asked}, 0
        for attempt in range(1, 6):
            for i in sorted(missing):
                if rng.random() < (0.9 if file % 3 else 0.2):
                    for _ in range(rng.choice([1, 1, 2])):
                        seq += 1
                        rows.append((file, 0, asked, attempt, seq, i, rng.choice([f"t{seq}", None])))
                    missing.discard(i)
            rows.append((file, 0, asked, attempt, seq + 1, 77, "not asked for"))
            rows.append((file, 0, asked, attempt, seq + 2, None, None))
            seq += 2
            if not missing:
                rows = rows[:-2]  # nothing comes for a batch that is done with
                break
    df = spark.createDataFrame(rows, "file_id long, batch_no int, requested array<struct<entry_index:int,original:string>>, attempt int, seq int, entry_index int, text string")
    stream = in_batches(spark, tmp_path, df, ["attempt < 3", "attempt IN (3, 4)", "attempt = 5"])
    got, left = until_done(spark, jobs.stream_attempts(stream), tmp_path)
    asked = spark.createDataFrame(requests, "file_id long, entry_index int, original string")
    expected = responses.failed_fill(asked, df.where("entry_index IS NOT NULL")).select("file_id", "entry_index", "translated", "error").collect()
    assert sorted((f, i, t, e) for f, _, i, t, _, e in got) == sorted(map(tuple, expected)) and left == 0
    assert {e for *_, e in got} == {True, False} and all((a is None) == e for *_, a, e in got)


def test_attempts_that_stop(spark, tmp_path):
    """A batch that nothing comes for any more fails by its timer."""
    schema = "file_id long, batch_no int, requested array<struct<entry_index:int,original:string>>, attempt int, seq int, entry_index int, text string"
    asked = [(1, "a"), (2, "b")]
    df = spark.createDataFrame([(1, 0, asked, 1, 1, 1, "x"), (2, 0, [(5, "c")], 1, 1, 5, "y")], schema)
    stream = in_batches(spark, tmp_path, df, ["true"])
    query = jobs.stream_attempts(stream, patience=timedelta(milliseconds=1)).writeStream.format("memory").queryName("stopped").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.table("stopped").count() == 3:
                break
    finally:
        query.stop()
    assert sorted(map(tuple, spark.table("stopped").collect()), key=str) == [(1, 0, 1, "x", 1, False), (1, 0, 2, responses.FAILED_TEXT, None, True), (2, 0, 5, "y", 1, False)]


def test_attempts_ask_state_by_buckets(spark, tmp_path):
    """However many batches are open, a bucket is one value and one timer of state."""
    schema = "file_id long, batch_no int, requested array<struct<entry_index:int,original:string>>, attempt int, seq int, entry_index int, text string"
    asked, text = [(1, "a"), (2, None)], lambda f: "x" if f % 3 else None
    rows = [(f, 0, asked, a, 1, i, text(f)) for f in range(1500) for a, i in ((1, 1 + f % 2), (2, 2 - f % 2)) if a == 1 or f >= 500]
    stream = in_batches(spark, tmp_path, spark.createDataFrame(rows, schema), ["attempt = 1", "attempt = 2"])
    got, left = until_done(spark, jobs.stream_attempts(stream, buckets=8), tmp_path)
    assert got == sorted([(f, 0, i, x or dict(asked)[i], a, False) for f, _, _, a, _, i, x in rows], key=str)
    assert 8 <= left <= 8 * 3


def test_batches_of_a_bucket_fail_each_in_its_time():
    class Held:
        rows = None

        def get(self):
            return self.rows

        def update(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = None

    class Handle:
        def __init__(self):
            self.held, self.timers = Held(), set()
            self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

        def getValueState(self, *_):
            return self.held

    handle, now = Handle(), [0]
    clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now[0])
    job = jobs._Attempts(5, 1000, "failed")
    job.init(handle)

    def came(at, file, index):
        now[0] = at
        rows = pd.DataFrame([(0, file, 0, '[{"entry_index":1,"original":"a"},{"entry_index":2}]', 1, 1, index, "x")], columns=["bucket", "file_id", "batch_no", "requested", "attempt", "seq", "entry_index", "text"])
        return [tuple(r) for f in job.handleInputRows((0,), iter([rows]), clock) for r in f.drop(columns="attempt").itertuples(index=False)]

    def fired(at):
        now[0] = at
        handle.timers -= {t for t in handle.timers if t <= at}
        return [tuple(r) for f in job.handleExpiredTimer((0,), clock, None) for r in f.drop(columns="attempt").itertuples(index=False)]

    assert came(0, 1, 1) == [(1, 0, 1, "x", False)] and handle.timers == {1000}
    assert came(400, 2, 9) == [] and handle.timers == {1000}
    assert came(600, 1, 1) == [] and handle.timers == {1400}
    assert fired(1500) == [(2, 0, 1, "failed", True), (2, 0, 2, "failed", True)] and handle.timers == {1600}
    assert came(1550, 3, 1) == [(3, 0, 1, "x", False)] and handle.timers == {1600}
    assert came(1560, 3, 2) == [(3, 0, 2, "x", False)] and handle.timers == {1600}
    assert fired(1600) == [(1, 0, 2, "failed", True)] and handle.timers == set() and handle.held.rows is None


def test_stream_last_updates(spark, tmp_path):
    """The oldest are dropped; a batch ends with its queue as it was then, and leaves no state."""
    rows = [(1, "completed" if i in (9, 40) else "running", f"m{i}", i, i) for i in range(41)] + [(2, "running", f"n{i}", i, 1) for i in range(3)] + [(3, "failed", "only", 20, 1)]
    df = spark.createDataFrame(rows, "batch_id long, status string, message string, at long, seq int")
    stream = in_batches(spark, tmp_path, df, ["at < 5", "at >= 5 AND at < 30", "at >= 30"])
    got, left = until_done(spark, jobs.stream_last_updates(stream, 4), tmp_path)
    ended = sorted((b, s, q) for b, s, q in got if s != "running")
    assert ended == [(1, "completed", ["m37", "m38", "m39", "m40"]), (1, "completed", ["m6", "m7", "m8", "m9"]), (3, "failed", ["only"])]
    assert ended == sorted(map(tuple, jobs.last_updates(df, 4).collect()))
    assert [(b, q) for b, s, q in got if s == "running"] == [(1, ["m1", "m2", "m3", "m4"]), (1, ["m26", "m27", "m28", "m29"]), (2, ["n0", "n1", "n2"])]
    assert left == 1  # the queue of the batch that goes on


def test_stream_gap_chunks(spark, tmp_path):
    """Cues out of order within the watermark, ends that aren't in order, equal starts, and chunks that end by the watermark alone; the same chunks as in a batch."""
    rng, rows = random.Random(9), []
    for media in range(4):
        at = 0
        for pos in range(60):
            at += rng.choice([0, 50, 120, 200, 201, 350, 2000])
            rows.append((media, pos, at, at + rng.choice([10, 100, 150, 600])))
    order = sorted(rows, key=lambda r: r[2] + rng.randint(0, 3000))  # comes up to three seconds late
    order += [(99, k, 10_000_000 + k * 100_000, 10_000_000 + k * 100_000) for k in range(3)]  # time goes on
    stamp = lambda c: F.timestamp_millis(c).alias(c)
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(order)], "n long, media_id long, pos int, at long, end_at long").select("n", "media_id", "pos", stamp("at"), stamp("end_at"))
    cut = len(order) // 3
    for where in (f"n < {cut}", f"n >= {cut} AND n < {2 * cut}", f"n >= {2 * cut} AND media_id < 99", "media_id = 99"):
        df.where(where).drop("n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.drop("n").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.stream_gap_chunks(stream, "10 seconds").writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    query.stop()
    got = sorted(tuple(r) for r in spark.table("chunks").where("media_id < 99").collect())
    assert got == sorted(tuple(r) for r in jobs.stream_gap_chunks(df.where("media_id < 99")).collect()) and len(got) > 40
