"""What is written to files is what is read back."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from cuemill.operators import cues, files, history, telemetry
from cuemill.sources import named_files

RESULTS = "file_id long, entry_index int, original string, translated string, error boolean"
EVENTS = [(1, 1, "하나", "one", False), (1, 2, "둘", None, True), (2, 1, 'a "quoted"\nline', "x", False)]


def test_cue_texts(spark, tmp_path):
    rows = [(m, i, i, i * 1000.0, i * 1000.0 + 500, f"cue {m} {i}") for m in (1, 2) for i in (1, 2, 3)]
    shown = cues.export_cues(spark.createDataFrame(rows, "media_id long, pos int, entry_index int, start_ms double, end_ms double, text string"))
    files.write_texts(shown, str(tmp_path / "out"))
    back = files.read_texts(spark, str(tmp_path / "out"), kind="long")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, shown.collect()))
    parsed = cues.cues_to_ms(cues.parse_cues(cues.read_cue_files(spark, str(tmp_path / "out"))))
    assert sorted(r["text"] for r in parsed.collect()) == sorted(r[5] for r in rows)


def test_translated_files_are_named(spark, tmp_path):
    results = spark.createDataFrame([(7, "My show.SRT", 1, "00:00:01,000", "00:00:02,000", "a", "b", False), (7, "My show.SRT", 2, "00:00:03,000", "00:00:04,000", "c", "d", True), (8, "a+b %20.srt", 1, "00:00:01,000", "00:00:02,000", "한", "é", False)], "media_id long, name string, entry_index int, start string, end string, original string, translated string, error boolean")
    named_files.write_named_files(cues.export_translated(results, F.col("name")), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["[번역] My show.srt", "[번역] a+b %20.srt"]
    assert (tmp_path / "out" / "[번역] My show.srt").read_text() == "1\n00:00:01,000 --> 00:00:02,000\nb\n\n2\n00:00:03,000 --> 00:00:04,000\nc\n"
    got = {r["file_name"]: r["content"] for r in named_files.read_named_files(spark, str(tmp_path / "out")).collect()}
    assert got["[번역] a+b %20.srt"] == "1\n00:00:01,000 --> 00:00:02,000\né\n" and len(got) == 2


def test_named_files_are_whole(spark, tmp_path):
    """A job that fails half way changes nothing; one whose tasks fail and are tried again gives each file once; names that aren't of one file are refused."""
    out, schema = str(tmp_path / "out"), "file_name string, content string"
    named_files.write_named_files(spark.createDataFrame([(f"{i}.txt", f"old {i}") for i in range(20)], schema), out)
    texts = lambda: {n: (tmp_path / "out" / n).read_text() for n in os.listdir(out)}
    old = {f"{i}.txt": f"old {i}" for i in range(20)}
    assert texts() == old
    for bad in ("", "a/b", "..", None, "3.txt"):
        rows = [(f"{i}.txt", "new") for i in range(20)] + [(bad, "x")]
        with pytest.raises(Exception, match="not the name of one file"):
            named_files.write_named_files(spark.createDataFrame(rows, schema).repartition(4), out)
        assert texts() == old

    writer = named_files._NamedFilesWriter(out)  # two attempts of one task, the first of which never ends, and a task that another writer has begun
    class Context:
        def __init__(self, n):
            self.taskAttemptId = lambda: n

    def attempt(n, rows):
        named_files.TaskContext, kept = type("T", (), {"get": staticmethod(lambda: Context(n))}), named_files.TaskContext
        try:
            return writer.write(iter(rows))
        finally:
            named_files.TaskContext = kept

    def broken():
        yield {"file_name": "1.txt", "content": "half"}
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        attempt(1, broken())
    assert texts_of(out) == old
    done = [attempt(2, [{"file_name": "1.txt", "content": "new"}, {"file_name": "새 파일.txt", "content": None}])]
    assert texts_of(out) == old
    writer.commit([*done, None])
    assert texts() == old | {"1.txt": "new", "새 파일.txt": ""}
    other = named_files._NamedFilesWriter(out)
    writer = other
    attempt(3, [{"file_name": "2.txt", "content": "never"}])
    other.abort([])
    assert texts() == old | {"1.txt": "new", "새 파일.txt": ""}


def texts_of(out) -> dict[str, str]:
    return {n: open(f"{out}/{n}").read() for n in os.listdir(out) if not n.startswith("_staging-")}


def test_event_lines(spark, tmp_path):
    results = spark.createDataFrame(EVENTS, RESULTS)
    for _ in range(2):
        files.write_event_lines(results, str(tmp_path / "batch"))
    got = files.read_event_lines(spark, str(tmp_path / "batch")).select("file_id", "index", "original", "translated", "error").collect()
    assert sorted(map(str, got)) == sorted(2 * [str(r) for r in results.withColumnRenamed("entry_index", "index").collect()])
    results.write.parquet(str(tmp_path / "in"))
    query = files.stream_event_lines(spark.readStream.schema(results.schema).parquet(str(tmp_path / "in")), str(tmp_path / "stream"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert files.read_event_lines(spark, str(tmp_path / "stream")).count() == 3


def test_history_files(spark, tmp_path):
    said = spark.createDataFrame([(5, 2, "model", "yes"), (5, 1, "user", "is it?"), (6, 1, "user", " ")], "conv_id long, turn long, role string, text string")
    out = files.history_files(history.sanitize_history(history.text_messages(said)), F.lit("20240101"))
    named_files.write_named_files(out, str(tmp_path / "out"))
    got = named_files.read_named_files(spark, str(tmp_path / "out")).collect()
    assert [(r["file_name"], json.loads(r["content"])) for r in got] == [("history_5_20240101.json", [{"role": r, "parts": [{"text": t}]} for r, t in (("user", "is it?"), ("model", "yes"))])]


def test_segment_table(spark, tmp_path):
    segments = spark.createDataFrame([(1, 0, "a.mp4"), (1, 1, "b.mp4")], "media_id long, segment_idx int, path string")
    speech = spark.createDataFrame([(1, 0, 5.0, 9.0), (1, 0, 1.0, 2.0)], "media_id long, segment_idx int, start_ms double, end_ms double")
    files.write_segments(files.nested_segments(segments, speech), str(tmp_path / "segments"))
    stored = files.read_segments(spark, str(tmp_path / "segments"))
    assert {r["segment_idx"]: ([tuple(s) for s in r["speech"]], r["speech_from_ms"], r["speech_to_ms"]) for r in stored.collect()} == {0: ([(1.0, 2.0), (5.0, 9.0)], 1.0, 9.0), 1: ([], None, None)}
    assert sorted(map(tuple, files.speech_of(stored).collect())) == sorted(map(tuple, speech.collect()))
    found = lambda *how: [r["segment_idx"] for r in files.spoken_between(stored, *how).collect()]
    assert (found(0, 100), found(2, 5), found(2, 5.1), found(0, 3, 2), found(0, 6, 2), found(9, 20)) == ([0], [], [0], [], [0], [])


def test_segment_table_reads_what_it_needs(spark, tmp_path):
    """Of the nested speech only the field that is asked for is read, and the bounds of speech are compared by the scan."""
    segments = spark.range(1000).select(F.lit(1).cast("long").alias("media_id"), F.col("id").cast("int").alias("segment_idx"), F.lit("a.mp4").alias("path"))
    speech = spark.range(1000).select(F.lit(1).cast("long").alias("media_id"), F.col("id").cast("int").alias("segment_idx"), (F.col("id") * 1000.0).alias("start_ms"), (F.col("id") * 1000.0 + 500).alias("end_ms"))
    files.write_segments(files.nested_segments(segments, speech), str(tmp_path / "segments"))
    stored = files.read_segments(spark, str(tmp_path / "segments"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    starts = plan(stored.select("media_id", F.explode("speech.start_ms")))
    assert "ReadSchema: struct<media_id:bigint,speech:array<struct<start_ms:double>>>" in starts and "end_ms" not in starts.split("ReadSchema")[1]
    between = files.spoken_between(stored, 5000, 7000).select("segment_idx")
    assert "LessThan(speech_from_ms,7000.0)" in plan(between) and "GreaterThan(speech_to_ms,5000.0)" in plan(between) and "path" not in plan(between).split("ReadSchema")[1]
    assert sorted(r[0] for r in between.collect()) == [5, 6]


def test_old_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, at in (("old", 1_000_000), ("deep/edge", 2_000_000 - 3 * 86400), ("new", 2_000_000)):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (at, at))
    got = files.old_files(spark, [str(tmp_path)], F.timestamp_seconds(F.lit(2_000_000)))
    assert sorted(os.path.basename(r["path"]) for r in got.collect()) == ["old"]  # one of exactly three days stays
    assert "content" not in got._jdf.queryExecution().executedPlan().toString()


def test_settings(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "w"), ("b", 3, None)], "k string, version int, value string")
    assert sorted(map(tuple, telemetry.upsert_latest(rows, "k", "version").collect())) == [("a", 2, "z"), ("b", 3, None)]
    assert [r["k"] for r in telemetry.upsert_latest(rows, "k", "version", F.col("value").isNull()).collect()] == ["a"]
    presets = spark.createDataFrame([("p", "10", "-1"), ("a", "x", "5")], "name string, batch_size string, thinking_budget string")
    assert list(map(tuple, telemetry.list_presets(presets).collect())) == [("a", None, 5, "5"), ("p", 10, -1, "auto")]
    assert [r["shown"] for r in telemetry.list_presets(presets, "p").collect()] == ["auto"]
    asked = spark.createDataFrame([(1, "ko"), (2, " "), (3, None), (9, "")], "id long, target_lang string")
    jobs = spark.createDataFrame([(1, "en"), (2, "en"), (3, "fr")], "id long, target_lang string")
    assert sorted(map(tuple, telemetry.param_fallback(asked, jobs, "target_lang").collect()), key=lambda r: r[0]) == [(1, "ko"), (2, "en"), (3, "fr"), (9, None)]
