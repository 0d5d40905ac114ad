"""Hand-worked cases of the quirks that the operators keep."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from cuemill.functions import text as tx
from cuemill.functions import timecode as tc
from cuemill.operators import cues, history, intervals, responses, sync, telemetry, transcripts, urls

CUES = "media_id long, pos int, entry_index int, start_ms double, end_ms double, text string"
SPEECH = "media_id long, seg_id long, start_ms double, end_ms double"


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_cue_text_quirks(spark):
    block = "1\n00:00:01,000 --> 00:00:02,000\n{}\n\n"
    files = {
        1: block.format("plain\ntwo lines"),
        2: "1\n00:00:01,000 --> 00:00:02,000\n\n2\n00:00:03,000 --> 00:00:04,000\nnext\n",
        3: block.format("first\n12 monkeys"),
        4: "1\r\n00:00:01,000 --> 00:00:02,000\r\na\r\nb\r\n",
        5: "",
    }
    df = spark.createDataFrame(list(files.items()), "media_id long, text string")
    got = {r["media_id"]: r["text"] for r in cues.parse_cues(df).collect()}
    assert got[1] == "plain two lines"
    assert got[2].startswith("2 00:00:03,000")  # an empty cue swallows the next block
    assert got[3] == "first"  # a line that begins with digits ends the cue
    assert "\r" in got[4] and 5 not in got


def test_charsets(spark):
    df = spark.createDataFrame([(1, "한글".encode("cp949")), (2, b"\xef\xbb\xbfabc"), (3, "é".encode()), (4, b"\xff\xfe\xff")], "media_id long, content binary")
    got = {r["media_id"]: r["text"] for r in cues.decoded(df).collect()}
    assert got[1] == "한글" and got[2] == "abc" and got[3] == "é" and got[4] == "ÿþÿ"


def test_timecodes(spark):
    assert one(spark, tc.tc_to_ms(F.lit("00:00:01,5"))) == 1005
    assert [one(spark, tc.tc_to_ms(F.lit(x))) for x in ("1:2", "a:b:c,1", "00:00:01.5", "00:00:01,1,2")] == [0, 0, 0, 0]
    assert one(spark, tc.ms_to_tc(F.lit(-5.0))) == "00:00:00,000" and one(spark, tc.ms_to_tc(F.lit(360_000_000.9))) == "100:00:00,000"
    assert one(spark, tc.seconds_to_tc(F.lit(1.2345))) == "00:00:01,234" and one(spark, tc.seconds_to_tc(F.lit(None).cast("double"))) == "00:00:00,000"


def test_merge_compares_in_ms(spark):
    seg = spark.createDataFrame([(1, 1, 0.0, 100.0), (1, 2, 249.0, 300.0), (1, 3, 450.0, 500.0), (1, 4, 651.0, 700.0), (1, 5, 660.0, 670.0)], SPEECH)
    assert rows(intervals.merge_close_segments(seg), "start_ms", "end_ms") == [(0.0, 500.0), (651.0, 700.0)]


def test_packing_takes_long_segments_and_exact_limits(spark):
    seg = spark.createDataFrame([(1, 1, 0.0, 400.0), (1, 2, 500.0, 1000.0), (1, 3, 1001.0, 1002.0), (1, 4, 1003.0, 3000.0)], SPEECH)
    assert rows(sync.pack_speech(seg, 1000), "seg_id", "group_id") == [(1, 0), (2, 0), (3, 1), (4, 1)]


def test_overlap_repair(spark):
    data = [(1, 1, 1, 0.0, 1000.0, "a"), (1, 2, 2, 900.0, 2000.0, "b"), (2, 1, 1, 0.0, 310.0, "a"), (2, 2, 2, 100.0, 2000.0, "b"), (3, 1, 1, 0.0, 2000.0, "a"), (3, 2, 2, 1900.0, 2050.0, "b")]
    got = rows(sync.fix_overlaps(spark.createDataFrame(data, CUES)), "media_id", "entry_index", "start_ms", "end_ms")
    assert got == [(1, 1, 0.0, 945.0), (1, 2, 955.0, 2000.0), (2, 1, 0.0, 300.0), (2, 2, 310.0, 2000.0), (3, 1, 0.0, 1740.0), (3, 2, 1750.0, 2050.0)]


def test_silence_rules(spark):
    entries = spark.createDataFrame([(1, 1, 1, 0.0, 1000.0, "short"), (1, 2, 2, 5000.0, 9000.0, "cut"), (1, 3, 3, 8000.0, 9500.0, "silent"), (2, 1, 1, 0.0, 9000.0, "no speech")], CUES)
    speech = spark.createDataFrame([(1, 1, 5000.0, 5400.0)], SPEECH)
    assert rows(intervals.remove_silent_entries(entries, speech), "media_id", "entry_index", "end_ms") == [(1, 1, 1000.0), (1, 2, 8000.0), (2, 1, 9000.0)]


def test_boundary_takes_the_first_of_equal_scores(spark):
    points = spark.createDataFrame([(1, 1, 1000.0), (1, 2, 90_000.0)], "media_id long, id long, boundary double")
    speech = spark.createDataFrame([(1, 1, 900.0, 1900.0), (1, 2, 1100.0, 2100.0)], SPEECH)
    got = {r["id"]: (r["new_boundary"], r["score"]) for r in intervals.best_boundary(points, speech, 800, 400, 80, True).collect()}
    assert got[1][0] == 820.0 and got[2] == (None, 0.0)


def test_replies(spark):
    requests = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "file_id long, entry_index int, original string")
    replies = spark.createDataFrame([(1, 1, 2, 1, "late"), (1, 1, 1, 2, "second"), (1, 1, 1, 1, None), (1, 2, 1, 3, "x"), (1, 9, 1, 4, "unknown")], "file_id long, entry_index int, attempt int, seq int, text string")
    assert rows(responses.match_first_wins(requests, replies), "entry_index", "translated") == [(1, "a"), (2, "x")]
    assert rows(responses.apply_updates_last_wins(requests, replies), "entry_index", "text") == [(1, "late"), (2, "x"), (3, "c")]
    assert rows(responses.missing_entries(requests, replies), "entry_index") == [(3,)]
    raw = spark.createDataFrame([(1, " 2 ", 1, 1, "ok"), (1, "x", 1, 2, "no"), (1, "1", 1, 3, " \t")], "file_id long, entry_index string, attempt int, seq int, text string")
    assert rows(responses.valid_updates(requests, raw), "entry_index", "text") == [(2, "ok")]


def test_histories(spark):
    h = spark.createDataFrame([(1, 1, "user", "Keep it short.\n번역할 자막들:\n1 a\n주의사항: x"), (1, 2, "model", " "), (1, 3, "user", "b c"), (1, 4, "model", "d")], "conv_id long, turn long, role string, text string")
    assert one(spark, history.sanitize_user_text(F.lit("Keep it short.\n번역할 자막들:\n1 a\n주의사항: x"))) == "Keep it short.\n\n번역할 자막들:\n1 a"
    assert one(spark, history.sanitize_user_text(F.lit("x Entries: 1"))) == "Entries: 1" and one(spark, history.sanitize_user_text(F.lit(None).cast("string"))) == ""
    assert [r["turn"] for r in history.compact_history(h, 1).orderBy("turn").collect()] == [None, 3, 4]
    assert [r["turn"] for r in history.compact_history(h, 9).orderBy("turn").collect()] == [1, 2, 3, 4]


def test_names_and_urls(spark):
    assert one(spark, tx.sanitized_filename(F.lit("a/..b<c>?.srt"))) == "b_c__.srt" and one(spark, tx.sanitized_filename(F.lit("..."))) == "file"
    assert one(spark, tx.label(F.lit(""))) == "session" and one(spark, tx.truncated(F.lit("x" * 100), 80)) == "x" * 77 + "..."
    df = spark.createDataFrame([(1, " youtu.be/abc "), (2, "https://youtu.be/abc"), (3, "https://evilyoutu.be/x"), (4, "")], "pos long, url string")
    assert rows(urls.normalize_urls(df, ("youtu.be",)), "pos", "url") == [(1, "https://youtu.be/abc")]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], CUES), spark.createDataFrame([], SPEECH)
    assert sync.sync_pipeline(*empty).count() == 0 and sync.sync_stats(*empty).count() == 0 and cues.export_transcript(empty[0]).count() == 0


def test_even_times_keep_a_margin(spark):
    media = spark.createDataFrame([(1, 10_000.0), (2, 300.0)], "media_id long, duration_ms double")
    got = {(m, i): round(x, 6) for m, i, x in rows(cues.even_times(media, 3), "media_id", "i", "at_s")}
    assert got == {(1, 1): 2.6, (1, 2): 5.0, (1, 3): 7.4, (2, 1): 0.25, (2, 2): 0.3, (2, 3): 0.35}
    assert cues.even_times(media, 0).count() == 0


def test_asr_windows_have_a_least_length_and_numbers(spark):
    asr = spark.createDataFrame([(1, 0, 5, -1.0, -0.5, " a "), (1, 0, 6, 2.0, 2.01, "b"), (1, 0, 7, 3.0, None, "c"), (1, 1, 8, 1.0, 4.0, None)], "media_id long, segment_index int, clip_index long, start_s double, end_s double, text string")
    got = rows(transcripts.asr_windows(asr), "clip_index", "number", "start_s", "end_s")
    assert got == [(5, 1, 0.0, 0.05), (6, 2, 2.0, 2.05), (7, 3, 3.0, 3.1), (8, 1, 1.0, 4.0)]


def test_segments_of_whole_pieces(spark):
    """A segment of exactly n pieces has n, wherever it begins; one of a millisecond more has another."""
    made = [(length, start, float(start), float(start + length)) for start in range(0, 200_000, 97) for length in (1000, 2000, 2001)]
    cut = cues.speech_windows(spark.createDataFrame(made, SPEECH), 1, 0.25)
    got = cut.groupBy("media_id", "seg_id").agg(F.count("*").alias("n")).groupBy("media_id", "n").count()
    assert rows(got, "media_id", "n", "count") == [(1000, 1, 2062), (2000, 2, 2062), (2001, 3, 2062)]
    assert rows(cut.where("media_id = 2000 AND seg_id = 0"), "piece", "start_s", "end_s") == [(0, 0.0, 1.0), (1, 1.0, 2.25)]


def test_compact_history_under_a_limit(spark):
    turns = [(c, t, "model" if t % 2 else "user", "word " * 10) for c in (1, 2, 3) for t in range(6 if c < 3 else 2)]  # 12 + 4 tokens each
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")

    def kept(limit, summarise=lambda dump: dump):
        out = history.compact_history(df.where("conv_id = 1"), 2, limit, 10, summarise).collect()
        return sorted((r["turn"] is not None, r["turn"]) for r in out), [r["text"] for r in out if r["turn"] is None]

    assert kept(1_000_000) == ([(True, t) for t in range(6)], [])  # it fits whole
    assert kept(106) == kept(1_000_000)  # 6 * 16 + 10
    short = lambda dump: F.lit("short")
    at, text = kept(105, short)  # 4 * 16 + 5 + 4 + 10 fit
    assert at == [(False, None), (True, 2), (True, 3), (True, 4), (True, 5)] and text == ["[WORK SUMMARY]\nshort"]
    assert kept(60, short)[0] == [(False, None), (True, 4), (True, 5)]
    assert kept(20, short)[0] == [(False, None)]  # nothing is kept in the third round, fitting or not
    nested = kept(60)[1][0]
    assert nested.startswith("[WORK SUMMARY]\nMODEL:\n[WORK SUMMARY]\nMODEL:\n[WORK SUMMARY]\nUSER:\nword")
    assert history.compact_history(df.where("conv_id = 3"), 2, 5, 10).count() == 2  # no more than would be kept


def test_retry_delay_forms(spark):
    said = [
        ('{"retryDelay": "5s"}', 5.0), ('{"retryDelay": " 2.5 SEC "}', 2.5), ('{"retryDelay": "7 seconds"}', 7.0), ('{"retryDelay": 3}', 3.0), ('{"retryDelay": -3}', 0.0), ('{"retryDelay": "soon"}', None),
        ('{"details": [{"a": 1}, {"retryDelay": "soon"}, {"retryDelay": "9s"}]}', 9.0), ('{"details": [{"details": [{"retryDelay": "4s"}]}, {"retryDelay": "9s"}]}', 4.0), ('[{"x": 1}, {"retryDelay": "6s"}]', 6.0),
        ("error: {'retryDelay': '8s'}", 8.0), ("RETRYDELAY: 1.5s and more", 1.5), ("retry in 4 s", None), (None, None),
    ]
    df = spark.createDataFrame([(i, p, 503 if i else 400) for i, (p, _) in enumerate(said)], "event_id long, payload string, code int")
    got = {r["event_id"]: (r["delay_s"], r["is_server_error"]) for r in telemetry.retry_delay(df).collect()}
    assert got == {i: (d, i > 0) for i, (_, d) in enumerate(said)}


def test_folds_of_one_long_run(spark):
    """Every entry overlaps the one before: the whole medium is one run."""
    n = 5000
    df = spark.range(n).select(F.lit(1).cast("long").alias("media_id"), F.col("id").cast("int").alias("pos"), F.col("id").cast("int").alias("entry_index"), (F.col("id") * 400.0).alias("start_ms"), (F.col("id") * 400.0 + 700).alias("end_ms"), F.lit("x").alias("text"))
    got = rows(sync.fix_overlaps(df), "pos", "start_ms", "end_ms")
    last, expected = [0.0, 700.0], []
    for k in range(1, n):
        start, end = k * 400.0, k * 400.0 + 700
        middle = (last[1] + start) / 2
        e, s = (middle - 5, middle + 5) if middle - 5 - last[0] >= 300 else (last[0] + 300, last[0] + 310)
        s, e = (end - 300, end - 310) if end - s < 300 else (s, e)
        expected.append((k - 1, last[0], max(last[0] + 300, e)))
        last = [min(end - 300, s), end]
    assert got == [*expected, (n - 1, *last)]


def packed(segments: list[tuple], max_ms: float) -> list[tuple]:
    """media, seg_id, group, its start: one segment after the other."""
    out, at = [], {}
    for media, seg, start, end in sorted(segments, key=lambda s: (s[0], s[2], s[1])):
        opened, group = at.get(media, (None, -1))
        if opened is None or not (end - opened <= max_ms or end - start >= max_ms):
            opened, group = start, group + 1
        at[media] = opened, group
        out.append((media, seg, group, opened))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_packing_by_blocks(spark, monkeypatch, block):
    """Long segments, gaps, ties, fractions and a medium that begins with a segment longer than the limit."""
    monkeypatch.setattr(sync, "PACK_BLOCK", block)
    rng, segments = random.Random(block), [(9, 0, 0.0, 5000.0), (9, 1, 10.0, 20.0), (9, 2, 5000.5, 5001.5), (8, 0, 7.0, 7.0)]
    for media in range(6):
        at = 0.0
        for seg in range(rng.choice([1, 40, 400])):
            at += rng.choice([0, 0, 3.1, 40, 200, 200.7, 900, 7000])
            segments.append((media, seg, at, at + rng.choice([0.1, 30, 250.3, 800, 999.9, 1000, 1500, 4000])))
    df = spark.createDataFrame(segments, SPEECH).repartition(5)
    assert rows(sync.pack_speech(df, 1000.0), "media_id", "seg_id", "group_id", "group_start") == packed(segments, 1000.0)


def test_packing_of_one_long_medium(spark):
    """A medium of 200,000 segments without a gap is packed in many blocks, none of which holds more than a few thousand rows."""
    made = spark.range(200_000).select(F.lit(1).cast("long").alias("media_id"), F.col("id").alias("seg_id"), (F.col("id") * 300.0).alias("start_ms"), (F.col("id") * 300.0 + 100 + F.col("id") * 7919 % 650).alias("end_ms"))
    out = sync.pack_speech(made, 10_000.0)
    segments = [(1, i, i * 300.0, i * 300.0 + 100 + i * 7919 % 650) for i in range(200_000)]
    assert rows(out, "media_id", "seg_id", "group_id", "group_start") == packed(segments, 10_000.0)
    assert made.groupBy(F.floor(F.col("start_ms") / (sync.PACK_BLOCK * 10_000.0))).count().agg(F.max("count")).first()[0] < 3000
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_sync_plans_shuffle_little(spark):
    from cuemill.plans import catalog

    for name, most in (("sync_stats", 12), ("sync_pipeline", 12), ("filter_silent_entries", 8)):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count(" Exchange ") <= most, name
        assert name == "filter_silent_entries" or plan.count("FileScan") <= 4, name


def test_sync_stats_count_media_whose_entries_all_go(spark):
    """Silent entries are counted, and split no chunk of the others; a medium may lose all, have no speech, or have entries without a time."""
    made = [("gone", 0, 1, 0.0, 5000.0, "a"), ("gone", 1, 2, 6000.0, 9000.0, "b"), ("mute", 0, 1, 0.0, 5000.0, "c"), ("some", 0, 1, 0.0, 1000.0, "d"), ("some", 1, 2, 1100.0, 9000.0, "e"), ("some", 2, 3, 9000.0, 10000.0, "f"), ("some", 3, 4, None, None, "g")]
    cue_rows = spark.createDataFrame(made, "media_id string, pos long, entry_index long, start_ms double, end_ms double, text string")
    speech = spark.createDataFrame([("gone", 1, 60_000.0, 61_000.0), ("some", 1, 0.0, 1000.0), ("some", 2, 9000.0, 10_000.0)], "media_id string, seg_id long, start_ms double, end_ms double")
    got = {r["media_id"]: (r["status"], r["entries"], r["chunks"], r["vad_segments"], r["silent_removed"]) for r in sync.sync_stats(cue_rows, speech).collect()}
    kept = {r["media_id"]: r["n"] for r in sync.sync_pipeline(cue_rows, speech).groupBy("media_id").agg(F.count("*").alias("n")).collect()}
    assert got["gone"] == ("success", 0, 0, 1, 2) and got["mute"] == ("no_segments", 1, 0, 0, 0)
    assert got["some"][0] == "success" and got["some"][1] == kept["some"] == 2 and got["some"][3:] == (2, 2)
    assert kept == {"mute": 1, "some": 2}


def test_cue_files_round_trip(spark, tmp_path):
    text = "1\n00:00:01,000 --> 00:00:02,000\nhéllo\n\n2\n00:00:03,000 --> 00:00:04,500\ntwo\n"
    (tmp_path / "a.srt").write_bytes(b"\xef\xbb\xbf" + text.encode())
    (tmp_path / "b.srt").write_bytes(text.replace("héllo", "안녕").encode("cp949"))
    files = cues.read_cue_files(spark, str(tmp_path))
    parsed = cues.cues_to_ms(cues.parse_cues(files))
    assert [(r["media_id"][-5:], r["pos"], r["start_ms"], r["end_ms"], r["text"]) for r in parsed.orderBy("media_id", "pos").collect()] == [("a.srt", 1, 1000.0, 2000.0, "héllo"), ("a.srt", 2, 3000.0, 4500.0, "two"), ("b.srt", 1, 1000.0, 2000.0, "안녕"), ("b.srt", 2, 3000.0, 4500.0, "two")]
    shown = {r["media_id"][-5:]: r["content"] for r in cues.export_cues(parsed).collect()}
    assert shown["a.srt"] == text


DEEP = '{"retryDelay": "8s"}'
for _ in range(300):
    DEEP = '{"details": [%s]}' % DEEP


@pytest.mark.parametrize(
    "payload,delay",
    [
        ('{"details":[{"details":[{"details":[{"details":[{"details":[{"retryDelay":"7s"}]}]}]}]}]}', 7.0),
        ('{"details":[[{"retryDelay":"5s"}]]}', 5.0),
        ('{"details":["x", null, 3, {"retryDelay":"7 seconds"}]}', 7.0),
        ('[{"a": 1}, {"details": [{"retryDelay": 2.5}]}, {"retryDelay": 9}]', 2.5),
        ('{"details": [{"retryDelay": "1s"}], "retryDelay": "3s"}', 3.0),  # an object's own goes first
        ('{"retryDelay": "later", "details": [{"retryDelay": "4s"}]}', 4.0),
        ('{"retryDelay": -3}', 0.0),
        ('{"retryDelay": "-3"}', None),
        ('{"retryDelay": true}', 1.0),
        ('{"retryDelay": null}', None),
        ('{"retryDelay": " 6 SEC "}', 6.0),
        ('{"details": {"retryDelay": "3s"}}', None),
        ("not JSON, retryDelay: '12.5s'", 12.5),
        (DEEP, 8.0),
        ("", None),
        (None, None),
    ],
)
def test_retry_delay_at_any_depth(spark, payload, delay):
    # a message of its own, so that the payload's text isn't searched as well
    got = telemetry.retry_delay(spark.createDataFrame([(1, payload, 500, payload if payload and payload.startswith("not") else "error")], "event_id long, payload string, code int, message string"))
    assert got.first()["delay_s"] == delay


#: part, normalised, shown, tokens: worked by hand.
PARTS = [
    ('{"text": "hello big world"}', '{"text": "hello big world"}', "hello big world", 3),
    ('{"text": null}', '{"text": ""}', '{"text": ""}', 3),
    ('{"text": "  ", "thought": null}', '{"text": "  "}', '{"text": "  "}', 3),
    ("{}", '{"text": ""}', '{"text": ""}', 3),
    ('{"text": 5}', '{"text": "5"}', "5", 1),
    ('{"functionCall": {"name": "f", "args": {"b": 1, "a": {"d": null, "c": ["é", null]}}, "id": null}}', '{"function_call": {"name": "f", "args": {"b": 1, "a": {"c": ["é"]}}}}', '[FUNCTION_CALL] name=f args={"a": {"c": ["é"]}, "b": 1}', 13),
    ('{"functionCall": {"args": 7}}', '{"function_call": {"args": 7}}', "[FUNCTION_CALL] name= args=7", 7),
    ('{"function_call": "odd"}', '{"function_call": "odd"}', "[FUNCTION_CALL] name= args=", 6),
    ('{"functionResponse": {"name": "f", "response": {"b": 1.5, "a": true}}}', '{"function_response": {"name": "f", "response": {"b": 1.5, "a": true}}}', '[FUNCTION_RESPONSE] name=f payload={"b": 1.5, "a": true}', 14),
    ('{"fileData": {"file_uri": "u", "uri": "v", "mimeType": "m"}}', '{"file_data": {"file_uri": "u", "uri": "v", "mimeType": "m"}}', "[FILE_DATA] uri=u mime=m", 6),
    ('{"fileData": {}}', '{"file_data": {}}', "[FILE_DATA] uri=unknown mime=unknown", 9),
    ('{"inlineData": {"mime_type": "m", "size_bytes": 0}}', '{"inline_data": {"mime_type": "m", "size_bytes": 0}}', "[INLINE_DATA] mime=m", 5),
    ('{"inlineData": {"mimeType": "m", "sizeBytes": 12}}', '{"inline_data": {"mimeType": "m", "sizeBytes": 12}}', "[INLINE_DATA] mime=m size=12", 7),
    ('{"executable_code": {"language": "PYTHON"}}', '{"executable_code": {"language": "PYTHON"}}', "[EXECUTABLE_CODE] language=PYTHON", 8),
    ('{"codeExecutionResult": {"outcome": "OK"}}', '{"code_execution_result": {"outcome": "OK"}}', "[CODE_RESULT] status=OK", 5),
    ('{"videoMetadata": {"fps": 2, "x": null}}', '{"video_metadata": {"fps": 2}}', '{"video_metadata": {"fps": 2}}', 7),
    ("not JSON", '{"text": "not JSON"}', "not JSON", 2),
]


def test_parts(spark):
    rows = [(n, n, "user", [p]) for n, (p, *_) in enumerate(PARTS)] + [(100, 0, "user", [p for p, *_ in PARTS]), (101, 0, "user", []), (102, 0, "user", None), (103, 0, "user", [None])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<string>").repartition(3)
    got = {r["conv_id"]: r for r in history.normalize_messages(df).withColumn("shown", history.part_texts(F.col("parts"))).collect()}
    for n, (_, normal, shown, _) in enumerate(PARTS):
        assert (json.loads(got[n]["parts"][0]), got[n]["shown"]) == (json.loads(normal), [shown])
        assert list(json.loads(got[n]["parts"][0])) == list(json.loads(normal))  # in their order
    assert got[100]["shown"] == [p[2] for p in PARTS] and got[101]["parts"] == got[102]["parts"] == []
    tokens = {r["conv_id"]: r["tokens"] for r in history.history_tokens(df).collect()}
    assert tokens == {n: 4 + t for n, (*_, t) in enumerate(PARTS)} | {100: 4 + sum(p[3] for p in PARTS), 101: 4, 102: 4, 103: 7}


def test_parts_of_texts_stay_in_the_jvm(spark):
    """Arrow gets nulls only for messages that hold texts alone, and a filter by kind needs none at all."""
    df = spark.createDataFrame([(1, 0, "model", ['{"text": "a"}', '{"function_call": {"name": "f"}}']), (1, 1, "model", ['{"function_call": {}}']), (1, 2, "model", ['{"function_call": {"name": "g"}}'])], "conv_id long, turn long, role string, parts array<string>")
    out = history.drop_function_calls(df)
    assert "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["turn"], r["parts"]) for r in out.collect()) == [(0, ['{"text": "a"}']), (1, ['{"function_call": {}}'])]
    assert [(r["turn"], len(r["parts"])) for r in history.sanitize_history(df).collect()] == [(0, 2), (1, 1), (2, 1)]
