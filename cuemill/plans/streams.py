"""Queries of the streaming operators over the given tables, run as bounded inputs, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from ..functions.tables import shared_path
from ..operators import responses as re_
from ..sources.fixtures import view, with_views
from ..streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, run, sql: str, *views: str) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(sql, *views)


def _fragments(s, d):
    """Each reply as an object with another one nested in it, before or behind its index, cut into two fragments; some aren't JSON, and some have no index that is a number."""
    r = view(s, d, "v5_responses")
    index = F.when(F.col("seq") % 13 == 0, '"x"').otherwise(F.col("entry_index").cast("string"))
    own = F.concat(F.lit('"index":'), index, F.when(F.col("seq") % 17 == 0, "").otherwise(","), F.expr("substring(to_json(struct(text)), 2, length(to_json(struct(text))) - 2)"))
    nested = F.lit('"meta":{"quoted":"} { \\"index\\"","deep":{"k":[1,{"k":2}]}}')
    whole = F.concat(F.lit("{"), F.when(F.col("seq") % 2 == 0, F.concat(own, F.lit(","), nested)).otherwise(F.concat(nested, F.lit(","), own)), F.lit("}, "))
    cut = r.select("file_id", "attempt", "seq", whole.alias("j"))
    return cut.select("file_id", "attempt", (F.col("seq") * 2).alias("seq"), F.left("j", F.lit(30)).alias("fragment")).unionByName(cut.select("file_id", "attempt", (F.col("seq") * 2 + 1).alias("seq"), F.substring("j", 31, 1000).alias("fragment")))


def _entries(s, d):
    ship_package(s)
    return jobs.join_json_objects(_fragments(s, d))


def _stamped(s, d):
    return view(s, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))


add("stream_json_objects", _entries, "SELECT file_id, attempt, entry_index, text FROM v5_responses WHERE seq % 13 <> 0 AND seq % 17 <> 0")
add("stream_dedupe_results", lambda s, d: jobs.stream_dedupe_results(view(s, d, "v5_responses").withColumnRenamed("seq", "at").select("file_id", "entry_index", "text", "at")), "SELECT file_id, entry_index, arg_min(text, seq) AS text, min(seq) AS at FROM v5_responses GROUP BY 1, 2")
add("stream_progress", lambda s, d: jobs.stream_progress(re_.to_event_lines(re_.match_first_wins(view(s, d, "v5_requests"), view(s, d, "v5_responses")).withColumn("error", F.lit(False)))), "SELECT file_id, count(*) AS received, false AS completed FROM (SELECT DISTINCT file_id, entry_index FROM v5_responses) x GROUP BY 1", "v5_requests", "v5_responses")
add("stream_batch_state", lambda s, d: jobs.stream_batch_state(view(s, d, "v6_updates").select("batch_id", "status", "message", F.struct("updated_us", "event_id").alias("at"))), "SELECT batch_id, arg_max(status, updated_us * 100000 + event_id % 100000) AS status, arg_max(message, updated_us * 100000 + event_id % 100000) AS message, count(*) AS updates FROM v6_updates GROUP BY 1")
add("stream_request_rate", lambda s, d: jobs.stream_request_rate(_stamped(s, d).select(F.col("user_id").alias("client_id"), "at")).select("client_id", F.unix_seconds("until").alias("until"), "used"), "SELECT client_id, until, count(*) AS used FROM (SELECT user_id AS client_id, unnest(range(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) + 1, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) + 61)) AS until FROM events) x GROUP BY 1, 2")
_CHUNK_SQL = """WITH a AS (SELECT *, lag(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, event_id) AS b FROM v1_cues), c AS (SELECT *, sum(CASE WHEN start_ms - b <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT media_id, count(*) AS n, CAST(min(start_ms) AS BIGINT) AS begin_ms, CAST(arg_max(end_ms, pos) AS BIGINT) AS end_ms FROM c GROUP BY media_id, k"""
add("stream_gap_chunks", lambda s, d: jobs.stream_gap_chunks(view(s, d, "v1_cues").select("media_id", F.timestamp_millis(F.col("start_ms").cast("long")).alias("at"), F.timestamp_millis(F.col("end_ms").cast("long")).alias("end_at"), F.col("event_id").alias("pos"))).select("media_id", "n", F.unix_millis("begin").alias("begin_ms"), F.unix_millis("until").alias("end_ms")), _CHUNK_SQL, "v1_cues")
add("stream_partial_asr", lambda s, d: jobs.stream_partial_asr(view(s, d, "v6_asr").select("media_id", (F.col("clip_index") % 50 == 0).alias("is_last"))), "SELECT media_id, count(*) AS segments, bool_or(clip_index % 50 = 0) AS complete FROM v6_asr GROUP BY 1")


def _drained(spark, df, parts, job):
    """What a streaming job gives for all rows of a table that come in several batches, one for each condition."""
    ship_package(spark)
    path = shared_path(spark, "stream")
    parallel, shuffle = spark.sparkContext.defaultParallelism, "spark.sql.shuffle.partitions"
    settings = {
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # else batches for timers alone go on for ever
        shuffle: str(min(int(spark.conf.get(shuffle)), parallel)),  # each partition of state opens a store and a Python worker in every run
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        for where in parts:  # each run goes on from the checkpoint of the one before
            df.where(where).write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(df.schema).parquet(f"{path}/in")
            job(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.parquet(f"{path}/out")


def _attempts(s, d):
    """Three entries a batch: the first reply to each in the attempt that it came in, and the end of the fifth attempt where some are missing."""
    asked = view(s, d, "v5_requests").withColumn("batch_no", F.floor((F.col("entry_index") - 1) / 3).cast("int"))
    requested = asked.groupBy("file_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct("entry_index", "original"))).alias("requested"), F.count("*").alias("n"))
    first = view(s, d, "v5_responses").groupBy("file_id", "entry_index").agg(F.min_by(F.struct("attempt", "seq", "text"), F.struct("attempt", "seq")).alias("r")).select("file_id", "entry_index", "r.*")
    replies = first.join(asked.select("file_id", "entry_index", "batch_no"), ["file_id", "entry_index"])
    answered = replies.groupBy("file_id", "batch_no").agg(F.count("*").alias("answered"))
    open_ = requested.join(answered, ["file_id", "batch_no"], "left").where(F.coalesce("answered", F.lit(0)) < F.col("n"))
    ends = open_.select("file_id", "batch_no", F.lit(5).alias("attempt"), F.lit(1 << 30).alias("seq"), F.lit(None).cast("int").alias("entry_index"), F.lit(None).cast("string").alias("text"))
    rows = replies.select(*ends.columns).union(ends).join(requested.drop("n"), ["file_id", "batch_no"])
    made = shared_path(s, "replies")
    rows.write.parquet(made)  # made once, not once for each batch
    return _drained(s, s.read.parquet(made), ["attempt < 3", "attempt IN (3, 4)", "attempt = 5"], jobs.stream_attempts)


add("stream_attempts", _attempts, f"WITH f AS (SELECT file_id, entry_index, arg_min(text, attempt * 100000 + seq) AS t, min(attempt) AS attempt FROM v5_responses GROUP BY 1, 2) SELECT file_id, CAST((entry_index - 1) // 3 AS INT) AS batch_no, entry_index, CASE WHEN attempt IS NULL THEN '{re_.FAILED_TEXT}' ELSE coalesce(t, original) END AS translated, attempt, attempt IS NULL AS error FROM v5_requests LEFT JOIN f USING (file_id, entry_index)", "v5_requests", "v5_responses")


def _last_updates(s, d):
    """Queues of at most 8 messages; every 61st update ends its batch. The updates come in three batches by time."""
    status = F.when(F.col("event_id") % 61 == 0, "completed").otherwise("running")
    rows = view(s, d, "v6_updates").select(F.col("batch_id").cast("long"), status.alias("status"), F.concat("message", F.col("event_id").cast("string")).alias("message"), F.col("updated_us").cast("long").alias("at"), F.col("event_id").alias("seq"))
    found = _drained(s, rows, ["at < 900000000000", "at >= 900000000000 AND at < 1700000000000", "at >= 1700000000000"], lambda x: jobs.stream_last_updates(x, 8))
    return found.where(F.col("status").isin(*jobs.ENDED)).select("batch_id", "status", F.array_join("queue", ",").alias("queue"))


add("stream_last_updates", _last_updates, "WITH a AS (SELECT *, event_id % 61 = 0 AS ended FROM v6_updates), b AS (SELECT *, coalesce(sum(CAST(ended AS INT)) OVER (PARTITION BY batch_id ORDER BY updated_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY batch_id, run ORDER BY updated_us DESC, event_id DESC) AS back, max(ended) OVER (PARTITION BY batch_id, run) AS done FROM b) SELECT CAST(batch_id AS BIGINT) AS batch_id, 'completed' AS status, string_agg(concat(message, event_id), ',' ORDER BY updated_us, event_id) AS queue FROM c WHERE back <= 8 AND done GROUP BY batch_id, run", "v6_updates")


def _last_results(s, d):
    """The table after the replies of three ranges of attempts were merged into it, one after the other."""
    rows = view(s, d, "v5_responses").select("file_id", "entry_index", "text", F.col("seq").alias("at"), "attempt")
    table = jobs.LastResults(shared_path(s, "results"), buckets=8)
    for n, where in enumerate(("attempt >= 4", "attempt < 2", "attempt IN (2, 3)")):
        table.merge(rows.where(where).drop("attempt"), n)
    return table.read(s, rows.drop("attempt").schema)


add("stream_last_results", _last_results, "SELECT file_id, entry_index, arg_max(text, seq) AS text, max(seq) AS at FROM v5_responses GROUP BY 1, 2")
