"""Views of the driver's tables in the shapes that the operators take, for Spark and, as SQL, for DuckDB.

30 days of events are squeezed into 259,200 ms of media time for each user, so that gaps, overlaps
and silences all occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_US = {"spark": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)", "duck": "(epoch_us(ts) - 1704067200000000)"}

_VIEWS = {
    "v1_cues": (
        ("events",),
        """SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY ts, event_id) AS INT) AS pos,
       CAST(row_number() OVER (PARTITION BY media_id ORDER BY ts, event_id) AS INT) AS entry_index,
       t0 AS start_ms, t0 + 200 + CAST(floor(value * 20) AS DOUBLE) AS end_ms, event_type AS text, event_id
FROM (SELECT user_id AS media_id, event_id, ts, value, event_type, CAST(floor(T_US / 10000000.0) AS DOUBLE) AS t0 FROM {events}) e""",
    ),
    "v2_speech": (
        ("v1_cues",),
        """SELECT media_id, event_id AS seg_id, CAST(greatest(0, start_ms + (event_id * 7919 % 700) - 350) AS DOUBLE) AS start_ms,
       CAST(greatest(0, start_ms + (event_id * 7919 % 700) - 350) + 100 + (event_id * 37 % 2500) AS DOUBLE) AS end_ms
FROM {v1_cues} WHERE event_id % 3 <> 0""",
    ),
    "v4_history": (("conversations",), "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, text FROM {conversations}"),
    "v5_requests": (("lineitem",), "SELECT DISTINCT l_orderkey AS file_id, CAST(l_linenumber AS INT) AS entry_index, concat('src-', CAST(l_linenumber AS VARCHAR(10))) AS original FROM {lineitem}"),
    "v5_responses": (
        ("lineitem",),
        """SELECT l_orderkey AS file_id, CAST(l_linenumber AS INT) AS entry_index, CAST(1 + l_partkey % 6 AS INT) AS attempt,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 6, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS INT) AS seq,
       concat(l_returnflag, l_linestatus, '-', CAST(l_partkey AS VARCHAR(20))) AS text
FROM {lineitem} WHERE l_suppkey % 7 <> 0 AND l_partkey % 6 < 5""",
    ),
    "v6_asr": (
        ("v1_cues",),
        """SELECT media_id, CAST(floor(start_ms / 30000) AS INT) AS segment_index, event_id AS clip_index,
       (start_ms - 30000 * floor(start_ms / 30000)) / 1000 AS start_s, (end_ms - 30000 * floor(start_ms / 30000)) / 1000 AS end_s,
       CASE WHEN event_id % 11 = 0 THEN '' ELSE text END AS text
FROM {v1_cues}""",
    ),
    "v6_updates": (
        ("events",),
        """SELECT user_id % 10 AS batch_id, user_id AS item_id, event_id % 5 AS segment_idx,
       CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
       value / 500 AS progress, event_type AS message, T_US AS updated_us, event_id
FROM {events}""",
    ),
    "v7_requests": (
        ("events",),
        """SELECT event_id, user_id AS client_id, CAST(floor(T_US / 1000000.0) AS BIGINT) AS ts_s, 400 + event_id % 200 AS code,
       concat('{{"retryDelay": "', CAST(event_id % 60 AS VARCHAR(10)), 's"}}') AS payload,
       concat('..a/', event_type, '<', CAST(event_id AS VARCHAR(10)), '>?.srt') AS file_name
FROM {events}""",
    ),
    "v8_jobs": (
        ("orders",),
        """SELECT o_orderkey AS id, o_orderdate AS created_at,
       concat('{{"batch_size": "', CAST(o_orderkey % 30 AS VARCHAR(10)), '", "target_lang": "', o_orderstatus, '"}}') AS data
FROM {orders}""",
    ),
    "v8_config": (("customer",), "SELECT c_mktsegment AS cfg_key, CAST(c_custkey AS VARCHAR(20)) AS cfg_value, c_custkey AS version FROM {customer}"),
    "v9_urls": (("pages",), "SELECT page_id AS pos, url FROM {pages}"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the directory if no view has the name."""
    if name not in _VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = _VIEWS[name]
    return spark.sql(sql.replace("T_US", _US["spark"]), **{n: view(spark, sf_dir, n) for n in needs})


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    wanted: list[str] = []

    def need(name: str) -> None:
        if name in _VIEWS and name not in wanted:
            for n in _VIEWS[name][0]:
                need(n)
            wanted.append(name)

    for n in names or [n for n in _VIEWS if n in sql]:
        need(n)
    parts = [f"{n} AS ({_VIEWS[n][1].replace('T_US', _US['duck']).format(**{t: t for t in _VIEWS[n][0]})})" for n in wanted]
    body = sql.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if body.upper().startswith("WITH"):
        return f"WITH {recursive}{', '.join(parts)}, {body[len('WITH ') + len(recursive):]}" if parts else body
    return f"WITH {', '.join(parts)} {body}" if parts else body
