"""Queries over replies, histories, job states, settings, urls and transcripts, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import timecode as tc
from ..functions.shipping import ship_package
from ..functions.tables import shared_path
from ..operators import files as fi
from ..operators import history as hi
from ..operators import responses as re_
from ..operators import telemetry as te
from ..operators import transcripts as tr
from ..operators import urls as ur
from ..sources.fixtures import view, with_views
from ..sources.named_files import read_named_files, write_named_files
from .media import _TC, _media

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, run, sql: str, *views: str) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(sql, *views)


def _rr(s, d):
    return view(s, d, "v5_requests"), view(s, d, "v5_responses")


# -- replies -----------------------------------------------------------------------------------
_FIRST = "firsts AS (SELECT file_id, entry_index, arg_min(text, attempt * 100000 + seq) AS t, min(attempt) AS attempt FROM v5_responses GROUP BY 1, 2)"
_LAST = "lasts AS (SELECT file_id, entry_index, arg_max(text, attempt * 100000 + seq) AS t FROM v5_responses GROUP BY 1, 2)"
_V5 = ("v5_requests", "v5_responses")
add("match_first_wins", lambda s, d: re_.match_first_wins(*_rr(s, d)), f"WITH {_FIRST} SELECT file_id, entry_index, original, coalesce(t, original) AS translated, attempt FROM v5_requests JOIN firsts USING (file_id, entry_index)", *_V5)


def _raw(s, d):
    index = F.when(F.col("seq") % 9 == 0, "x").otherwise(F.col("entry_index").cast("string"))
    return view(s, d, "v5_responses").select("file_id", index.alias("entry_index"), "attempt", "seq", F.when(F.col("seq") % 11 == 0, " ").otherwise(F.col("text")).alias("text"))


add("valid_updates", lambda s, d: re_.valid_updates(view(s, d, "v5_requests"), _raw(s, d)), "SELECT file_id, entry_index, attempt, seq, text FROM v5_responses JOIN v5_requests USING (file_id, entry_index) WHERE seq % 9 <> 0 AND seq % 11 <> 0", *_V5)
add("apply_updates_last_wins", lambda s, d: re_.apply_updates_last_wins(*_rr(s, d)), f"WITH {_LAST} SELECT file_id, entry_index, coalesce(t, original) AS text, t IS NOT NULL AS updated FROM v5_requests LEFT JOIN lasts USING (file_id, entry_index)", *_V5)
add("missing_entries", lambda s, d: re_.missing_entries(*_rr(s, d)), "SELECT file_id, entry_index FROM v5_requests EXCEPT SELECT file_id, entry_index FROM v5_responses", *_V5)
_FILLED = f"{_FIRST}, filled AS (SELECT file_id, entry_index, original, coalesce(t, '{re_.FAILED_TEXT}') AS translated, t IS NULL AS error FROM v5_requests LEFT JOIN firsts USING (file_id, entry_index))"
add("failed_fill", lambda s, d: re_.failed_fill(*_rr(s, d)), f"WITH {_FILLED} SELECT * FROM filled", *_V5)


def _pairs(s, d):
    r, p = _rr(s, d)
    return re_.enrich_pairs(r, re_.match_first_wins(r, p), 4, 6)


_PAIRS = f"{_FIRST}, pairs AS (SELECT file_id, entry_index, original[:4] AS source, t[:6] AS target FROM v5_requests JOIN firsts USING (file_id, entry_index))"
add("enrich_pairs", _pairs, f"WITH {_PAIRS} SELECT * FROM pairs", *_V5)
add("attempt_state", lambda s, d: re_.attempt_state(*_rr(s, d)), f"""WITH {_FIRST}, r AS (SELECT file_id, count(*) AS requested FROM v5_requests GROUP BY 1), a AS (SELECT file_id, requested, unnest(range(1, 6)) AS attempt FROM r),
n AS (SELECT file_id, f.attempt, count(*) AS k FROM firsts f JOIN v5_requests USING (file_id, entry_index) GROUP BY 1, 2)
SELECT a.file_id, a.attempt, coalesce(sum(k), 0) AS confirmed, requested, coalesce(sum(k), 0) = requested AS done FROM a LEFT JOIN n ON n.file_id = a.file_id AND n.attempt <= a.attempt GROUP BY a.file_id, a.attempt, requested""", *_V5)


def _errors(s, d):
    return view(s, d, "v5_responses").where("seq % 4 = 0").select("file_id", (F.col("attempt") + F.col("seq") % 2).alias("attempt"))


add("segment_outcome", lambda s, d: re_.segment_outcome(*_rr(s, d), _errors(s, d)), f"""WITH {_LAST}, u AS (SELECT file_id, count(t) AS updated FROM v5_requests LEFT JOIN lasts USING (file_id, entry_index) GROUP BY 1), o AS (SELECT file_id, max(attempt) AS ok FROM v5_responses GROUP BY 1),
b AS (SELECT file_id, max(attempt + seq % 2) AS bad FROM v5_responses WHERE seq % 4 = 0 GROUP BY 1)
SELECT file_id, CASE WHEN bad > ok THEN 'error' ELSE 'completed' END AS status, CASE WHEN bad > ok THEN 0 ELSE updated END AS updated FROM u LEFT JOIN o USING (file_id) LEFT JOIN b USING (file_id)""", *_V5)
add("refresh_transcript", lambda s, d: re_.refresh_transcript(*_rr(s, d)), f"WITH {_LAST} SELECT file_id, string_agg(concat(CAST(entry_index AS VARCHAR), ': ', coalesce(t, original)), chr(10) ORDER BY entry_index) AS content FROM v5_requests LEFT JOIN lasts USING (file_id, entry_index) GROUP BY 1", *_V5)
add("file_counts", lambda s, d: re_.file_counts(*_rr(s, d)), f"WITH {_FIRST} SELECT file_id, count(*) AS total, count(t) AS received, CAST(floor(100.0 * count(t) / count(*) + 0.5) AS INT) AS percent FROM v5_requests LEFT JOIN firsts USING (file_id, entry_index) GROUP BY 1", *_V5)
_JSON = lambda c: f"concat('[', string_agg(concat('{{\"index\":', CAST(entry_index AS VARCHAR), ',\"text\":\"', {c}, '\"}}'), ',' ORDER BY entry_index), ']')"
add("batch_payload", lambda s, d: re_.batch_payload(view(s, d, "v5_requests"), 3), f"SELECT file_id, batch_no, {_JSON('original')} AS payload FROM (SELECT *, CAST((row_number() OVER (PARTITION BY file_id ORDER BY entry_index) - 1) // 3 AS INT) AS batch_no FROM v5_requests) x GROUP BY 1, 2")
add("rebuild_full_turn", lambda s, d: re_.rebuild_full_turn(*_rr(s, d)), f"WITH {_FILLED} SELECT file_id, {_JSON('original')} AS request, {_JSON('translated')} AS reply FROM filled GROUP BY 1", *_V5)
_LINES = lambda text, within: f"string_agg({text}, chr(10) ORDER BY entry_index) FILTER (k <= {within})"
add("recon_entries", lambda s, d: re_.recon_entries(_pairs(s, d), 3, view(s, d, "v5_requests"), 4).withColumn("summary_input", F.array_join("summary_input", "|")), f"WITH {_PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY entry_index DESC) AS k FROM pairs), d AS (SELECT file_id, concat('[RECON_ENTRIES]', chr(10), '총 ', count(*), '개 중 최신 ', least(count(*), 3), '개', chr(10), {_LINES("concat('#$', entry_index, chr(10), 'ORIG: ', source, chr(10), 'TRANS: ', target)", 3)}) AS digest, string_agg(concat('#', entry_index, ' 원문: ', source, chr(10), '번역: ', target), '|' ORDER BY entry_index) FILTER (k <= 4) AS said FROM n GROUP BY file_id) SELECT file_id, coalesce(digest, concat('[RECON_ENTRIES]', chr(10), '번역된 자막이 아직 없습니다.')) AS digest, coalesce(said, '') AS summary_input FROM (SELECT DISTINCT file_id FROM v5_requests) f LEFT JOIN d USING (file_id)", *_V5)
add("sink_result_events", lambda s, d: re_.to_event_lines(re_.failed_fill(*_rr(s, d))), f"""WITH {_FILLED} SELECT concat('{{"file_id":', CAST(file_id AS VARCHAR), ',"index":', CAST(entry_index AS VARCHAR), ',"original":"', original, '","translated":"', translated, '","error":', CASE WHEN error THEN 'true' ELSE 'false' END, '}}') AS value FROM filled""", *_V5)


def _event_lines(s, d):
    lines = re_.to_event_lines(re_.failed_fill(*_rr(s, d)))
    return re_.parse_event_lines(lines.unionByName(lines.select(F.left("value", F.lit(9)).alias("value")))).select("file_id", F.col("index").alias("entry_index"), "original", "translated", "error")


add("src_result_events", _event_lines, f"WITH {_FILLED} SELECT * FROM filled", *_V5)

# -- histories ---------------------------------------------------------------------------------
_STRIP = lambda c: f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"
_TOK = f"(CASE WHEN {_STRIP('text')} = '' THEN 0 ELSE greatest(length({_STRIP('text')}) // 4, len(regexp_split_to_array({_STRIP('text')}, '\\s+')), 1) END)"
_h = lambda s, d: view(s, d, "v4_history")
add("estimate_tokens", lambda s, d: _h(s, d).select("conv_id", "turn", hi.estimate_tokens(F.col("text")).alias("tokens")), f"SELECT conv_id, turn, {_TOK} AS tokens FROM v4_history")


def _messages(s, d):
    """Messages of several parts: texts (some null), calls and responses with nulls and nested values, files, data, code and results."""
    ship_package(s)
    t = F.col("turn").cast("string")
    text = F.when(F.col("turn") % 5 == 4, F.lit('{"text":null}')).otherwise(hi.text_part(F.col("text")))
    call = F.when((F.col("role") == "model") & (F.col("turn") % 7 == 3), F.concat(F.lit('{"functionCall":{"name":"lookup","args":{"b":[1,null,{"z":null,"y":"é"}],"a":'), t, F.lit(',"n":null}}}')))
    other = F.element_at(F.array(
        F.lit('{"codeExecutionResult":{"outcome":"OK","n":null}}'), F.lit('{"functionResponse":{"name":"lookup","response":{"b":1,"a":"x y"}}}'),
        F.concat(F.lit('{"fileData":{"uri":"u/'), t, F.lit('","mimeType":"video/mp4"}}')), F.concat(F.lit('{"inlineData":{"mimeType":"audio/wav","sizeBytes":'), t, F.lit("}}"))), (F.col("turn") % 4 + 1).cast("int"))
    last = F.when(F.col("turn") % 3 == 0, other)
    return _h(s, d).select("conv_id", "turn", "role", F.array_compact(F.array(text, call, last)).alias("parts"))


_IS_CALL = "role = 'model' AND turn % 7 = 3"
_SHOWN = [
    "CASE WHEN turn % 5 = 4 THEN '{\"text\": \"\"}' ELSE text END",
    f"CASE WHEN {_IS_CALL} THEN concat('[FUNCTION_CALL] name=lookup args={{\"a\": ', turn, ', \"b\": [1, {{\"y\": \"é\"}}]}}') END",
    "CASE WHEN turn % 3 <> 0 THEN NULL WHEN turn % 4 = 0 THEN '[CODE_RESULT] status=OK' WHEN turn % 4 = 1 THEN '[FUNCTION_RESPONSE] name=lookup payload={\"b\": 1, \"a\": \"x y\"}' WHEN turn % 4 = 2 THEN concat('[FILE_DATA] uri=u/', turn, ' mime=video/mp4') ELSE concat('[INLINE_DATA] mime=audio/wav size=', turn) END",
]
_NORMAL = [
    "CASE WHEN turn % 5 = 4 THEN '{\"text\":\"\"}' ELSE CAST(to_json({'text': text}) AS VARCHAR) END",
    f"CASE WHEN {_IS_CALL} THEN concat('{{\"function_call\":{{\"args\":{{\"a\":', turn, ',\"b\":[1,{{\"y\":\"é\"}}]}},\"name\":\"lookup\"}}}}') END",
    "CASE WHEN turn % 3 <> 0 THEN NULL WHEN turn % 4 = 0 THEN '{\"code_execution_result\":{\"outcome\":\"OK\"}}' WHEN turn % 4 = 1 THEN '{\"function_response\":{\"name\":\"lookup\",\"response\":{\"a\":\"x y\",\"b\":1}}}' WHEN turn % 4 = 2 THEN concat('{\"file_data\":{\"mimeType\":\"video/mp4\",\"uri\":\"u/', turn, '\"}}') ELSE concat('{\"inline_data\":{\"mimeType\":\"audio/wav\",\"sizeBytes\":', turn, '}}') END",
]
_PARTS_TOK = " + ".join(f"coalesce({x}, 0)" for x in (f"(SELECT CASE WHEN t = '' THEN 0 ELSE greatest(length(t) // 4, len(regexp_split_to_array(t, '\\s+')), 1) END FROM (SELECT {_STRIP(y)} AS t))" for y in ("p0", "p1", "p2")))
_SHOWN_PARTS = f"shown AS (SELECT *, {', '.join(f'{x} AS p{n}' for n, x in enumerate(_SHOWN))} FROM v4_history)"
add("history_tokens", lambda s, d: hi.history_tokens(_messages(s, d)), f"WITH {_SHOWN_PARTS} SELECT conv_id, sum(4 + {_PARTS_TOK}) AS tokens FROM shown GROUP BY 1", "v4_history")
_DUMP = lambda src, k="conv_id": f"SELECT {k}, string_agg(concat(upper(role), ':', chr(10), {_STRIP('text')}), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY turn) AS dump FROM {src} WHERE {_STRIP('text')} <> '' GROUP BY {k}"
add("conversation_dump", lambda s, d: hi.conversation_dump(_h(s, d)), _DUMP("v4_history"))
add("compact_history", lambda s, d: hi.compact_history(_h(s, d), 1), f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM v4_history), o AS (SELECT * FROM n WHERE n > 2 AND back > 2), m AS ({_DUMP('o')}) SELECT conv_id, CAST(NULL AS BIGINT) AS turn, 'model' AS role, concat('[WORK SUMMARY]', chr(10), dump) AS text FROM m UNION ALL SELECT conv_id, turn, role, text FROM n WHERE n <= 2 OR back <= 2", "v4_history")
# keep 2, limit 700 with 40 to come; a summary is the first 300 characters of what goes
_EST = lambda c: f"(CASE WHEN {_STRIP(c)} = '' THEN 0 ELSE greatest(length({_STRIP(c)}) // 4, len(regexp_split_to_array({_STRIP(c)}, '\\s+')), 1) END)"
_PART = lambda low, high: f"coalesce(string_agg(concat(upper(role), ':', chr(10), {_STRIP('text')}), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY turn) FILTER (WHERE {_STRIP('text')} <> '' AND back > {low} AND back <= {high}), '')"
_NEXT = lambda s, d: f"concat('[WORK SUMMARY]', chr(10), left(concat('MODEL:', chr(10), {_STRIP(s)}, CASE WHEN {d} = '' THEN '' ELSE concat(chr(10), chr(10), '---', chr(10), chr(10), {d}) END), 300))"
add("compact_history_limited", lambda s, d: hi.compact_history(_h(s, d), 2, 700, 40, lambda dump: F.left(dump, F.lit(300))), f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM v4_history),
a AS (SELECT conv_id, count(*) AS n, sum({_TOK} + 4) AS total, sum(CASE WHEN back <= 4 THEN {_TOK} + 4 ELSE 0 END) AS t0, sum(CASE WHEN back <= 2 THEN {_TOK} + 4 ELSE 0 END) AS t1, {_PART(4, 99999)} AS d0, {_PART(2, 4)} AS d1, {_PART(0, 2)} AS d2 FROM n GROUP BY 1),
b AS (SELECT *, concat('[WORK SUMMARY]', chr(10), left(d0, 300)) AS s0 FROM a), c AS (SELECT *, {_NEXT('s0', 'd1')} AS s1 FROM b), e AS (SELECT *, {_NEXT('s1', 'd2')} AS s2 FROM c),
f AS (SELECT *, CASE WHEN {_EST('s0')} + 4 + t0 + 40 <= 700 THEN 0 WHEN {_EST('s1')} + 4 + t1 + 40 <= 700 THEN 1 ELSE 2 END AS r FROM e WHERE total + 40 > 700 AND n > 4 AND d0 <> '')
SELECT conv_id, CAST(NULL AS BIGINT) AS turn, 'model' AS role, CASE r WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS text FROM f
UNION ALL SELECT conv_id, turn, role, text FROM n LEFT JOIN (SELECT conv_id, r FROM f) x USING (conv_id) WHERE r IS NULL OR back <= 4 - 2 * r""", "v4_history")
add("should_snapshot", lambda s, d: hi.should_snapshot(_h(s, d), 100, 10), f"SELECT conv_id, sum({_TOK} + 4) + 10 > 100 AS snapshot FROM v4_history GROUP BY 1")
add("cumulative_usage", lambda s, d: hi.cumulative_usage(_h(s, d)), f"WITH t AS (SELECT *, {_TOK} + 4 AS k FROM v4_history), u AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM t), w AS (SELECT *, sum(CASE WHEN role = 'model' THEN sent + k ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS usage FROM u) SELECT conv_id, turn, usage FROM w WHERE role = 'model'", "v4_history")
add("drop_last_turn", lambda s, d: hi.drop_last_turn(_h(s, d)), "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, count(*) OVER (PARTITION BY conv_id) AS n FROM v4_history) x WHERE n < 2 OR b > 2")
add("history_prefix", lambda s, d: hi.history_prefix(_h(s, d), 2, "again"), "SELECT conv_id, turn, role, CASE WHEN turn = 2 THEN 'again' ELSE text END AS text FROM v4_history WHERE turn <= 2 AND conv_id IN (SELECT conv_id FROM v4_history WHERE turn = 2 AND role = 'user')", "v4_history")
add("drop_function_calls", lambda s, d: hi.drop_function_calls(hi.normalize_messages(_messages(s, d).withColumn("parts", F.when(F.col("turn") == 3, F.filter("parts", lambda p: ~F.startswith(p, F.lit('{"text"')))).otherwise(F.col("parts"))))).select("conv_id", "turn", F.array_join(hi.part_texts(F.col("parts")), "|").alias("shown")), f"WITH {_SHOWN_PARTS} SELECT conv_id, turn, concat_ws('|', CASE WHEN turn <> 3 THEN p0 END, p2) AS shown FROM shown WHERE turn <> 3 OR p2 IS NOT NULL OR p1 IS NULL", "v4_history")
add("sanitize_history", lambda s, d: hi.sanitize_history(hi.normalize_messages(_messages(s, d))).select("conv_id", "turn", F.size("parts").alias("n"), F.array_join(hi.part_texts(F.col("parts")), "|").alias("texts")), f"""WITH {_SHOWN_PARTS}, k AS (SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 THEN nullif({_STRIP('p0')}, '') END AS t, p1 FROM shown)
SELECT conv_id, turn, CAST(t IS NOT NULL AS INT) + CAST(p1 IS NOT NULL AS INT) AS n, concat_ws('|', t, p1) AS texts FROM k WHERE t IS NOT NULL OR p1 IS NOT NULL""", "v4_history")
add("sanitize_user_text", lambda s, d: _h(s, d).select("conv_id", "turn", hi.sanitize_user_text(F.concat(F.lit("Be brief. 다음 자막들을 x\n번역할 자막들:\n"), F.col("text"), F.lit("\n\n주의사항: x"))).alias("text")), f"SELECT conv_id, turn, concat('Be brief.', CASE WHEN {_STRIP('text')} = '' THEN '' ELSE concat(chr(10), chr(10), '번역할 자막들:', chr(10), {_STRIP('text')}) END) AS text FROM v4_history WHERE text IS NOT NULL")
add("part_repr", lambda s, d: _messages(s, d).select("conv_id", "turn", F.array_join(hi.part_texts(F.col("parts")), "|").alias("shown")), f"WITH {_SHOWN_PARTS} SELECT conv_id, turn, concat_ws('|', p0, p1, p2) AS shown FROM shown", "v4_history")
_as_json = lambda p: F.to_json(F.try_parse_json(p))
add("normalize_part", lambda s, d: hi.normalize_messages(_messages(s, d)).select("conv_id", "turn", F.posexplode("parts").alias("n", "p")).select("conv_id", "turn", "n", _as_json(F.col("p")).alias("part"), hi.part_field(F.col("p"), "function_call.args.b[1].y").alias("nested")), f"SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS INT) AS n, p AS part, CASE WHEN k = 1 THEN 'é' END AS nested FROM ({' UNION ALL '.join(f'SELECT conv_id, turn, {k} AS k, {x} AS p FROM v4_history' for k, x in enumerate(_NORMAL))}) x WHERE p IS NOT NULL", "v4_history")
add("recon_flag", lambda s, d: hi.recon_flag(hi.text_messages(_h(s, d).withColumn("text", F.concat(F.when(F.col("turn") % 2 == 1, "[RECON_ENTRIES] ").otherwise(""), F.col("text"))))).select("conv_id", "turn", "is_recon"), "SELECT conv_id, turn, role = 'model' AND turn % 2 = 1 AND text IS NOT NULL AS is_recon FROM v4_history")


def _history_files(s, d):
    """The files as they are found under their names."""
    path = shared_path(s, "history")
    write_named_files(fi.history_files(hi.sanitize_history(hi.normalize_messages(_messages(s, d))), F.lit("20240101")), path)
    return read_named_files(s, path)


add("sink_history", _history_files, f"""WITH {_SHOWN_PARTS}, k AS (SELECT conv_id, turn, role, CASE WHEN turn % 5 <> 4 THEN nullif({_STRIP('p0')}, '') END AS t, CASE WHEN p1 IS NOT NULL THEN {_NORMAL[1]} END AS c FROM shown)
SELECT concat('history_', conv_id, '_20240101.json') AS file_name, concat('[', string_agg(concat('{{"role":"', role, '","parts":[', concat_ws(',', CASE WHEN t IS NOT NULL THEN CAST(to_json({{'text': t}}) AS VARCHAR) END, c), ']}}'), ',' ORDER BY turn), ']') AS content FROM k WHERE t IS NOT NULL OR c IS NOT NULL GROUP BY conv_id""", "v4_history")

# -- states ------------------------------------------------------------------------------------
_u = lambda s, d: view(s, d, "v6_updates")
_STATE = lambda key, name="st": f"{name} AS (SELECT {key}, arg_max(status, updated_us * 100000 + event_id % 100000) AS status, greatest(least(arg_max(progress, updated_us * 100000 + event_id % 100000), 1), 0) AS progress, arg_max(message, updated_us * 100000 + event_id % 100000) AS message, max(updated_us) AS updated_us FROM v6_updates GROUP BY {key})"
_SEG, _ITEM = "batch_id, item_id, segment_idx", "batch_id, item_id"
add("latest_state", lambda s, d: te.latest_state(_u(s, d)), f"WITH {_STATE(_SEG)} SELECT * FROM st", "v6_updates")
add("batch_summary", lambda s, d: te.batch_summary(_u(s, d)), f"WITH {_STATE(_ITEM)} SELECT batch_id, count(*) AS items, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running, round(avg(progress), 6) AS progress FROM st GROUP BY 1", "v6_updates")
add("job_summary", lambda s, d: te.job_summary(_u(s, d)), f"WITH {_STATE(_SEG)} SELECT batch_id, item_id, round(count(*) FILTER (WHERE status = 'completed') / count(*), 6) AS progress, coalesce(string_agg(CAST(segment_idx AS VARCHAR), ',' ORDER BY segment_idx) FILTER (WHERE status = 'failed'), '') AS failed, bool_and(status = 'completed') AS ready FROM st GROUP BY 1, 2", "v6_updates")
add("nonterminal_to_failed", lambda s, d: te.nonterminal_to_failed(te.latest_state(_u(s, d), te.ITEM)), f"WITH {_STATE(_ITEM)} SELECT batch_id, item_id, CASE WHEN status IN ('completed', 'failed') THEN status ELSE 'failed' END AS status, progress, CASE WHEN status IN ('completed', 'failed') THEN message ELSE 'interrupted' END AS message, updated_us FROM st", "v6_updates")
add("nonterminal_to_cancelled", lambda s, d: te.nonterminal_to_cancelled(te.latest_state(_u(s, d), te.ITEM)), f"WITH {_STATE(_ITEM)} SELECT batch_id, item_id, CASE WHEN status IN ('completed', 'error', 'cancelled') THEN status ELSE 'cancelled' END AS status, progress, message, updated_us FROM st", "v6_updates")
add("recent_logs", lambda s, d: te.recent_logs(_u(s, d), 50).select("batch_id", "event_id"), "SELECT batch_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY updated_us DESC, event_id DESC) AS k FROM v6_updates) x WHERE k <= 50")


def _asked(s, d):
    return _u(s, d).select("batch_id", "item_id", F.when(F.col("event_id") % 5 == 0, "none").otherwise((F.col("event_id") % 6).cast("string")).alias("segment"))


add("retry_selection", lambda s, d: te.retry_selection(_asked(s, d), _u(s, d)), f"WITH {_STATE(_ITEM)} SELECT DISTINCT batch_id, item_id, event_id % 6 AS segment_idx FROM v6_updates a WHERE event_id % 5 <> 0 AND (batch_id, item_id, event_id % 6) IN (SELECT (batch_id, item_id, segment_idx) FROM v6_updates) AND (batch_id, item_id) IN (SELECT (batch_id, item_id) FROM st WHERE status IN ('completed', 'failed'))", "v6_updates")
add("clamp_ratio", lambda s, d: _u(s, d).select("event_id", F.round(te.clamp_ratio(F.col("progress") * 2, F.col("segment_idx").cast("double")), 6).alias("ratio")), "SELECT event_id, CASE WHEN segment_idx > 0 THEN round(greatest(least(progress * 2 / segment_idx, 1), 0), 6) ELSE 0 END AS ratio FROM v6_updates")
_asr = lambda s, d: view(s, d, "v6_asr")
add("segment_ratio", lambda s, d: _asr(s, d).select("clip_index", F.round(te.segment_ratio(F.col("end_s"), F.lit(15.0), F.lit(30.0)), 6).alias("ratio")), "SELECT clip_index, round(greatest(least(CASE WHEN end_s >= 15 THEN end_s - 15 ELSE end_s END / 30, 1), 0), 6) AS ratio FROM v6_asr")
_q = lambda s, d: view(s, d, "v7_requests")
add("rolling_requests", lambda s, d: te.rolling_requests(_q(s, d), 2, 43200), "SELECT event_id, count(*) OVER w AS used, greatest(2 - count(*) OVER w, 0) AS remaining, min(ts_s) OVER w + 43200 - ts_s AS reset_s FROM v7_requests WINDOW w AS (PARTITION BY client_id ORDER BY ts_s RANGE BETWEEN 43200 PRECEDING AND CURRENT ROW)")


def _payloads(s, d):
    """Payloads that say a delay at the top, in details, five levels deep, in a list in a list behind other things, in the message's text alone, or nowhere."""
    ship_package(s)
    n = (F.col("event_id") % 60).cast("string")
    own = F.concat(F.lit('{"retryDelay":"'), n, F.lit('s"}'))
    deep = F.concat(F.lit('{"details":[{"details":[{"details":[{"details":[{"details":['), own, F.lit("]}]}]}]}]}"))
    mixed = F.concat(F.lit('[null,"x",{"retryDelay":"soon","details":["x",5,[[],['), own, F.lit(',{"retryDelay":"99s"}]],{"retryDelay":98}]}]'))
    kinds = [own, F.concat(F.lit('{"code":1,"details":[{"a":1},{"retryDelay":'), n, F.lit("}]}")), deep, mixed, F.concat(F.lit("quota: retryDelay: '"), n, F.lit("s'")), F.lit('{"details":{"retryDelay":"9"}}')]
    return _q(s, d).withColumn("payload", F.element_at(F.array(*kinds), (F.col("event_id") % 6 + 1).cast("int")))


add("retry_delay", lambda s, d: te.retry_delay(_payloads(s, d)), "SELECT event_id, CASE WHEN event_id % 6 < 5 THEN CAST(event_id % 60 AS DOUBLE) END AS delay_s, code BETWEEN 500 AND 599 AS is_server_error FROM v7_requests")


def _names(s, d):
    ship_package(s)
    return _q(s, d).select("event_id", tx.sanitized_filename(F.col("file_name")).alias("name"))


add("sanitize_filename", _names, r"""SELECT event_id, nfc_normalize(regexp_replace(regexp_extract(file_name, '([^/]*)$', 1), '[<>:"\\|?*]', '_', 'g')) AS name FROM v7_requests""")
add("truncate_text", lambda s, d: view(s, d, "documents").select("doc_id", tx.truncated(F.col("text"), 80).alias("short"), tx.preview(F.col("text"), 80).alias("preview")), f"SELECT doc_id, CASE WHEN length({_STRIP('text')}) > 80 THEN concat(regexp_replace(left({_STRIP('text')}, 77), '\\s+$', ''), '...') ELSE {_STRIP('text')} END AS short, CASE WHEN length(text) > 80 THEN concat(left(text, 77), '...') ELSE text END AS preview FROM documents")
add("job_label", lambda s, d: _q(s, d).select("event_id", tx.label(F.col("file_name")).alias("label")), "SELECT event_id, left(regexp_replace(file_name, '[^A-Za-z0-9_-]+', '-', 'g'), 80) AS label FROM v7_requests")
add("mask_secret", lambda s, d: _q(s, d).select("event_id", te.mask_secret(F.col("file_name")).alias("shown")), "SELECT event_id, CASE WHEN length(file_name) > 8 THEN concat(left(file_name, 4), '...', right(file_name, 4)) ELSE '***' END AS shown FROM v7_requests")
add("transcript_name", lambda s, d: _q(s, d).select("event_id", ur.transcript_name(F.when(F.col("event_id") % 3 == 0, F.col("file_name")), F.when(F.col("event_id") % 3 == 1, F.lit("/tmp/clip.mp4")), F.col("event_id")).alias("name")), r"SELECT event_id, concat(CASE event_id % 3 WHEN 0 THEN regexp_replace(regexp_extract(file_name, '([^/]*)$', 1), '\.[^.]*$', '') WHEN 1 THEN 'clip' ELSE CAST(event_id AS VARCHAR) END, '.srt') AS name FROM v7_requests")

# -- settings ----------------------------------------------------------------------------------
_j = lambda s, d: view(s, d, "v8_jobs")
_c = lambda s, d: view(s, d, "v8_config")
add("src_job_json", lambda s, d: te.job_json(_j(s, d)), "SELECT id, created_at, CAST(json_extract_string(data, '$.batch_size') AS INT) AS batch_size, json_extract_string(data, '$.target_lang') AS target_lang FROM v8_jobs")
add("src_config_kv", lambda s, d: te.config_values(_c(s, d)), "SELECT cfg_key, version, cfg_value AS value FROM v8_config")
add("upsert_latest", lambda s, d: te.upsert_latest(_c(s, d), "cfg_key", "version"), "SELECT cfg_key, arg_max(cfg_value, version) AS cfg_value, max(version) AS version FROM v8_config GROUP BY 1")
_presets = lambda s, d: te.upsert_latest(_c(s, d), "cfg_key", "version").select(F.col("cfg_key").alias("name"), F.when(F.col("version") % 4 == 0, "x").otherwise(F.col("cfg_value")).alias("batch_size"), (F.col("version") % 5 - 2).cast("string").alias("thinking_budget"))
add("list_presets", lambda s, d: te.list_presets(_presets(s, d)), "SELECT cfg_key AS name, CASE WHEN v % 4 = 0 THEN NULL ELSE CAST(value AS INT) END AS batch_size, CASE WHEN v % 5 >= 1 THEN CAST(v % 5 - 2 AS INT) END AS thinking_budget, CASE WHEN v % 5 = 1 THEN 'auto' WHEN v % 5 > 1 THEN CAST(v % 5 - 2 AS VARCHAR) END AS shown FROM (SELECT cfg_key, arg_max(cfg_value, version) AS value, max(version) AS v FROM v8_config GROUP BY 1) x", "v8_config")
add("retention_old_jobs", lambda s, d: te.retention_old(_j(s, d), "created_at", F.to_timestamp(F.lit("1998-01-31")), 30).select("id"), "SELECT id FROM v8_jobs WHERE created_at <= TIMESTAMP '1998-01-31' - INTERVAL 30 DAY")


def _old_files(s, d):
    """Histories written as files; as of an hour from now, none is three days old, and as of four days from now, all are."""
    path = shared_path(s, "old")
    write_named_files(fi.history_files(hi.text_messages(_h(s, d)), F.lit("20240101")), path)
    old = lambda hours: fi.old_files(s, [path], F.current_timestamp() + F.make_dt_interval(hours=F.lit(hours)))
    return old(96).join(old(1).select("path"), "path", "left_anti").select(F.regexp_extract("path", "([^/]*)$", 1).alias("file_name"), "length")


_PLAIN_HISTORY = "concat('[', string_agg(concat('{\"role\":\"', role, '\",\"parts\":[', to_json({'text': coalesce(text, '')}), ']}'), ',' ORDER BY turn), ']')"
add("retention_old_files", _old_files, f"SELECT concat('history_', conv_id, '_20240101.json') AS file_name, CAST(strlen({_PLAIN_HISTORY}) AS BIGINT) AS length FROM v4_history GROUP BY conv_id", "v4_history")
add("job_param_fallback", lambda s, d: te.param_fallback(_j(s, d).select("id", F.when(F.col("id") % 3 == 0, F.lit("X")).otherwise("").alias("target_lang")), te.job_json(_j(s, d)), "target_lang"), "SELECT id, CASE WHEN id % 3 = 0 THEN 'X' ELSE json_extract_string(data, '$.target_lang') END AS target_lang FROM v8_jobs")


def _forms(s, d):
    """Forms with files, with pasted text, with neither; numbers and flags of all kinds, links with and without a video."""
    n = F.col("id")
    pick = lambda *xs: F.element_at(F.array(*[x if isinstance(x, F.Column) else F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    given = F.from_json("data", "batch_size STRING, target_lang STRING")
    files = F.when(n % 4 == 0, F.array(F.struct(F.lit("a.srt").alias("name"), n.cast("string").alias("text"))))
    return _j(s, d).select(
        "id", files.alias("files"), pick("x", " ", "one \"two\"", None, "y").alias("srt_text"), F.when(n % 5 > 0, given["target_lang"]).alias("target_lang"), F.when(n % 7 == 0, "many").otherwise(given["batch_size"]).alias("batch_size"),
        pick("8", None, "-1", "?").alias("thinking_budget"), pick(" on ", "TRUE", "true", None).alias("context_compression"), pick("9000", "", None).alias("context_limit"), pick(" m ", " ", None).alias("model"),
        pick(" https://a/b ", None).alias("youtube_url"), F.when(n % 6 == 0, F.concat(F.lit("/media/"), n.cast("string"))).alias("video_path"), F.when(n % 6 == 0, "clip.mp4").alias("video_name"))


_PICK = lambda *xs: f"[{', '.join(xs)}][CAST(id % {len(xs)} AS INT) + 1]"
_INTAKE = f"""intake AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'a.srt' ELSE 'pasted.srt' END AS file, CASE WHEN id % 4 = 0 THEN CAST(id AS VARCHAR) ELSE {_PICK("'x'", "' '", "'one \"two\"'", "NULL", "'y'")} END AS said,
  CASE WHEN id % 5 > 0 THEN json_extract_string(data, '$.target_lang') ELSE '한국어' END AS target_lang, CASE WHEN id % 7 = 0 THEN 10 ELSE CAST(json_extract_string(data, '$.batch_size') AS INT) END AS batch_size,
  {_PICK("8", "0", "-1", "0")} AS thinking_budget, {_PICK("1", "0", "1", "0")} AS context_compression, {_PICK("9000", "NULL", "NULL")} AS context_limit, {_PICK("'m'", "'gemini-flash-latest'", "'gemini-flash-latest'")} AS model,
  CASE WHEN id % 2 = 0 AND id % 6 <> 0 THEN 'https://a/b' ELSE '' END AS youtube_url, CASE WHEN id % 6 = 0 THEN concat('/media/', id) END AS video_path, CASE WHEN id % 6 = 0 THEN 'clip.mp4' END AS video_name
  FROM v8_jobs WHERE id % 4 = 0 OR id % 5 IN (0, 2, 4))"""
add("job_intake", lambda s, d: te.job_intake(_forms(s, d)), f"WITH {_INTAKE} SELECT id, CAST(to_json({{'files': [{{'name': file, 'text': said}}], 'target_lang': target_lang, 'batch_size': batch_size, 'custom_prompt': '', 'thinking_budget': thinking_budget, 'context_compression': context_compression, 'context_limit': context_limit, 'model': model, 'youtube_url': youtube_url, 'video_path': video_path, 'video_name': video_name}}) AS VARCHAR) AS data FROM intake", "v8_jobs")
add("job_public_view", lambda s, d: te.job_public_view(te.job_intake(_forms(s, d))).withColumn("files", F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["name"], f["text"])), "|")), f"WITH {_INTAKE} SELECT id, concat(file, ':', said) AS files, target_lang, batch_size, '' AS custom_prompt, thinking_budget, context_compression, context_limit, model, youtube_url, video_name, video_path IS NOT NULL AS has_video_context FROM intake", "v8_jobs")
add("preset_cleaning", lambda s, d: te.preset_cleaning(_c(s, d).select(F.col("cfg_key").alias("name"), F.when(F.col("version") % 4 == 0, "x").otherwise(F.col("cfg_value")).alias("batch_size"), (F.col("version") % 5 - 2).cast("string").alias("thinking_budget"))), "SELECT cfg_key AS name, CASE WHEN version % 4 = 0 THEN NULL ELSE CAST(cfg_value AS INT) END AS batch_size, CASE WHEN version % 5 >= 1 THEN CAST(version % 5 - 2 AS INT) END AS thinking_budget, CASE WHEN version % 5 = 1 THEN 'auto' WHEN version % 5 > 1 THEN CAST(version % 5 - 2 AS VARCHAR) END AS shown FROM v8_config")
add("config_typed_updates", lambda s, d: te.config_typed_updates(_c(s, d).select(F.col("version").alias("id"), (F.col("version") % 3).cast("string").alias("size"), F.when(F.col("version") % 2 == 0, "On").otherwise(" ").alias("fast")), ("size",), ("fast",)), "SELECT version AS id, 'size' AS cfg_key, CAST(version % 3 AS VARCHAR) AS cfg_value FROM v8_config WHERE version % 3 > 0 UNION ALL SELECT version, 'fast', '1' FROM v8_config WHERE version % 2 = 0", "v8_config")
_flag = lambda s, d: _j(s, d).withColumn("raw", F.element_at(F.array(*map(F.lit, ("1", "True", "on", "yes", "utterance", "0"))), (F.col("id") % 6 + 1).cast("int")))
add("parse_flags", lambda s, d: _flag(s, d).select("id", *[te.parse_flag(F.col("raw"), k).alias(k) for k in te.FLAG_WORDS]), "SELECT id, id % 6 <= 2 AS lower, id % 6 <= 2 AS exact, id % 6 <= 4 AS utterance FROM v8_jobs")
add("segmentation_mode", lambda s, d: _j(s, d).select("id", te.segmentation_mode(F.col("id") % 5 == 0, F.col("id") % 2 == 0, F.col("id") % 3).alias("mode")), "SELECT id, CASE WHEN id % 5 = 0 THEN 'utterance' WHEN id % 2 <> 0 OR id % 3 <= 0 THEN 'full_file' ELSE 'chunk' END AS mode FROM v8_jobs")
add("normalize_model", lambda s, d: _c(s, d).select("version", te.normalize_model(F.when(F.col("version") % 3 == 0, " ").otherwise(F.col("cfg_key"))).alias("model")), "SELECT version, CASE WHEN version % 3 = 0 THEN 'large-v3' ELSE lower(cfg_key) END AS model FROM v8_config")
add("safe_int", lambda s, d: _c(s, d).select("version", te.safe_int(F.when(F.col("version") % 3 == 0, "7.5").otherwise(F.col("cfg_value")), 1).alias("i"), te.safe_int(F.lit("x")).alias("none")), "SELECT version, CASE WHEN version % 3 = 0 THEN 1 ELSE CAST(cfg_value AS INT) END AS i, CAST(NULL AS INT) AS none FROM v8_config")
add("order_files", lambda s, d: ur.order_files(_q(s, d).select(F.col("event_id").alias("id"), F.col("file_name").alias("name"))), "SELECT event_id AS id, file_name AS name FROM v7_requests")

# -- urls --------------------------------------------------------------------------------------
_v9 = lambda s, d: view(s, d, "v9_urls")
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
_ALLOW = f"({_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com'))"
add("video_host_flag", lambda s, d: _v9(s, d).select("pos", ur.host_allowed(F.col("url"), ("example.com",)).alias("allowed")), f"SELECT pos, {_ALLOW} AS allowed FROM v9_urls")
add("normalize_urls", lambda s, d: ur.normalize_urls(_v9(s, d), ("example.com",)), f"SELECT min(pos) AS pos, url FROM v9_urls WHERE {_ALLOW} GROUP BY url")
add("url_display_name", lambda s, d: _v9(s, d).select("pos", ur.display_name(F.concat(F.when(F.col("pos") % 2 == 0, "https://youtu.be/").otherwise("https://example.com/watch?v="), F.col("pos").cast("string")), ("youtu.be",)).alias("name"), ur.display_name(F.regexp_replace("url", r"\?.*", ""), ("youtu.be",)).alias("other")), "SELECT pos, concat('YouTube - ', CAST(pos AS VARCHAR)) AS name, 'video' AS other FROM v9_urls")
add("media_kind", lambda s, d: _v9(s, d).select("pos", ur.media_kind(F.concat(F.lit("a."), F.element_at(F.array(*map(F.lit, ("MP4", "srt", "mp3", "txt"))), (F.col("pos") % 4 + 1).cast("int")))).alias("kind")), "SELECT pos, CASE pos % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'subtitle' WHEN 2 THEN 'audio' ELSE 'other' END AS kind FROM v9_urls")
add("union_sources", lambda s, d: ur.union_sources(_q(s, d).select(F.col("event_id").alias("id"), F.col("file_name").alias("name")), _v9(s, d)), "SELECT event_id AS pos, 'upload' AS kind, file_name AS source FROM v7_requests UNION ALL SELECT pos, 'url', url FROM v9_urls", "v7_requests", "v9_urls")

# -- transcripts -------------------------------------------------------------------------------
_r = lambda x: _TC(f"round_even({x} * 1000, 0)")
add("nonempty_text", lambda s, d: tr.nonempty_text(_asr(s, d)).select("clip_index"), "SELECT clip_index FROM v6_asr WHERE text <> ''")
add("rebase_absolute", lambda s, d: tr.rebase_absolute(_asr(s, d)).select("media_id", "clip_index", "start_tc", "end_tc", F.round("abs_start", 6).alias("abs_start"), F.round("abs_end", 6).alias("abs_end"), "abs_start_tc", "abs_end_tc"), f"SELECT media_id, clip_index, {_r('s')} AS start_tc, {_r('e')} AS end_tc, round(b + s, 6) AS abs_start, round(b + e, 6) AS abs_end, {_r('(b + s)')} AS abs_start_tc, {_r('(b + e)')} AS abs_end_tc FROM (SELECT *, greatest(start_s, 0) AS s, greatest(end_s, greatest(start_s, 0) + 0.05) AS e, segment_index * 30e0 AS b FROM v6_asr) x")
add("asr_format", lambda s, d: tr.asr_format(_asr(s, d)), f"SELECT media_id, segment_index, clip_index, row_number() OVER (PARTITION BY media_id, segment_index ORDER BY start_s, clip_index) AS number, {_r('start_s')} AS start, {_r('end_s')} AS end, trim(text) AS text FROM v6_asr")
add("asr_windows", lambda s, d: tr.asr_windows(_asr(s, d)).drop("preview"), "SELECT media_id, clip_index, row_number() OVER (PARTITION BY media_id, segment_index ORDER BY start_s, clip_index) AS number, round_even(greatest(start_s, 0), 3) AS start_s, round_even(greatest(end_s, greatest(start_s, 0) + 0.05e0), 3) AS end_s, trim(text) AS text FROM v6_asr")
add("joined_text", lambda s, d: tr.joined_text(_asr(s, d)), "SELECT media_id, segment_index, string_agg(text, ' ' ORDER BY start_s, clip_index) AS text FROM v6_asr WHERE text <> '' GROUP BY 1, 2")
add("asr_context_lines", lambda s, d: tr.asr_context_lines(_asr(s, d), 2), f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY media_id, segment_index ORDER BY start_s, clip_index) AS k FROM v6_asr WHERE text <> ''), l AS (SELECT media_id, segment_index, concat('{tr.CONTEXT_HEADER}', chr(10), string_agg(concat('- [', {_r('start_s')}, ' --> ', {_r('end_s')}, '] ', text), chr(10) ORDER BY k)) AS text FROM k WHERE k <= 2 GROUP BY 1, 2) SELECT media_id, segment_index, coalesce(l.text, '') AS text FROM (SELECT DISTINCT media_id, segment_index FROM v6_asr) a LEFT JOIN l USING (media_id, segment_index)", "v6_asr")
_ABS = "ab AS (SELECT media_id, clip_index, segment_index, greatest(segment_index * 30e0 + start_s, 0) AS s, greatest(segment_index * 30e0 + end_s, 0) AS e, text FROM v6_asr WHERE text <> '')"
add("padding_adjust", lambda s, d: tr.padding_adjust(tr.absolute_entries(_asr(s, d)), (F.floor(F.col("start_s") / 30) + 1) * 30.0).select("media_id", "clip_index", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "text"), f"WITH {_ABS}, p AS (SELECT *, greatest(s - 0.2, 0) AS ps, (floor(s / 30) + 1) * 30 AS lim FROM ab), q AS (SELECT *, CASE WHEN lim > ps THEN least(e + 0.2, lim) ELSE ps + 0.2 END AS pe FROM p) SELECT media_id, clip_index, round(ps, 6) AS start_s, round(CASE WHEN pe <= ps THEN ps + 0.001 ELSE pe END, 6) AS end_s, text FROM q", "v6_asr")
_WALK = lambda src: f"""ord AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY s, clip_index) AS k FROM {src}),
walk AS (SELECT media_id, k, clip_index, text, greatest(s, 0e0) AS s, CASE WHEN e <= greatest(s, 0e0) THEN greatest(s, 0e0) + 0.001 ELSE e END AS e FROM ord WHERE k = 1
  UNION ALL SELECT o.media_id, o.k, o.clip_index, o.text, greatest(o.s, w.e), CASE WHEN o.e <= greatest(o.s, w.e) THEN greatest(o.s, w.e) + 0.001 ELSE o.e END FROM walk w JOIN ord o ON o.media_id = w.media_id AND o.k = w.k + 1)"""  # noqa: E731
_DEFAULT = "src AS (SELECT media_id, clip_index, {s} AS s, {e} AS e, text FROM ab UNION ALL SELECT DISTINCT media_id, 0, 0e0, 0.5e0, '[NO SPEECH DETECTED]' FROM v1_cues WHERE media_id NOT IN (SELECT media_id FROM ab))"
add("monotone_clamp", lambda s, d: tr.sync.monotone_clamp(tr.absolute_entries(_asr(s, d)), _media(s, d)).select("media_id", "clip_index", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "text"), f"WITH RECURSIVE {_ABS}, {_DEFAULT.format(s='s', e='e')}, {_WALK('src')} SELECT media_id, clip_index, round(s, 6) AS start_s, round(e, 6) AS end_s, text FROM walk", "v1_cues", "v6_asr")


def _transcript(s, d):
    from ..operators import cues as cu

    entries = tr.transcript_entries(_asr(s, d), _media(s, d), None)
    return cu.renumber_entries(entries).select("media_id", "entry_index", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"), "text")


add("transcript_pipeline", _transcript, f"WITH RECURSIVE {_ABS}, {_DEFAULT.format(s='greatest(s - 0.2, 0)', e='e + 0.2')}, {_WALK('src')} SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY s, k) AS entry_index, round(s * 1000, 3) AS start_ms, round(e * 1000, 3) AS end_ms, text FROM walk", "v1_cues", "v6_asr")


def _segment_metadata(s, d):
    """Segments of half a minute with their speech, stored, read back and asked for what is spoken for half a second and more in the second minute."""
    part = lambda name, table: view(s, d, table).select("media_id", F.floor(F.col("start_ms") / 30000).cast("int").alias("segment_idx"), "start_ms", "end_ms")
    segments = part("cues", "v1_cues").groupBy("media_id", "segment_idx").agg(F.count("*").alias("cues"))
    path = shared_path(s, "segments")
    fi.write_segments(fi.nested_segments(segments, part("speech", "v2_speech")), path)
    found = fi.spoken_between(fi.read_segments(s, path), 60000, 120000, 500)
    return found.select("media_id", "segment_idx", "cues", F.size("speech").alias("n"), F.aggregate("speech", F.lit(0.0), lambda a, x: a + x["end_ms"] - x["start_ms"]).alias("total_ms"))


add("segment_metadata_table", _segment_metadata, "WITH c AS (SELECT media_id, CAST(floor(start_ms / 30000) AS INT) AS segment_idx, count(*) AS cues FROM v1_cues GROUP BY 1, 2), p AS (SELECT media_id, CAST(floor(start_ms / 30000) AS INT) AS segment_idx, CAST(count(*) AS INT) AS n, sum(end_ms - start_ms) AS total_ms, bool_or(start_ms < 120000 AND end_ms > 60000 AND end_ms - start_ms >= 500) AS asked FROM v2_speech GROUP BY 1, 2) SELECT media_id, segment_idx, cues, n, total_ms FROM c JOIN p USING (media_id, segment_idx) WHERE asked", "v1_cues", "v2_speech")
