"""Queries over cues and speech, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timecode as tc
from ..operators import intervals as iv
from ..operators import sync
from ..sources.fixtures import view, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DURATION_MS = 260_000


def add(name: str, run, sql: str, *views: str) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(sql, *views)


def _cs(s, d):
    return view(s, d, "v1_cues"), view(s, d, "v2_speech")


def _media(s, d):
    """media_id, duration_ms."""
    return view(s, d, "v1_cues").select("media_id").distinct().withColumn("duration_ms", F.lit(float(DURATION_MS)))


_OVER = """over_ms AS (SELECT c.media_id, c.pos, sum(least(c.end_ms, s.end_ms) - greatest(c.start_ms, s.start_ms)) AS ov
  FROM {c} c JOIN {s} s ON c.media_id = s.media_id AND c.start_ms < s.end_ms AND s.start_ms < c.end_ms GROUP BY 1, 2)"""
_MERGED = """seg1 AS (SELECT *, max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v2_speech WHERE end_ms > start_ms),
seg2 AS (SELECT *, sum(CASE WHEN start_ms - b <= 150 THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY start_ms, seg_id) AS island FROM seg1),
merged AS (SELECT media_id, arg_min(seg_id, start_ms * 1000000 + seg_id) AS seg_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM seg2 GROUP BY media_id, island)"""


def _removed(speech: str) -> str:
    return f"""spoken AS (SELECT DISTINCT media_id FROM {speech}),
cut0 AS (SELECT c.*, lead(start_ms) OVER (PARTITION BY media_id ORDER BY entry_index, pos) AS nxt, media_id IN (SELECT media_id FROM spoken) AS has FROM cues0 c),
cut1 AS (SELECT *, CASE WHEN end_ms > nxt THEN greatest(start_ms, nxt) ELSE end_ms END AS e FROM cut0),
cut AS (SELECT media_id, pos, entry_index, text, start_ms, CASE WHEN has THEN CASE WHEN e <= start_ms THEN start_ms + 1 ELSE e END ELSE end_ms END AS end_ms, has FROM cut1),
{_OVER.format(c="cut", s=speech)},
kept AS (SELECT cut.* FROM cut LEFT JOIN over_ms o USING (media_id, pos) WHERE NOT has OR end_ms - start_ms < 1200 OR coalesce(ov, 0) >= greatest(120, (end_ms - start_ms) * 0.1))"""


def _boundary(points: str, speech: str, back: int, ahead: int, pad: int, start: bool, out: str) -> str:
    target = "s.start_ms" if start else "s.end_ms"
    return f"""{out}_c AS (SELECT p.media_id, p.id, {target} {"-" if start else "+"} {pad} AS moved, s.start_ms AS s, s.seg_id,
  0.7 / (1.0 + abs({target} - p.boundary) / 100.0) + 0.3 * least((s.end_ms - s.start_ms) / 1000.0, 1.0) AS score
  FROM {points} p JOIN {speech} s ON p.media_id = s.media_id AND s.end_ms >= p.boundary - {back} AND s.start_ms <= p.boundary + {ahead}),
{out} AS (SELECT * FROM {out}_c QUALIFY row_number() OVER (PARTITION BY media_id, id ORDER BY score DESC, s, seg_id) = 1)"""


_SNAP = f"""{_boundary("starts", "seg", 800, 400, 80, True, "bs")},
{_boundary("ends", "seg", 400, 800, 80, False, "be")},
near AS (SELECT c.*, bs.moved AS ms, bs.score AS ss, be.moved AS me, be.score AS es, lag(c.end_ms) OVER w AS before, lead(c.start_ms) OVER w AS after
  FROM chunks c LEFT JOIN bs ON bs.media_id = c.media_id AND bs.id = c.chunk_id LEFT JOIN be ON be.media_id = c.media_id AND be.id = c.chunk_id WINDOW w AS (PARTITION BY c.media_id ORDER BY c.chunk_id)),
near2 AS (SELECT *, CASE WHEN ss >= 0.3 THEN greatest(greatest(least(ms, start_ms + 800), start_ms - 500), before) ELSE start_ms END AS s,
  CASE WHEN es >= 0.3 THEN least(greatest(least(me, end_ms + 800), end_ms - 500), after) ELSE end_ms END AS e FROM near),
snapped AS (SELECT media_id, chunk_id, start_ms, end_ms, n, CASE WHEN e - s < 300 THEN start_ms ELSE s END AS new_start, CASE WHEN e - s < 300 THEN end_ms ELSE e END AS new_end FROM near2)"""
_CHUNKS = """ch0 AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY media_id ORDER BY pos) > 200 THEN 1 ELSE 0 END AS fresh FROM {src}),
chunked AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY media_id ORDER BY pos) AS INT) AS chunk_id FROM ch0),
chunks AS (SELECT media_id, chunk_id, arg_min(start_ms, pos) AS start_ms, arg_max(end_ms, pos) AS end_ms, count(*) AS n FROM chunked GROUP BY 1, 2),
starts AS (SELECT media_id, chunk_id AS id, start_ms AS boundary FROM chunks),
ends AS (SELECT media_id, chunk_id AS id, end_ms AS boundary FROM chunks)"""
_SYNC = f"""{_MERGED},
seg AS (SELECT * FROM merged WHERE end_ms - start_ms >= 200),
cues0 AS (SELECT * FROM v1_cues WHERE media_id IN (SELECT media_id FROM seg)),
{_removed("seg")},
{_CHUNKS.format(src="kept")},
{_SNAP},
fl AS (SELECT media_id, chunk_id, min(pos) AS p0, max(pos) AS p1 FROM chunked GROUP BY 1, 2),
edge AS (SELECT c.media_id, c.pos, c.entry_index, c.text,
  CASE WHEN (c.entry_index, c.start_ms, c.end_ms, c.text) = (f.entry_index, f.start_ms, f.end_ms, f.text) THEN new_start ELSE c.start_ms END AS start_ms,
  CASE WHEN (c.entry_index, c.start_ms, c.end_ms, c.text) = (l.entry_index, l.start_ms, l.end_ms, l.text) THEN new_end ELSE c.end_ms END AS end_ms, c.chunk_id
  FROM chunked c JOIN fl USING (media_id, chunk_id) JOIN chunked f ON f.media_id = c.media_id AND f.pos = p0 JOIN chunked l ON l.media_id = c.media_id AND l.pos = p1
  JOIN snapped s ON s.media_id = c.media_id AND s.chunk_id = c.chunk_id)"""


def _fixed(src: str) -> str:
    """Recursive CTE of the overlap repair; ``fixed`` has the result."""
    return f"""ord AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY entry_index, pos) AS k FROM {src}),
walk AS (SELECT media_id, k, entry_index, pos, text, start_ms, end_ms, CAST(NULL AS DOUBLE) AS prev_end FROM ord WHERE k = 1
  UNION ALL
  SELECT q.media_id, q.k, q.entry_index, q.pos, q.text, CASE WHEN over THEN least(q.end_ms - 300, s2) ELSE q.start_ms END, q.end_ms, CASE WHEN over THEN greatest(q.l_start + 300, e2) ELSE q.l_end END
  FROM (SELECT *, CASE WHEN end_ms - s1 < 300 THEN end_ms - 300 ELSE s1 END AS s2, CASE WHEN end_ms - s1 < 300 THEN end_ms - 310 ELSE e1 END AS e2
    FROM (SELECT *, CASE WHEN mid - 5 - l_start < 300 THEN l_start + 300 ELSE mid - 5 END AS e1, CASE WHEN mid - 5 - l_start < 300 THEN l_start + 310 ELSE mid + 5 END AS s1
      FROM (SELECT o.*, w.start_ms AS l_start, w.end_ms AS l_end, w.end_ms > o.start_ms AS over, (w.end_ms + o.start_ms) / 2 AS mid FROM walk w JOIN ord o ON o.media_id = w.media_id AND o.k = w.k + 1) x) y) q),
fixed AS (SELECT w.media_id, w.entry_index, w.pos, w.text, w.start_ms, coalesce(n.prev_end, w.end_ms) AS end_ms FROM walk w LEFT JOIN walk n ON n.media_id = w.media_id AND n.k = w.k + 1)"""


_TC = lambda ms: f"printf('%02d:%02d:%02d,%03d', CAST({ms} AS BIGINT) // 3600000, CAST({ms} AS BIGINT) // 60000 % 60, CAST({ms} AS BIGINT) // 1000 % 60, CAST({ms} AS BIGINT) % 1000)"

# -- intervals ---------------------------------------------------------------------------------
add("merge_close_segments", lambda s, d: iv.merge_close_segments(view(s, d, "v2_speech")), f"WITH {_MERGED} SELECT media_id, seg_id, start_ms, end_ms FROM merged", "v2_speech")
add("valid_segments", lambda s, d: iv.valid_segments(view(s, d, "v2_speech")), "SELECT media_id, seg_id, start_ms, end_ms FROM v2_speech WHERE end_ms > start_ms")
add("filter_short_segments", lambda s, d: iv.filter_short_segments(view(s, d, "v2_speech"), 500), "SELECT media_id, seg_id, start_ms, end_ms FROM v2_speech WHERE end_ms - start_ms >= 500")
add("clamp_segments", lambda s, d: iv.clamp_segments(view(s, d, "v2_speech"), F.lit(float(DURATION_MS))), f"SELECT media_id, seg_id, round_even(start_ms / 1000, 3) AS start_s, round_even(least(end_ms, {DURATION_MS}) / 1000, 3) AS end_s FROM v2_speech WHERE least(end_ms, {DURATION_MS}) > start_ms")
add("utterance_segments", lambda s, d: sync.utterance_segments(view(s, d, "v2_speech"), _media(s, d)), f"""SELECT media_id, idx, start_s, end_s FROM (SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seg_id) AS INT) AS idx, start_ms / 1000 AS start_s, end_ms / 1000 AS end_s FROM v2_speech) x WHERE end_s - start_s > 0.5
UNION ALL SELECT DISTINCT media_id, 1, 0.0, {DURATION_MS / 1000} FROM v1_cues WHERE media_id NOT IN (SELECT media_id FROM v2_speech)""")
add("overlap_length", lambda s, d: iv.with_overlap(*_cs(s, d)).select("media_id", "pos", "overlap_ms"), f"WITH {_OVER.format(c='v1_cues', s='v2_speech')} SELECT media_id, pos, coalesce(ov, 0.0) AS overlap_ms FROM v1_cues LEFT JOIN over_ms USING (media_id, pos)", "v1_cues", "v2_speech")
add("entries_for_segment", lambda s, d: iv.entries_for_segment(*_cs(s, d)), "SELECT c.media_id, s.seg_id, c.pos FROM v1_cues c JOIN v2_speech s ON c.media_id = s.media_id AND c.start_ms < s.end_ms AND c.end_ms > s.start_ms")
_GAPS = """clip AS (SELECT c.media_id, c.pos, c.start_ms, c.end_ms, s.seg_id, greatest(c.start_ms, s.start_ms) AS s, least(c.end_ms, s.end_ms) AS e FROM v1_cues c JOIN v2_speech s ON c.media_id = s.media_id AND c.start_ms < s.end_ms AND s.start_ms < c.end_ms),
g0 AS (SELECT media_id, pos, coalesce(max(e) OVER (PARTITION BY media_id, pos ORDER BY s, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_ms) AS gap_start, s AS gap_end FROM clip
  UNION ALL SELECT media_id, pos, max(e), max(end_ms) FROM clip GROUP BY 1, 2
  UNION ALL SELECT media_id, pos, start_ms, end_ms FROM v1_cues WHERE (media_id, pos) NOT IN (SELECT (media_id, pos) FROM clip)),
gaps AS (SELECT * FROM g0 WHERE gap_end > gap_start)"""
_NOISE = f"""{_GAPS},
sums AS (SELECT media_id, g.pos, sum(gap_end - gap_start) AS total, max(gap_end - gap_start) AS longest, bool_or(abs(gap_start - start_ms) < 50 OR abs(gap_end - end_ms) < 50) AS at_edge FROM gaps g JOIN v1_cues c USING (media_id, pos) GROUP BY 1, 2),
noise AS (SELECT c.*, coalesce(total / (end_ms - start_ms) <= 0.15 OR (NOT at_edge AND longest / (end_ms - start_ms) <= 0.15), false) AS is_noise FROM v1_cues c LEFT JOIN sums USING (media_id, pos))"""
add("silence_gaps", lambda s, d: iv.silence_gaps(*_cs(s, d)), f"WITH {_GAPS} SELECT * FROM gaps", "v1_cues", "v2_speech")
add("silence_totals", lambda s, d: iv.silence_totals(iv.silence_gaps(*_cs(s, d))), f"WITH {_GAPS} SELECT media_id, pos, sum(gap_end - gap_start) AS total_ms, max(gap_end - gap_start) AS max_ms FROM gaps GROUP BY 1, 2", "v1_cues", "v2_speech")
add("silence_noise_flag", lambda s, d: iv.silence_noise_flag(*_cs(s, d)).select("media_id", "pos", "is_noise"), f"WITH {_NOISE} SELECT media_id, pos, is_noise FROM noise", "v1_cues", "v2_speech")
add("filter_silent_entries", lambda s, d: iv.filter_silent_entries(*_cs(s, d)).select("media_id", "pos"), f"WITH {_NOISE}, {_OVER.format(c='v1_cues', s='v2_speech')} SELECT media_id, pos FROM noise LEFT JOIN over_ms USING (media_id, pos) WHERE is_noise OR coalesce(ov, 0) >= greatest(120, (end_ms - start_ms) * 0.1) OR media_id NOT IN (SELECT media_id FROM v2_speech)", "v1_cues", "v2_speech")
add("remove_silent_entries", lambda s, d: iv.remove_silent_entries(*_cs(s, d)).select("media_id", "pos", "start_ms", "end_ms"), f"WITH cues0 AS (SELECT * FROM v1_cues), {_removed('v2_speech')} SELECT media_id, pos, start_ms, end_ms FROM kept", "v1_cues", "v2_speech")


def _points(s, d):
    return view(s, d, "v1_cues").select("media_id", F.col("pos").alias("id"), F.col("start_ms").alias("boundary"))


add("best_boundary", lambda s, d: iv.best_boundary(_points(s, d), view(s, d, "v2_speech"), 800, 400, 80, True).withColumn("score", F.floor(F.col("score") * 1e6 + 0.37)), f"WITH pts AS (SELECT media_id, pos AS id, start_ms AS boundary FROM v1_cues), {_boundary('pts', 'v2_speech', 800, 400, 80, True, 'b')} SELECT p.media_id, p.id, p.boundary, b.moved AS new_boundary, CAST(floor(coalesce(b.score, 0.0) * 1e6 + 0.37) AS BIGINT) AS score FROM pts p LEFT JOIN b ON b.media_id = p.media_id AND b.id = p.id", "v1_cues", "v2_speech")
# -- chunks ------------------------------------------------------------------------------------
add("chunk_by_gap", lambda s, d: sync.chunk_bounds(sync.chunk_by_gap(view(s, d, "v1_cues"))), f"WITH {_CHUNKS.format(src='v1_cues')} SELECT * FROM chunks", "v1_cues")
add("chunk_individual", lambda s, d: sync.chunk_individual(view(s, d, "v1_cues")).select("media_id", "pos", "chunk_id"), "SELECT media_id, pos, CAST(row_number() OVER (PARTITION BY media_id ORDER BY pos) - 1 AS INT) AS chunk_id FROM v1_cues")


def _chunked(s, d):
    return sync.chunk_by_gap(view(s, d, "v1_cues"))


def _snapped(s, d):
    return sync.snap_chunks(sync.chunk_bounds(_chunked(s, d)), view(s, d, "v2_speech"))


_SNAP_ALL = f"seg AS (SELECT * FROM v2_speech), {_CHUNKS.format(src='v1_cues')}, {_SNAP}"
add("snap_chunks", _snapped, f"WITH {_SNAP_ALL} SELECT * FROM snapped", "v1_cues", "v2_speech")
add("apply_edge_only", lambda s, d: sync.apply_edge_only(_chunked(s, d), _snapped(s, d)).select("media_id", "pos", "start_ms", "end_ms"), f"WITH {_SNAP_ALL}, fl AS (SELECT media_id, chunk_id, min(pos) AS p0, max(pos) AS p1 FROM chunked GROUP BY 1, 2) SELECT c.media_id, c.pos, CASE WHEN pos = p0 THEN new_start ELSE c.start_ms END AS start_ms, CASE WHEN pos = p1 THEN new_end ELSE c.end_ms END AS end_ms FROM chunked c JOIN fl USING (media_id, chunk_id) JOIN snapped s USING (media_id, chunk_id)", "v1_cues", "v2_speech")
add("apply_proportional", lambda s, d: sync.apply_proportional(_chunked(s, d), _snapped(s, d)).select("media_id", "pos", F.round("start_ms", 6).alias("start_ms"), F.round("end_ms", 6).alias("end_ms")), f"WITH {_SNAP_ALL} SELECT c.media_id, c.pos, round(CASE WHEN s.end_ms > s.start_ms THEN new_start + (c.start_ms - s.start_ms) * ((new_end - new_start) / (s.end_ms - s.start_ms)) ELSE c.start_ms END, 6) AS start_ms, round(CASE WHEN s.end_ms > s.start_ms THEN new_start + (c.end_ms - s.start_ms) * ((new_end - new_start) / (s.end_ms - s.start_ms)) ELSE c.end_ms END, 6) AS end_ms FROM chunked c JOIN snapped s USING (media_id, chunk_id)", "v1_cues", "v2_speech")
add("fix_overlaps", lambda s, d: sync.fix_overlaps(view(s, d, "v1_cues")).select("media_id", "entry_index", "start_ms", "end_ms"), f"WITH RECURSIVE {_fixed('v1_cues')} SELECT media_id, entry_index, start_ms, end_ms FROM fixed", "v1_cues")
add("overlap_count", lambda s, d: sync.overlap_count(view(s, d, "v1_cues")), "SELECT media_id, count(*) FILTER (WHERE p > start_ms) AS overlaps FROM (SELECT *, lag(end_ms) OVER (PARTITION BY media_id ORDER BY entry_index, pos) AS p FROM v1_cues) x GROUP BY 1")
_PACK = """ord AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seg_id) AS k FROM v2_speech),
walk AS (SELECT media_id, k, seg_id, start_ms, end_ms, 0 AS group_id, start_ms AS group_start FROM ord WHERE k = 1
  UNION ALL SELECT o.media_id, o.k, o.seg_id, o.start_ms, o.end_ms, CASE WHEN o.end_ms - w.group_start <= {m} OR o.end_ms - o.start_ms >= {m} THEN w.group_id ELSE w.group_id + 1 END,
  CASE WHEN o.end_ms - w.group_start <= {m} OR o.end_ms - o.start_ms >= {m} THEN w.group_start ELSE o.start_ms END FROM walk w JOIN ord o ON o.media_id = w.media_id AND o.k = w.k + 1)"""
add("pack_speech", lambda s, d: sync.pack_speech(view(s, d, "v2_speech"), 60_000).select("media_id", "seg_id", "group_id"), f"WITH RECURSIVE {_PACK.format(m=60000)} SELECT media_id, seg_id, group_id FROM walk", "v2_speech")
add("split_plan", lambda s, d: sync.split_plan(view(s, d, "v2_speech"), _media(s, d), 1), f"WITH RECURSIVE {_PACK.format(m=60000)}, g AS (SELECT media_id, group_id, min(group_start) AS s, arg_max(end_ms, k) AS e FROM walk GROUP BY 1, 2 UNION ALL SELECT DISTINCT media_id, 0, 0.0, {DURATION_MS}.0 FROM v1_cues WHERE media_id NOT IN (SELECT media_id FROM v2_speech)) SELECT media_id, group_id + 1 AS idx, round_even(s / 1000, 3) AS start_s, round_even(e / 1000, 3) AS end_s, round_even((e - s) / 1000, 3) AS duration_s FROM g WHERE e > s", "v1_cues", "v2_speech")
add("sync_stats", lambda s, d: sync.sync_stats(*_cs(s, d)), f"""WITH {_SYNC},
ovl AS (SELECT media_id, count(*) FILTER (WHERE p > start_ms) AS n FROM (SELECT *, lag(end_ms) OVER (PARTITION BY media_id ORDER BY entry_index, pos) AS p FROM edge) x GROUP BY 1),
m AS (SELECT media_id, count(*) AS n_before FROM v1_cues GROUP BY 1),
e AS (SELECT media_id, count(*) AS n FROM kept GROUP BY 1), g AS (SELECT media_id, count(*) AS n FROM seg GROUP BY 1),
c AS (SELECT media_id, count(*) AS n, count(*) FILTER (WHERE abs(new_start - start_ms) > 1 OR abs(new_end - end_ms) > 1) AS moved FROM snapped GROUP BY 1),
r AS (SELECT m.media_id, CASE WHEN g.n IS NULL THEN 'no_segments' ELSE 'success' END AS status, CASE WHEN g.n IS NULL THEN n_before ELSE coalesce(e.n, 0) END AS entries, coalesce(c.n, 0) AS chunks, coalesce(g.n, 0) AS vad_segments, coalesce(c.moved, 0) AS corrections, coalesce(ovl.n, 0) AS overlaps_fixed, n_before
  FROM m LEFT JOIN e USING (media_id) LEFT JOIN g USING (media_id) LEFT JOIN c USING (media_id) LEFT JOIN ovl USING (media_id))
SELECT media_id, status, entries, chunks, vad_segments, corrections, overlaps_fixed, n_before - entries AS silent_removed FROM r""", "v1_cues", "v2_speech")
add("sync_pipeline", lambda s, d: sync.sync_pipeline(*_cs(s, d)).select("media_id", "entry_index", tc.ms_to_tc(F.col("start_ms")).alias("start"), tc.ms_to_tc(F.col("end_ms")).alias("end"), "text"), f"""WITH RECURSIVE {_SYNC}, {_fixed('edge')},
r AS (SELECT media_id, entry_index, start_ms, end_ms, text FROM fixed UNION ALL SELECT media_id, entry_index, start_ms, end_ms, text FROM v1_cues WHERE media_id NOT IN (SELECT media_id FROM seg))
SELECT media_id, entry_index, {_TC("floor(greatest(start_ms, 0))")} AS start, {_TC("floor(greatest(end_ms, 0))")} AS end, text FROM r""", "v1_cues", "v2_speech")
add("cleanup_pipeline", lambda s, d: sync.cleanup_pipeline(*_cs(s, d)), f"WITH cues0 AS (SELECT * FROM v1_cues), {_removed('v2_speech')}, t AS (SELECT media_id, count(*) AS total_entries FROM v1_cues GROUP BY 1), k AS (SELECT media_id, count(*) AS kept_n FROM kept GROUP BY 1) SELECT media_id, total_entries, coalesce(kept_n, 0) AS kept, total_entries - coalesce(kept_n, 0) AS removed FROM t LEFT JOIN k USING (media_id)", "v1_cues", "v2_speech")
