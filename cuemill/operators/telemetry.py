"""States, summaries, retention and rates of jobs, and their settings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.delays import DELAY_MESSAGE, payload_delay

ITEM, SEGMENT = ["batch_id", "item_id"], ["batch_id", "item_id", "segment_idx"]


def clamp(x: Column) -> Column:
    return F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def clamp_ratio(done: Column, total: Column) -> Column:
    return F.when(total > 0, clamp(done / total)).otherwise(0.0)


def segment_ratio(end: Column, seg_start: Column, duration: Column) -> Column:
    """Progress in a segment: its end is taken as absolute if it lies behind the segment's start."""
    inside = F.when(end >= seg_start, end - seg_start).otherwise(end)
    return clamp(inside / F.greatest(duration, F.lit(0.001)))


def latest_state(updates: DataFrame, key: list[str] = SEGMENT) -> DataFrame:
    """Last update of each key; null fields keep the older value; progress is clamped."""
    at = F.struct("updated_us", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return updates.groupBy(*key).agg(last("status"), last("progress"), last("message"), F.max("updated_us").alias("updated_us")).withColumn("progress", clamp(F.col("progress")))


def batch_summary(updates: DataFrame) -> DataFrame:
    state = latest_state(updates, ITEM)
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = state.groupBy("batch_id").agg(F.count("*").alias("items"), count("completed"), count("failed"), count("running"), (F.sum("progress") / F.greatest(F.count("*"), F.lit(1))).alias("p"))
    return out.select("batch_id", "items", "completed", "failed", "running", F.round("p", 6).alias("progress"))


def job_summary(updates: DataFrame) -> DataFrame:
    """batch_id, item_id, progress (completed segments by all), failed (sorted segments), ready."""
    state = latest_state(updates)
    out = state.groupBy(*ITEM).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("done"), F.sort_array(F.collect_set(F.when(F.col("status") == "failed", F.col("segment_idx")))).alias("failed"))
    return out.select(*ITEM, F.round(clamp_ratio(F.col("done"), F.col("n")), 6).alias("progress"), F.array_join(F.transform("failed", lambda x: x.cast("string")), ",").alias("failed"), (F.col("done") == F.col("n")).alias("ready"))


def nonterminal_to_failed(state: DataFrame) -> DataFrame:
    over = F.col("status").isin("completed", "failed")
    return state.withColumn("message", F.when(over, F.col("message")).otherwise("interrupted")).withColumn("status", F.when(over, F.col("status")).otherwise("failed"))


def nonterminal_to_cancelled(state: DataFrame) -> DataFrame:
    return state.withColumn("status", F.when(F.col("status").isin("completed", "error", "cancelled"), F.col("status")).otherwise("cancelled"))


def recent_logs(updates: DataFrame, keep: int = 200) -> DataFrame:
    w = Window.partitionBy("batch_id").orderBy(F.desc("updated_us"), F.desc("event_id"))
    return updates.withColumn("back", F.row_number().over(w)).where(F.col("back") <= keep).drop("back")


def retry_selection(requested: DataFrame, state: DataFrame) -> DataFrame:
    """Known segments asked for (text ids) of items that are completed or failed: no doubles."""
    parsed = requested.withColumn("segment_idx", F.trim("segment").try_cast("bigint")).where("segment_idx IS NOT NULL").drop("segment")
    items = latest_state(state, ITEM).where(F.col("status").isin("completed", "failed")).select(*ITEM)
    return parsed.join(state.select(*SEGMENT).distinct(), SEGMENT, "left_semi").join(items, ITEM, "left_semi").select(*SEGMENT).distinct()


def rolling_requests(requests: DataFrame, cap: int = 9, window_s: int = 60) -> DataFrame:
    """event_id, used (requests of the trailing window, its edge included), remaining, reset_s (until the oldest leaves)."""
    w = Window.partitionBy("client_id").orderBy("ts_s").rangeBetween(-window_s, 0)
    used, oldest = F.count("*").over(w), F.min("ts_s").over(w)
    return requests.select("event_id", used.alias("used"), F.greatest(F.lit(cap) - used, F.lit(0)).alias("remaining"), (oldest + window_s - F.col("ts_s")).alias("reset_s"))


def retry_delay(errors: DataFrame) -> DataFrame:
    """event_id, delay_s, is_server_error.

    The delay is the first one found in the JSON payload (an object or a list of objects): its own ``retryDelay``, then that of each of its
    ``details`` in order, and of theirs, at any depth; else the one that the message's text names (column ``message``, or the payload's text).
    """
    message = F.coalesce("message", "payload") if "message" in errors.columns else F.col("payload")
    said = F.nullif(F.regexp_extract(message, DELAY_MESSAGE, 1), F.lit("")).try_cast("double")
    return errors.select("event_id", F.coalesce(payload_delay(F.col("payload")), said).alias("delay_s"), F.col("code").between(500, 599).alias("is_server_error"))


def mask_secret(secret: Column) -> Column:
    return F.when(F.length(secret) > 8, F.concat(F.left(secret, F.lit(4)), F.lit("..."), F.right(secret, F.lit(4)))).otherwise("***")


def safe_int(text: Column, default: int | None = None) -> Column:
    value = F.trim(text).try_cast("int")
    return F.coalesce(value, F.lit(default)) if default is not None else value


#: Truthy words of the three kinds of flags; fixed values.
FLAG_WORDS = {"lower": ("1", "true", "on"), "exact": ("1", "true", "True", "on"), "utterance": ("1", "true", "on", "yes", "utterance")}


def parse_flag(text: Column, kind: str) -> Column:
    value = text if kind == "exact" else F.lower(text)
    return F.coalesce(value.isin(*FLAG_WORDS[kind]), F.lit(False))


def segmentation_mode(utterance: Column, chunking: Column, seconds: Column) -> Column:
    return F.when(utterance, "utterance").when(~chunking | (seconds <= 0), "full_file").otherwise("chunk")


def normalize_model(name: Column, default: str = "large-v3") -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(name)), F.lit("")), F.lit(default))


def job_json(jobs: DataFrame) -> DataFrame:
    """Jobs with their JSON payload decoded: id, created_at, batch_size, target_lang."""
    data = F.from_json("data", "batch_size STRING, target_lang STRING")
    return jobs.select("id", "created_at", safe_int(data["batch_size"], 10).alias("batch_size"), data["target_lang"].alias("target_lang"))


def config_values(config: DataFrame) -> DataFrame:
    """Values as JSON where they can be decoded, else as they are."""
    parsed = F.try_parse_json("cfg_value")
    return config.select("cfg_key", "version", F.coalesce(F.to_json(parsed), F.col("cfg_value")).alias("value"))


#: Fixed: fields of a stored job, and what stands for those that a form leaves out.
JOB = "files array<struct<name:string,text:string>>, target_lang string, batch_size int, custom_prompt string, thinking_budget int, context_compression int, context_limit int, model string, youtube_url string, video_path string, video_name string"
JOB_DEFAULTS = {"target_lang": "한국어", "batch_size": 10, "thinking_budget": 0, "model": "gemini-flash-latest"}
PASTED = "pasted.srt"


def job_intake(forms: DataFrame) -> DataFrame:
    """id and data (JSON, every field of a job) of forms: id and any of files (array of name, text), srt_text and the fields of a job, as texts.

    Without files, a text that isn't blank is the one file; forms with neither are turned away.  Numbers that can't be read are the defaults, a limit of context none;
    a link is left out where there is a video.
    """
    field = lambda name: F.col(name).cast("string") if name in forms.columns else F.lit(None).cast("string")
    pasted = F.when(F.trim(field("srt_text")) != "", F.array(F.struct(F.lit(PASTED).alias("name"), field("srt_text").alias("text"))))
    files = F.coalesce(F.when(F.size("files") > 0, F.col("files")), pasted) if "files" in forms.columns else pasted
    number = lambda name: safe_int(field(name), JOB_DEFAULTS.get(name)).alias(name)
    trimmed = lambda name: F.trim(F.coalesce(field(name), F.lit("")))
    data = F.struct(
        files.alias("files"), F.coalesce(field("target_lang"), F.lit(JOB_DEFAULTS["target_lang"])).alias("target_lang"), number("batch_size"), F.coalesce(field("custom_prompt"), F.lit("")).alias("custom_prompt"), number("thinking_budget"),
        parse_flag(trimmed("context_compression"), "exact").cast("int").alias("context_compression"), number("context_limit"), F.coalesce(F.nullif(trimmed("model"), F.lit("")), F.lit(JOB_DEFAULTS["model"])).alias("model"),
        F.when(field("video_path").isNotNull(), "").otherwise(trimmed("youtube_url")).alias("youtube_url"), field("video_path").alias("video_path"), field("video_name").alias("video_name"),
    )
    return forms.where(files.isNotNull()).select("id", F.to_json(data, {"ignoreNullFields": "false"}).alias("data"))


def job_public_view(intake: DataFrame) -> DataFrame:
    """id and the fields of stored jobs, but for the path of the video; instead, whether there is one."""
    data = F.from_json("data", JOB)
    shown = [f.split()[0] for f in re.split(r", (?=\w+ )", JOB) if not f.startswith("video_path")]
    return intake.select("id", *[data[f].alias(f) for f in shown], (F.coalesce(data["video_path"], F.lit("")) != "").alias("has_video_context"))


def upsert_latest(rows: DataFrame, key: str, version: str, deleted: Column | None = None) -> DataFrame:
    """One row a key: the last version, of equal versions the largest row; keys whose last row is ``deleted`` go."""
    columns = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(version, *columns)).alias("r")).select(key, "r.*")
    return last if deleted is None else last.where(~F.coalesce(deleted, F.lit(False)))


def list_presets(presets: DataFrame, name: str | None = None) -> DataFrame:
    """Cleaned presets in order of their names, or the one of that name."""
    clean = preset_cleaning(presets)
    return clean.orderBy("name") if name is None else clean.where(F.col("name") == name)


def param_fallback(requests: DataFrame, jobs: DataFrame, name: str) -> DataFrame:
    """id and a parameter: the request's where it isn't blank, else the stored job's."""
    stored = jobs.select("id", F.col(name).alias("stored"))
    return requests.join(stored, "id", "left").select("id", F.coalesce(F.when(F.trim(name) != "", F.col(name)), "stored").alias(name))


def retention_old(rows: DataFrame, at: str, as_of: Column, days: int, strict: bool = False) -> DataFrame:
    """Candidates for deletion; nothing is deleted. Those of exactly the age are old as well (jobs), or with ``strict`` not yet (files)."""
    limit = as_of - F.make_dt_interval(F.lit(days))
    return rows.where(F.col(at) < limit if strict else F.col(at) <= limit)


def config_typed_updates(forms: DataFrame, ints: tuple[str, ...], flags: tuple[str, ...]) -> DataFrame:
    """id, cfg_key, cfg_value of form columns: whole numbers above 0, flags as 0 or 1; blanks and the rest are dropped."""
    typed = forms.select("id", *[F.when(safe_int(F.col(c)) > 0, safe_int(F.col(c)).cast("string")).alias(c) for c in ints], *[F.when(F.trim(c) != "", parse_flag(F.col(c), "lower").cast("int").cast("string")).alias(c) for c in flags])
    return typed.unpivot("id", list(ints + flags), "cfg_key", "cfg_value").where("cfg_value IS NOT NULL")


def preset_cleaning(presets: DataFrame) -> DataFrame:
    """batch_size as a number or null; thinking_budget only from -1 on, shown as auto where it is -1."""
    budget = safe_int(F.col("thinking_budget"))
    budget = F.when(budget >= -1, budget)
    return presets.select("name", safe_int(F.col("batch_size")).alias("batch_size"), budget.alias("thinking_budget"), F.when(budget == -1, "auto").otherwise(budget.cast("string")).alias("shown"))
