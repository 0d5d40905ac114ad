"""Media urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIDEO, SUBTITLE, AUDIO = ("mp4", "mkv", "avi", "mov", "webm"), ("srt",), ("mp3", "wav", "m4a", "flac", "ogg")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def host_allowed(url: Column, suffixes: tuple[str, ...]) -> Column:
    fits = F.lit(False)
    for s in suffixes:
        fits = fits | (host(url) == s) | F.endswith(host(url), F.lit("." + s))
    return F.coalesce(fits, F.lit(False))


def normalize_urls(urls: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """pos, url: trimmed, with a scheme, of allowed hosts; of repeats the first."""
    u = F.trim("url")
    full = F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    clean = urls.where(u != "").select("pos", full.alias("url")).where(host_allowed(F.col("url"), suffixes))
    return clean.groupBy("url").agg(F.min("pos").alias("pos"))


def display_name(url: Column, short_hosts: tuple[str, ...], fallback: str = "video") -> Column:
    """The video id, from a short host's path or the query, behind a title; else the fallback."""
    path = F.element_at(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), 2)
    found = F.when(host(url).isin(*short_hosts), path).otherwise(F.try_parse_url(url, F.lit("QUERY"), F.lit("v")))
    found = F.nullif(found, F.lit(""))
    return F.when(found.isNotNull(), F.concat(F.lit("YouTube - "), found)).otherwise(fallback)


def media_kind(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(*VIDEO), "video").when(ext.isin(*SUBTITLE), "subtitle").when(ext.isin(*AUDIO), "audio").otherwise("other")


def transcript_name(display: Column, path: Column, job: Column) -> Column:
    """Display name, else base name of the path, without extension, as .srt; else the job."""
    base = lambda c: F.nullif(F.regexp_replace(F.regexp_replace(F.trim(c), r"^.*[/\\]", ""), r"\.[^.]*$", ""), F.lit(""))
    return F.concat(F.coalesce(base(display), base(path), job.cast("string")), F.lit(".srt"))


def union_sources(uploads: DataFrame, urls: DataFrame) -> DataFrame:
    """One item table: uploads (id, name), then urls (pos, url)."""
    a = uploads.select(F.col("id").alias("pos"), F.lit("upload").alias("kind"), F.col("name").alias("source"))
    return a.unionByName(urls.select("pos", F.lit("url").alias("kind"), F.col("url").alias("source")))


def order_files(files: DataFrame, fold_case: bool = False) -> DataFrame:
    """By name, in code-point order or without case."""
    return files.orderBy(F.lower("name") if fold_case else "name", "id")
