"""URL filters: pattern rules, indexed by their rarest literal token.

A rule is ``host/path``.  It fits its host and all subdomains if the url's path
starts with the rule's path; ``*`` stands for any run of characters.  From each rule
the literal tokens (runs of ``[a-z0-9]`` with a separator on both sides) are taken, and
the one that is rarest among all urls becomes the rule's index key.  The tokens of
a url fetch candidate rules, and regular expressions run for those alone.

Everything is DataFrame expressions.  A list of at most ``INLINE_RULES`` rules is an
index inside the expression, so that judging is a projection without a shuffle.  A
longer list is a table that is joined on the token.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lists of up to so many rules stand in the expression itself.
INLINE_RULES = 256


class UrlRule(NamedTuple):
    pattern: str
    verdict: str
    #: Rules of a higher rank win over any of a lower one; within a rank the longest wins.
    rank: int = 0


#: Fixed rules of the contract.
BASE_RULES = (
    UrlRule("net/", "block", 1),
    UrlRule("example.net/en/", "allow", 1),
    UrlRule("example.com/de/", "block", 1),
    UrlRule("org/fr/", "allow", 1),
)
#: The method's own rules, for urls that no base rule fits.
OWN_RULES = (
    UrlRule("*/*/login/", "block"),
    UrlRule("*/*/cart/", "block"),
    UrlRule("casino-*/", "block"),
    UrlRule("free-bets.*/", "block"),
    UrlRule("cheap-pills.*/", "block"),
    UrlRule("*/*/tracking/pixel.", "block"),
    UrlRule("*/robots.txt", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_regex(pattern: str) -> str:
    """Regular expression of a rule over host and path written one after the other."""
    host, slash, path = pattern.partition("/")
    host_part = "".join("[^/]*" if x == "*" else re.escape(x) for x in re.split(r"(\*)", host) if x)
    path_part = "".join(".*" if x == "*" else re.escape(x) for x in re.split(r"(\*)", slash + path) if x)
    return f"(?s)^{'' if host.startswith('*') else r'(?:[^/]*\.)?'}{host_part}{path_part}"


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every url that the rule fits must have whole."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9]+", pattern):
        left, right = pattern[m.start() - 1 : m.start()], pattern[m.end() : m.end() + 1]
        if left != "*" and right not in ("", "*"):
            found.append(m[0].lower())
    return found


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; null or no ://: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(key: Column) -> Column:
    return F.array_distinct(F.split(F.lower(key), "[^a-z0-9]+"))


def rarest_tokens(keys: DataFrame, rules: tuple[UrlRule, ...]) -> dict[str, str]:
    """Pattern -> its literal token that the fewest urls have; rules without one are left out.

    One aggregation over all urls; only counts of the rules' own tokens come to the driver.
    """
    wanted = sorted({t for r in rules for t in literal_tokens(r.pattern)})
    if not wanted:
        return {}
    only = F.array_intersect(url_tokens(F.col("key")), F.array(*map(F.lit, wanted)))
    counts = {r["token"]: r["n"] for r in keys.select(F.explode(only).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {r.pattern: min(ts, key=lambda t: (counts.get(t, 0), t)) for r in rules if (ts := literal_tokens(r.pattern))}


def _rule_struct(r: UrlRule) -> Column:
    return F.struct(F.lit(r.rank).alias("rank"), F.lit(len(r.pattern)).alias("size"), F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(rule_regex(r.pattern)).alias("regex"))


def _best(candidates: Column, key: Column) -> Column:
    return F.array_max(F.filter(candidates, lambda r: F.regexp_like(key, r["regex"])))


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...], id_col: str = "page_id", url_col: str = "url", inline: bool | None = None) -> DataFrame:
    """Judges every url: page_id, host, path, rule, verdict, rank of the rule (all three null where none fits).

    Nulls: a null url has an empty host and path and fits no rule; a null id stays null.
    Ties: of equally long rules of a rank the greater in text order wins.  Repeated rows stay
    repeated.  An empty table gives an empty table.  Other columns of the input are ignored.
    """
    rules = tuple(dict.fromkeys(rules))
    at = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    at = at.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", F.concat("host", "path"))
    token_of = rarest_tokens(at.select("key"), rules)
    unindexed = [r for r in rules if r.pattern not in token_of]
    indexed = [r for r in rules if r.pattern in token_of]
    key, always = F.col("key"), F.array(*map(_rule_struct, unindexed)) if unindexed else None
    if inline if inline is not None else len(rules) <= INLINE_RULES:
        lists: dict[str, list[UrlRule]] = {}
        for r in indexed:
            lists.setdefault(token_of[r.pattern], []).append(r)
        found = [always] if always is not None else []
        if lists:
            index = F.create_map(*(x for t, rs in sorted(lists.items()) for x in (F.lit(t), F.array(*map(_rule_struct, rs)))))
            hits = F.array_intersect(url_tokens(key), F.array(*map(F.lit, sorted(lists))))
            found.append(F.flatten(F.transform(hits, lambda t: F.try_element_at(index, t))))
        at = at.withColumn("best", _best(F.concat(*found) if len(found) > 1 else found[0], key)) if found else at.withColumn("best", F.lit(None).cast("struct<rank:int,size:int,rule:string,verdict:string>"))
    else:
        spark = pages.sparkSession
        table = spark.createDataFrame([(token_of[r.pattern], r.rank, len(r.pattern), r.pattern, r.verdict, rule_regex(r.pattern)) for r in indexed], "token string, rank int, size int, rule string, verdict string, regex string")
        # each url once: a url that a third of the rows have is judged once, and the join back is an ordinary one that Spark can split
        urls = at.select("key").distinct()
        hits = urls.select("key", F.explode(url_tokens(key)).alias("token")).join(table, "token").where(F.regexp_like(key, F.col("regex")))
        best = hits.groupBy("key").agg(F.max(F.struct("rank", "size", "rule", "verdict", "regex")).alias("best"))
        at = at.join(best, "key", "left")
        if always is not None:
            own = _best(always, key)
            at = at.withColumn("best", F.when(F.col("best").isNull(), own).otherwise(F.greatest(F.col("best"), F.coalesce(own, F.col("best")))))
    return at.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"), F.col("best.rank").alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules by the contract; where none fits, ``own_rule`` is the method's rule and its verdict holds, else allow."""
    judged = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), BASE_RULES + OWN_RULES)
    base = F.col("rank") == 1
    return judged.select("page_id", "host", "path", F.when(base, F.col("rule")).alias("rule"), F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.when(~base, F.col("rule")).alias("own_rule"))


def _sql_fits(r: UrlRule) -> str:
    host, slash, path = r.pattern.partition("/")
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}'))"


ORACLE_SQL = f"""
WITH cut AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_sql_fits(r)} THEN '{r.pattern}'" for r in sorted(BASE_RULES, key=lambda r: -len(r.pattern)))} END AS rule,
         CASE WHEN regexp_matches(path, '(?s)^/.*/tracking/pixel\\.') THEN '*/*/tracking/pixel.'
              WHEN regexp_matches(host, '(^|\\.)cheap-pills\\.') AND starts_with(path, '/') THEN 'cheap-pills.*/'
              WHEN regexp_matches(host, '(^|\\.)free-bets\\.') AND starts_with(path, '/') THEN 'free-bets.*/'
              WHEN starts_with(path, '/robots.txt') THEN '*/robots.txt'
              WHEN regexp_matches(path, '(?s)^/.*/login/') THEN '*/*/login/'
              WHEN regexp_matches(host, '(?s)(^|\\.)casino-') AND starts_with(path, '/') THEN 'casino-*/'
              WHEN regexp_matches(path, '(?s)^/.*/cart/') THEN '*/*/cart/' END AS own
  FROM cut)
SELECT page_id, host, path, rule,
       CASE rule {" ".join(f"WHEN '{r.pattern}' THEN '{r.verdict}'" for r in BASE_RULES)}
            ELSE CASE WHEN own IS NULL THEN 'allow' ELSE 'block' END END AS verdict,
       CASE WHEN rule IS NULL THEN own END AS own_rule
FROM ruled
"""
