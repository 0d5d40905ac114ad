"""Secret scans of histories: an incremental ledger of blobs.

Every version of every path is addressed by the digest of its content, its blob.  The ledger
is a Parquet folder that says, of each blob, by which rules (a kind and a version) it was scanned and what
they found.  A run

1. addresses all versions and takes the distinct blobs;
2. asks the ledger which pairs of a blob and a rule version it has not seen;
3. scans one copy of each such blob, by those rules alone;
4. appends a row for each blob that was scanned, clean ones included;
5. joins what the ledger knows back to every path and version of the blob.

A second run over the same history scans nothing; a new version of one rule scans the blobs for that rule only.

Everything is DataFrame expressions.  A match has no position in SQL, so a text is cut at its matches: the
lengths of what stands between and of the matches themselves, summed up in order, are the positions.
The sums are windows over rows of two numbers, in linear time for any number of matches.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, shared_folder, written


class SecretRule(NamedTuple):
    kind: str
    #: Regular expression; matches are leftmost and don't overlap. ``~word~`` stands for its letters in either case.
    pattern: str
    #: Matches whose ``group`` (0: the whole match) is shorter are dropped.
    least: int = 1
    group: int = 0
    #: A rule that changes gets another number, so that blobs are scanned by it anew.
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"

    @property
    def regex(self) -> str:
        plain, *rest = self.pattern.split("~")
        return plain + "".join(x if at % 2 else "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in x) for at, x in enumerate(rest))


#: Fixed rules of the contract, in its order.
BASE_RULES = (
    SecretRule("assign", r"""(~password~|~passwd~|~secret~|~token~|~api_?key~)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    SecretRule("access", r"AKIA[A-Z0-9]+", 18),
    SecretRule("hex", r"[0-9a-f]{16,}", 16),  # the runs of [0-9a-f]+ that are long enough
)
#: The method's own rules: public formats of keys.
OWN_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("private-key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("url-login", r"://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{1,64}@"),
)
RULES = BASE_RULES + OWN_RULES
LEDGER = "blob binary, rules array<string>, findings array<struct<rule:string,start:int,end:int>>"


def _matches(text: Column, rule: SecretRule) -> Column:
    """Of each match in order: characters before it (since the last one), its own, and those of its group. Null where nothing matches."""
    sizes = lambda found: F.transform(found, F.length)
    regex, whole = F.lit(rule.regex), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    value = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else whole
    cut = F.arrays_zip(sizes(F.split(text, rule.regex, -1)).alias("gap"), sizes(whole).alias("size"), sizes(value).alias("value"))
    return F.when(F.regexp_like(text, regex), cut)


def scan_blobs(blobs: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """blob and its findings (rule, start, end in code points, sorted) of those blobs that have any.

    blobs: blob, text, missing (ids of the rules to scan by).  Repeated rows count once.
    """
    tried = F.array(*[F.struct(F.lit(r.id).alias("rule"), F.lit(r.least).alias("least"), F.when(F.array_contains("missing", r.id), _matches(F.col("text"), r)).alias("cut")) for r in rules])
    rows = blobs.select("blob", F.explode(tried).alias("r")).where("r.cut IS NOT NULL")
    rows = rows.select("blob", "r.rule", "r.least", F.posexplode("r.cut").alias("pos", "m")).where("m.size IS NOT NULL")
    once = rows.groupBy("blob", "rule", "pos").agg(*[F.min(x).alias(x.rpartition(".")[2]) for x in ("least", "m.gap", "m.size", "m.value")])
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "rule").orderBy("pos")).cast("int")
    found = once.withColumn("end", end).where("value >= least")
    finding = F.struct("rule", (F.col("end") - F.col("size")).alias("start"), "end")
    return found.groupBy("blob").agg(F.sort_array(F.collect_list(finding)).alias("findings"))


def _known(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's rows, or None where there are none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger)


def scan_history(versions: DataFrame, paths: tuple[str, ...], rules: tuple[SecretRule, ...] = RULES, ledger: str | None = None, text_col: str = "text") -> DataFrame:
    """The columns of ``paths``, blob, findings (rule, start, end; sorted, empty where clean) of every row of ``versions``.

    ledger: folder of the ledger, made if it isn't there, for runs to come; None: one of this run alone.  A run appends a folder of its own,
    which other runs see once it is whole; runs at the same time may scan a blob twice, which changes no result.

    Nulls: a null text is empty, and paths may be null.  Empty texts have a blob like any other, and no findings.  Very long texts
    are scanned whole.  Rows and contents that repeat are scanned once, or once for each equal row; every row gets its findings.
    No rows give no rows.  Other columns are ignored, whatever their names.
    """
    spark = versions.sparkSession
    ledger = ledger or f"{shared_folder(spark)}/cuemill/ledger-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    at = versions.select(F.struct(*paths).alias("path"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"), F.xxhash64(*paths).alias("row"))
    log = written(at.select("path", "blob", "row"), "versions")

    ids = F.array(*[F.lit(r.id) for r in rules])
    blobs, known = log.groupBy("blob").agg(F.min("row").alias("row")), _known(spark, ledger)
    if known is None:
        todo = blobs.withColumn("missing", ids)
    else:
        seen = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        missing = F.array_except(ids, F.coalesce("seen", F.array().cast("array<string>")))
        todo = blobs.join(seen, "blob", "left").select("blob", "row", missing.alias("missing")).where(F.size("missing") > 0)
    todo = written(todo, "todo")
    # the copy to scan is found by a number of the row; contents that a third of the paths share come once. The small side is hashed, so that texts aren't sorted
    copies = at.select("blob", "row", "text").join(todo.hint("shuffle_hash"), ["blob", "row"])
    found = todo.join(scan_blobs(copies, rules), "blob", "left")
    found.select("blob", F.col("missing").alias("rules"), F.coalesce("findings", F.array().cast("array<struct<rule:string,start:int,end:int>>")).alias("findings")).write.parquet(f"{ledger}/run={uuid.uuid4().hex}")
    discard(todo)

    hits = _known(spark, ledger).where(F.size("findings") > 0).select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin([r.id for r in rules]))
    own = hits.groupBy("blob").agg(F.sort_array(F.collect_set("f")).alias("findings"))
    out = log.join(own, "blob", "left").select("path.*", "blob", F.coalesce("findings", F.array().cast("array<struct<rule:string,start:int,end:int>>")).alias("findings"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by the contract: base ones counted and digested, all of them as text, by start and then by the order of the rules."""
    found = scan_history(spark.read.parquet(f"{sf_dir}/documents.parquet"), ("doc_id",))
    order = F.create_map(*[x for n, r in enumerate(RULES) for x in (F.lit(r.id), F.lit(n))])
    spans = F.array_sort(F.transform("findings", lambda f: F.struct(f["start"].alias("start"), order[f["rule"]].alias("order"), f["end"].alias("end"))))
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    shown = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(kinds, x["order"]), x["start"], x["end"])), ",")
    count = lambda n: F.size(F.filter("s", lambda x: x["order"] == n)).cast("long")
    base = F.filter("s", lambda x: x["order"] < len(BASE_RULES))
    return found.select("doc_id", spans.alias("s")).select("doc_id", *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE_RULES)], F.sha2(shown(base), 256).alias("base_sha256"), shown("s").alias("spans"))


def _sql_spans(order: int, r: SecretRule) -> str:
    regex = r.regex.replace("'", "''")
    return f"""SELECT doc_id, row, {order} AS "order", '{r.kind}' AS kind, ends[i] - sizes[i] AS start, ends[i] AS "end"
      FROM (SELECT doc_id, row, sizes, vals, [list_sum(gaps[:j]) + list_sum(sizes[:j]) FOR j IN range(1, len(sizes) + 1)] AS ends
            FROM (SELECT doc_id, row, [len(x) FOR x IN string_split_regex(text, '{regex}')] AS gaps, [len(x) FOR x IN regexp_extract_all(text, '{regex}')] AS sizes,
                         [len(x) FOR x IN regexp_extract_all(text, '{regex}', {r.group})] AS vals FROM docs WHERE regexp_matches(text, '{regex}'))), LATERAL (SELECT unnest(range(1, len(sizes) + 1)) AS i)
      WHERE vals[i] >= {r.least}"""


ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
found AS ({" UNION ALL ".join(_sql_spans(n, r) for n, r in enumerate(RULES))}),
shown AS (SELECT row, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
         coalesce(string_agg(concat(kind, ':', start, ':', "end"), ',' ORDER BY start, "order") FILTER ("order" < {len(BASE_RULES)}), '') AS base,
         string_agg(concat(kind, ':', start, ':', "end"), ',' ORDER BY start, "order") AS spans
  FROM found GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN shown USING (row)
"""
