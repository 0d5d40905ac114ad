"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and grouped under their most frequent form.

Of two words the longer one (or either, if they are equally long) contributes two disjoint chunks, its
halves.  One edit touches one of them, so the other stands in the second word: at the same place, or one place further left
if it lies behind a deleted letter.  The second word contributes the grams of just those places.  A join
on chunk and gram finds all pairs; each pair is verified, in the join itself, by its edit distance.

**Frequent chunks.**  A chunk that many words share makes too many pairs.  The edit is then in the other half,
which is cut in two chunks again: a word keeps its chunk and one of the smaller ones.  This goes on for those chunks
alone that still have more than ``MOST_GRAMS`` grams, until what is left open is one letter; then a bucket has at
most one word for each letter there is.  No pair is lost by that, and no bucket is capped.

**Once each.**  Where letters repeat, a deletion can be told in several places.  A pair counts where the first difference of the two
words lies in the part that is left open, so that it is found once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, id_and_text, written

#: Chunks with more grams are cut further.
MOST_GRAMS = 64
#: Fixed values of the contract: letters of a run; least letters and occurrences of a word; how much more frequent a form is.
LETTERS, LEAST_LETTERS, LEAST_COUNT, FORM_RATIO = r"[A-Za-zÀ-ÿ]", 6, 5, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: size: letters of the longer word; open_at, open_to: its part that is left open; rest: the letters around it.
KEY = ["size", "open_at", "open_to", "rest"]


def _opened(rows: DataFrame) -> DataFrame:
    """Rows of one open part as rows of its two halves, with the letters around it. rows: word, n, short (0 or 1 letters less than size), size, open_at, open_to."""
    middle = F.floor((F.col("open_at") + F.col("open_to")) / 2).cast("int")
    halves = F.array(F.struct("open_at", middle.alias("open_to")), F.struct(middle.alias("open_at"), "open_to"))
    cut = rows.select("word", "n", "short", "size", F.explode(halves).alias("h")).select("word", "n", "short", "size", "h.*")
    rest = F.concat(F.left("word", F.col("open_at")), F.lit("|"), F.substring("word", F.col("open_to") + 1 - F.col("short"), F.col("size")))
    return cut.withColumn("rest", rest)


def near_words(words: DataFrame, most_grams: int = MOST_GRAMS) -> DataFrame:
    """word, n, near, near_n of every two words of the table that one inserted, deleted or replaced letter (code point) tells apart, both ways.

    words: word, n; each word once.
    """
    whole = lambda short: words.select("word", "n", F.lit(short).alias("short"), (F.length("word") + short).alias("size"), F.lit(0).alias("open_at"), (F.length("word") + short).alias("open_to"))
    chunks, grams = _opened(whole(0)), _opened(whole(0).union(whole(1)))
    found, used = [], []
    while True:
        chunks, grams = written(chunks, "chunks"), written(grams, "grams")
        used += [chunks, grams]
        many = written(grams.where("open_to - open_at > 1").groupBy(*KEY).agg(F.count("*").alias("grams")).where(f"grams > {most_grams}").select(*KEY), "many")
        used.append(many)
        more = many.limit(1).count() > 0
        few = lambda rows: rows.join(many, KEY, "left_anti") if more else rows
        a, b = few(chunks).alias("a"), grams.alias("b")
        same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY]
        differs = F.left("a.word", F.col("a.open_to")) != F.left("b.word", F.col("a.open_to"))
        near = (F.levenshtein("a.word", "b.word", 1) == 1) & differs
        joined = a.join(b, [*same, near]).select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"), "b.short")
        found.append(written(joined, "near"))
        if not more:
            break
        chunks, grams = _opened(chunks.join(many, KEY, "left_semi")), _opened(grams.join(many, KEY, "left_semi"))
    discard(*used)
    pairs = found[0]
    for other in found[1:]:
        pairs = pairs.union(other)
    back = pairs.where("short = 1").select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.drop("short").union(back)


def group_variants(words: DataFrame, ratio: int = FORM_RATIO, most_grams: int = MOST_GRAMS) -> DataFrame:
    """word, n, form, root, n_near, form_n of every word of a table (word, n; each word once).

    form: the most frequent near word (ties: the smallest by code points), if it is at least ``ratio`` times as frequent, else null;
    root: the last of the word's forms, itself where it has none.

    Words of any length are compared; rows with a null word or count are dropped.  No rows give no rows.  Other columns are ignored.
    """
    words = written(words.where("word IS NOT NULL AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_words(words, most_grams).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    known = written(known, "forms")
    roots = written(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    # each form is ratio times as frequent as its word, so a way to the root has no more steps than that; every round doubles the steps that are done
    most = max(1, known.agg(F.max("n")).first()[0] or 1)
    for _ in range(math.ceil(math.log2(max(1, math.log(most, max(2, ratio)))))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, roots = roots, written(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(before)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the contract's words: runs of letters, A-Z in lower case; of every 199th run (by the crc32 of id and run) a letter is missing.

    A null id counts as empty text, a null text has no words.  Rows that repeat count again.
    """
    rows = id_and_text(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.translate("text", _UPPER, _LOWER).alias("text"))
    # a run that loses a letter doesn't get longer, so short ones are of no use
    runs = rows.select("id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_letters},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word: Column = F.when(F.col("h") % 199 == 0, F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: One letter taken out of each word, at each place: words are near if these meet.
ORACLE_SQL = r"""
WITH RECURSIVE table_of AS (SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384), i::BIGINT) ORDER BY i) AS crc FROM range(256) t(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE len(run) >= 6 GROUP BY ALL),
coded AS (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes FROM counted),
hashed AS (
  SELECT run, k, xor(list_reduce(list_transform(range(0, len(bytes) // 2), lambda i: ('0x' || bytes[2 * i + 1 : 2 * i + 2])::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM coded, table_of),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING len(word) >= 6 AND n >= 5),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
best AS (SELECT word, n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY ALL),
forms AS (SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * words.n THEN near END AS form, CASE WHEN near_n >= 5 * words.n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS last, 0 AS step FROM forms UNION ALL SELECT ways.word, form, step + 1 FROM ways JOIN forms ON forms.word = ways.last WHERE form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(last, step) AS root FROM ways GROUP BY word) USING (word)
"""
