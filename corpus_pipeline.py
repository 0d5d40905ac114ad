"""Corpus pipeline: five operators of cuemill.llm, each working on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's
result as Parquet to the shared folder and reads it again as the next one's documents.  All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import decontamination, jaccard_join, packing, quality_classifier, substring_dedup
from cuemill.llm.common import id_hash, prepare, written
from cuemill.llm.vocabularies import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents below this probability of good quality go.
LEAST_SCORE = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.  Ids tell rows apart; rows with a null id are judged by their text too."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_hash() % 5 != 0)
    weights, bias = quality_classifier.train(docs, labels)
    return quality_classifier.keep(docs, weights, bias, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one of the smallest id stays; rows with a null id stay.

    Documents without a word have no shingles and stay.  Of rows that repeat an id, all stay or none.
    """
    prepare(spark)
    groups = jaccard_join.jaccard_components(docs, width=5, percent=80).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti")


def repeated_units(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and paragraphs that came before are cut, however short or wrapped, and passages of 20 words within them.

    Documents of which no word is left go; those with a null, an empty or a blank text stay as they are.  A null id ranks
    before all others, and rows of the same id and text are one document.  No rows give no rows.
    """
    prepare(spark)
    done = substring_dedup.substring_dedup(docs, line_words=1)
    left = done.where((F.size("removed_units") == 0) | (F.length("text") > 0)).drop("removed_units")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go; rows with a null id stay, and so do those without a text or a word.  No rows, or no items: nothing goes."""
    prepare(spark)
    hits = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row for each piece, with its ids.  A null or empty text is its end alone; null ids stay null; no rows give no rows."""
    prepare(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", classify),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_units),
    ("decontamination", benchmark_leaks),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


#: SQL can't say a trained classifier or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None
