"""Supervised subword embeddings: a linear text classifier over hashed words and character n-grams.

Each word gives itself and its character n-grams as features, hashed into buckets, and each
pair of equal neighbours gives one feature more (all word pairs of that kind share a bucket).  Every bucket
has a learned vector; a text is the mean of its features' vectors, and a softmax over a
linear map gives the two classes.  Training is plain stochastic gradient descent in numpy over a
bounded sample of labelled rows.  Once trained, vectors and map fold into one number a
bucket, so that scoring a text is a mean of numbers, a projection without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text, id_hash, lean_worker, map_texts
from .vocabularies import WordIds, kept

#: Buckets, length of a vector, lengths of n-grams in bytes.
BUCKETS, DIM, NGRAMS = 1 << 16, 8, (3, 4)
#: Words whose features a Python worker remembers.
REMEMBERED = 300_000
#: Bound of the training sample: labelled rows, taken in the order of a hash of their id.
TRAIN_ROWS = 4000
EPOCHS, RATE, SEED = 6, 0.5, 7
#: Features of no weight that every text has besides its own: the score of a few words stays near that of none.
PRIOR = 30


def word_features(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word and of its n-grams, with marks at its ends."""
    marked = b"<" + word + b">"
    return [zlib.crc32(word) % buckets] + [zlib.crc32(marked[i : i + n]) % buckets for n in NGRAMS for i in range(len(marked) - n + 1)]


def _known(buckets: int) -> WordIds:
    return kept(("features", buckets), lambda: WordIds(lambda words: [word_features(w, buckets) for w in words], most=REMEMBERED))


def text_features(known: WordIds, words: list[bytes], buckets: int) -> np.ndarray:
    """All features of a text; the last bucket counts words that equal the word before."""
    places = known.places(words)
    return np.concatenate([known.ids(places), np.full(int((places[1:] == places[:-1]).sum()), buckets, np.int32)])


def features(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, distinct buckets of the text and how often each comes, as packed 32-bit arrays."""

    def make():
        known = _known(buckets)

        def one(words):
            found, counts = np.unique(text_features(known, words, buckets), return_counts=True)
            return found.astype("<i4").tobytes(), counts.astype("<i4").tobytes()

        def work(ids, texts):
            split = [t.split() for t in texts]
            known.learn({w for ws in split for w in ws})
            return [ids, *map(list, zip(*map(one, split)))]

        return work

    return map_texts(docs, "doc_id long, buckets binary, counts binary", make)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Trains on (buckets, counts, label); returns the weight of each bucket and the bias, for the log odds of label 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets + 1, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            found, counts, label = rows[i]
            now = rate * (1 - done / steps)
            done += 1
            share = (counts / (counts.sum() + PRIOR)).astype(np.float32)
            hidden = share @ vectors[found] if len(found) else np.zeros(dim, np.float32)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= now * np.outer(hidden, p)
            bias -= now * p
            if len(found):
                # one step of plain gradient descent for the mean would hardly move long texts: scaled by the number of features
                vectors[found] -= np.outer(share * min(len(found), 256), now * back)
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, **how) -> tuple[np.ndarray, float]:
    """Fits on at most ``rows`` of the labelled documents (label: column ``quality``; null labels and ids don't count).

    Only this sample's features come to the driver, one row for each id (of rows that repeat an id, the smallest text), so that
    ``rows`` bounds them.  Without any labelled document the weights are those of chance, and all texts score near one half.
    """
    sample = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = id_and_text(docs).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    wanted = {r["doc_id"]: int(r["quality"] > 0) for r in sample.collect()}
    got = sorted(map(tuple, features(chosen, how.get("buckets", BUCKETS)).collect()), key=lambda r: (r[0], bytes(r[1])))
    return fit([(np.frombuffer(b, "<i4"), np.frombuffer(c, "<i4"), wanted[i]) for i, b, c in got], **how)


def _probability(known: WordIds, words: list[bytes], weights: np.ndarray, bias: float) -> float:
    ids = text_features(known, words, len(weights) - 1)
    return float(1 / (1 + np.exp(-np.clip(weights[ids].sum() / (len(ids) + PRIOR) + bias, -60, 60))))


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, probability of label 1): one row for each row of ``docs``, no shuffle.

    Null and empty texts get the score of the bias alone.  Null ids stay null; repeated rows stay
    repeated; an empty table gives an empty table; other columns are ignored.
    """
    weights = np.asarray(weights, np.float64)

    def make():
        known = _known(len(weights) - 1)

        def work(ids, texts):
            split = [t.split() for t in texts]
            known.learn({w for ws in split for w in ws})
            return [ids, [_probability(known, ws, weights, bias) for ws in split]]

        return work

    return map_texts(id_and_text(docs, id_col, text_col), "doc_id long, score double", make)


def keep(docs: DataFrame, weights: np.ndarray, bias: float, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores at least ``least``; a null text scores as empty."""
    weights = np.asarray(weights, np.float64)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            known = _known(len(weights) - 1)
            split = [(t or b"").split() for t in batch.column(at).cast(pa.binary()).to_pylist()]
            known.learn({w for ws in split for w in ws})
            yield batch.filter(pa.array([_probability(known, ws, weights, bias) >= least for ws in split], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_hash() % 5 != 0)
    weights, bias = train(docs, labels)
    scored = score(docs, weights, bias)
    return scored.select("doc_id", (id_hash() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
