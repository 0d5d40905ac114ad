"""Benchmark decontamination by latent semantic retrieval.

The benchmark's items are the queries, in blocks of bounded size, against all documents.  Documents are read once for the
frequencies, and once for every ``BLOCKS`` blocks of items (6,400) that are searched:

1. Document frequencies of all items' words over all documents.
2. A randomised SVD of TF-IDF passages: ``(A'A)^2`` is applied to random vectors, each
   product summed by Spark over the passages of a bounded sample of documents and the items themselves.
3. Every document falls into overlapping windows of a few sizes.  Windows and items are compared
   by their cosine in the latent space; a document's windows are candidates from ``min_cosine`` on.
4. Windows below it are candidates too wherever their words leave step 5 a chance: around each
   place of an item's answer, and where enough of the item's rarest words stand together.
5. A candidate is a hit if the longest common subsequence of its words and the item's is nearly the whole
   item, or half of it with the item's answer (its last words) standing in the window.  Candidates are tried
   in descending cosine; the first hit counts.  So no window that step 5 accepts is missed.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, id_and_text, map_texts, written
from .license_scans import text_words

#: Items of a block, which have a latent space of their own, and blocks that one pass over the documents searches: together they bound the
#: vectors that a task gets, some 3 MB a block.
ITEMS, BLOCKS = 400, 16
#: Length of a latent vector.
DIM = 128
#: Bound of the sample of documents whose passages the SVD is fitted on; all documents are searched.
FIT_DOCS = 1500
#: Words in more than this share of documents are no terms, but for an item's rarest ones.
COMMON, RAREST = 0.1, 8
#: Windows from here on are candidates by their cosine alone; those below it need the item's words.
MIN_COSINE = 0.7
#: Shares of an item's words that the subsequence must have, without and with the answer, and words of the answer.
LCS_ALONE, LCS_WITH_ANSWER, ANSWER_WORDS = 0.8, 0.5, 4
#: Windows of these sizes, in words, with half their size as step; doubled until the longest item fits.
WINDOW_SIZES = (24, 56)
_SLICE_WORDS = 60_000


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if hit := row & where.get(y, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def has_answer(item: list, window: list) -> bool:
    answer = item[-ANSWER_WORDS:]
    return any(window[i : i + len(answer)] == answer for i in range(len(window) - len(answer) + 1))


class Terms:
    """Terms of a block of items, with their weights."""

    def __init__(self, items: list[list[bytes]], df: dict[bytes, int], n_docs: int):
        rare = {w for x in items for w in sorted(set(x), key=lambda w: (df.get(w, 0), w))[:RAREST]}
        words = sorted(w for w in {w for x in items for w in x} if w in rare or df.get(w, 0) <= COMMON * n_docs)
        self.at = {w: i for i, w in enumerate(words)}
        self.idf = np.log((n_docs + 1) / (np.array([df.get(w, 0) for w in words]) + 1) + 1e-9).clip(0.01).astype(np.float32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.at.get, words, repeat(-1)), np.int32, len(words))


def document_frequencies(docs: DataFrame, words: set[bytes]) -> tuple[dict[bytes, int], int]:
    """Documents that have each of the given words, and documents in all; every task sums up what it has read."""

    def run(batches):
        counts: dict[bytes, int] = {}
        n = 0
        for batch in batches:
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                n += 1
                for w in words.intersection(text_words(text)):
                    counts[w] = counts.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *counts], pa.binary()), pa.array([n, *counts.values()], pa.int64())], names=["word", "n"])

    total = docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = {bytes(r["word"]): r["n"] for r in total}
    return out, out.pop(b"", 0)


def fit_latent(sample: DataFrame, items: list[list[bytes]], terms: Terms, dim: int = DIM, rounds: int = 2, seed: int = 3) -> np.ndarray:
    """Weighted latent vectors of the terms (terms x dim). sample: a table of (doc_id, text) of bounded size."""
    own = [ids[ids >= 0] for x in items if len(ids := terms.ids(x))]
    size = WINDOW_SIZES[0]

    def gram(rows: list[np.ndarray], basis: np.ndarray) -> np.ndarray:
        out = np.zeros_like(basis)
        for ids in rows:
            w = terms.idf[ids, None]
            np.add.at(out, ids, w * (w * basis[ids]).sum(0))
        return out

    def product(basis: np.ndarray) -> np.ndarray:
        def run(batches):
            total = np.zeros_like(basis)
            for batch in batches:
                for text in batch.column(1).cast(pa.binary()).to_pylist():
                    ids = terms.ids(text_words(text))
                    total += gram([x for i in range(0, len(ids), size) if len(x := (y := ids[i : i + size])[y >= 0])], basis)
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["sum"])

        parts = sample.mapInArrow(run, "sum binary").collect()
        return sum((np.frombuffer(r["sum"], "<f4").reshape(basis.shape) for r in parts), gram(own, basis))

    dim = min(dim, len(terms.at))
    basis = np.random.default_rng(seed).standard_normal((len(terms.at), dim)).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(product(basis))[0].astype(np.float32)
    return terms.idf[:, None] * basis


def _slices(sizes: list[int]):
    """Ranges of documents with so many words together, or one of more."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > _SLICE_WORDS:
            yield begin, i
            begin, total = i, 0
        total += n
    yield begin, len(sizes)


class Overlaps:
    """Places where an item can be a hit, whatever the cosine; none is left out."""

    def __init__(self, items: list[list[bytes]], df: dict[bytes, int], sizes: list[int]):
        self.items, self.sizes = items, sizes
        self.at = {w: i for i, w in enumerate(sorted({w for x in items for w in x}))}
        n = len(self.at)
        #: By length of the answer: items by their answer, and which words end one.
        self.answers: dict[int, tuple[dict[tuple, list[int]], np.ndarray]] = {}
        #: A window of any item lies in two neighbouring blocks.
        self.block = sizes[-1] + 2 * max(map(len, items))
        self.least = np.empty(len(items))
        picked: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for q, item in enumerate(items):
            answer = tuple(self.at[w] for w in item[-ANSWER_WORDS:])
            owners, last = self.answers.setdefault(len(answer), ({}, np.zeros(n + 1, bool)))
            owners.setdefault(answer, []).append(q)
            last[answer[-1]] = True
            # without the answer at most ``missed`` words are missing, so of the rarest ones all but so many are there
            missed = len(item) - next(k for k in range(len(item) + 1) if k >= LCS_ALONE * len(item))
            times, total = Counter(item), 0
            for w in sorted(times, key=lambda w: (df.get(w, 0), w)):
                if total >= missed + max(1, len(item) // 5):
                    break
                picked[self.at[w]].append((q, times[w]))
                total += times[w]
            self.least[q] = total - missed
        self.n_owners = np.array([*map(len, picked), 0])
        self.first_owner = np.cumsum(self.n_owners) - self.n_owners
        self.owner = np.array([q for x in picked for q, _ in x], np.int64)
        self.times = np.array([k for x in picked for _, k in x], np.float64)

    def places(self, docs_words: list[list[bytes]], base: np.ndarray):
        """(document, query, first word, end): ranges that hold every window of a hit."""
        ids = np.fromiter(map(self.at.get, chain.from_iterable(docs_words), repeat(-1)), np.int64, int(base[-1]))
        for length, (owners, last) in self.answers.items():
            for p in np.flatnonzero(last[ids[length - 1 :]]).tolist():
                for q in owners.get(tuple(ids[p : p + length].tolist()), ()):
                    d = int(np.searchsorted(base, p, "right")) - 1
                    at, reach = p - int(base[d]), self.sizes[-1] + 2 * len(self.items[q])
                    if p + length <= base[d + 1]:
                        yield d, q, max(0, at + length - reach), at + reach
        where = np.flatnonzero(self.n_owners[ids])
        if not len(where):
            return
        blocks = -(-np.diff(base) // self.block)
        begin = np.cumsum(blocks) - blocks
        doc = np.searchsorted(base, where, "right") - 1
        block, k = begin[doc] + (where - base[doc]) // self.block, self.n_owners[ids[where]]
        at = np.repeat(self.first_owner[ids[where]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        n, total = len(self.items), int(blocks.sum())
        found = np.bincount(np.repeat(block, k) * n + self.owner[at], self.times[at], total * n).reshape(total, n)
        of = np.repeat(np.arange(len(blocks)), blocks)
        found[:-1][of[:-1] == of[1:]] += found[1:][of[:-1] == of[1:]]
        for b, q in zip(*(x.tolist() for x in np.nonzero(found >= self.least))):
            d = int(of[b])
            low = (b - int(begin[d])) * self.block
            yield d, q, low, low + 2 * self.block


def accepted(item: list, window: list) -> tuple[int, bool] | None:
    """Length of the common subsequence, and whether the answer stands in the window; None if it is no hit."""
    common = lcs_length(item, window)
    if common < LCS_WITH_ANSWER * len(item):
        return None
    answer = has_answer(item, window)
    return (common, answer) if answer or common >= LCS_ALONE * len(item) else None


def windows_in(n_words: int, size: int, reach: int, low: int, high: int):
    """First words of the document's windows of a size that with ``reach`` words on both sides lie in a range."""
    step = size // 2
    for k in range(max(0, low // step - 1), min(max(0, -(-(n_words - size) // step)), high // step + 1) + 1):
        if max(0, k * step - reach) >= low and min(n_words, k * step + size + reach) <= high:
            yield k * step


def candidates(docs_words: list[list[bytes]], terms: Terms, vectors: np.ndarray, queries: np.ndarray, overlaps: Overlaps, least: int, min_cosine: float):
    """(document, query, windows): windows are (cosine, size, first word), those from ``min_cosine`` on and those of ``overlaps``."""
    n_words = np.array([len(w) for w in docs_words], np.int64)
    base = np.concatenate([[0], np.cumsum(n_words)])
    ids = terms.ids(list(chain.from_iterable(docs_words)))
    at = np.flatnonzero(ids >= 0)
    sums = np.zeros((len(at) + 1, vectors.shape[1]))
    np.cumsum(vectors[ids[at]], axis=0, dtype=np.float64, out=sums[1:])
    found: dict[tuple[int, int], dict[tuple[int, int], float]] = {}
    for size in overlaps.sizes:
        step = size // 2
        counts = np.where(n_words > 0, np.maximum(1, -(-(n_words - size) // step) + 1), 0)
        doc = np.repeat(np.arange(len(n_words)), counts)
        first = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
        begin, end = base[doc] + first, np.minimum(base[doc] + first + size, base[doc + 1])
        i, j = np.searchsorted(at, begin), np.searchsorted(at, end)
        use = j - i >= least
        if not use.any():
            continue
        doc, first = doc[use], first[use]
        v = (sums[j[use]] - sums[i[use]]).astype(np.float32)
        cosine = v @ queries.T
        cosine /= np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
        for k, q in zip(*np.nonzero(cosine >= min_cosine)):
            found.setdefault((int(doc[k]), int(q)), {})[size, int(first[k])] = float(cosine[k, q])
    for d, q, low, high in overlaps.places(docs_words, base):
        n, item, words = int(n_words[d]), overlaps.items[q], docs_words[d]
        high = min(n, high)
        if accepted(item, words[low:high]) is None:
            continue
        windows = found.setdefault((d, q), {})
        for size in overlaps.sizes:
            for first in windows_in(n, size, len(item), low, high):
                if (size, first) not in windows:
                    i, j = np.searchsorted(at, (base[d] + first, min(base[d] + first + size, base[d + 1])))
                    v = (sums[j] - sums[i]).astype(np.float32)
                    windows[size, first] = float(v @ queries[q] / max(np.linalg.norm(v), 1e-9))
    for (d, q), windows in sorted(found.items()):
        yield d, q, sorted(((c, size, first) for (size, first), c in windows.items()), key=lambda x: (-x[0], x[1:]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_cosine: float = MIN_COSINE) -> DataFrame:
    """doc_id, item_id, cosine, lcs, item_words, start (word at which the window begins), answer: one row for each hit.

    Items of null or empty text, and null ids of items, have no hits; null and empty documents have none.  Rows with a null
    doc_id are searched and their hits have a null doc_id; repeated rows give repeated hits.  Equal
    cosines: the first window.  Empty tables give an empty table; other columns are ignored.
    """
    docs = id_and_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, cosine double, lcs long, item_words long, start long, answer boolean"
    numbered = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).distinct()
    rows = sorted((r["item"], words) for r in numbered.where("text IS NOT NULL").collect() if (words := text_words(r["text"].encode())))
    if not rows:  # an empty table without Python data, which would start workers of another kind
        return docs.sparkSession.range(0).select(*[F.lit(None).cast(x.split(" ")[1]).alias(x.split(" ")[0]) for x in schema.split(", ")])
    n_blocks = -(-len(rows) // ITEMS)
    blocks = [rows[i::n_blocks] for i in range(n_blocks)]
    chosen = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    sample = written(docs.join(F.broadcast(chosen), "doc_id", "left_semi").coalesce(8), "fit")
    df, n_docs = document_frequencies(docs, {w for _, words in rows for w in words})
    found = [_search(docs, [Block(sample, x, df, n_docs) for x in blocks[i : i + BLOCKS]], schema, min_cosine) for i in range(0, n_blocks, BLOCKS)]
    discard(sample)
    return reduce(DataFrame.unionByName, found)


class Block:
    """What a task needs to search a block of items."""

    def __init__(self, sample: DataFrame, rows: list[tuple[int, list[bytes]]], df: dict[bytes, int], n_docs: int):
        self.item_ids, self.items = [r[0] for r in rows], [r[1] for r in rows]
        words = {w for x in self.items for w in x}
        df = {w: df[w] for w in words if w in df}
        self.terms = Terms(self.items, df, n_docs)
        self.vectors = fit_latent(sample, self.items, self.terms)
        self.queries = np.stack([self.vectors[(y := self.terms.ids(x))[y >= 0]].sum(0) for x in self.items])
        self.queries /= np.maximum(np.linalg.norm(self.queries, axis=1, keepdims=True), 1e-9)
        self.least = max(1, min(4, min(int((self.terms.ids(x) >= 0).sum()) for x in self.items)))
        sizes = list(WINDOW_SIZES)
        while sizes[-1] < max(map(len, self.items)):
            sizes.append(2 * sizes[-1])
        self.overlaps = Overlaps(self.items, df, sizes)

    def hits(self, ids: list, docs_words: list[list[bytes]], min_cosine: float):
        for d, q, windows in candidates(docs_words, self.terms, self.vectors, self.queries, self.overlaps, self.least, min_cosine):
            item, words = self.items[q], docs_words[d]
            for cosine, size, first in windows:
                low = max(0, first - len(item))
                if hit := accepted(item, words[low : first + size + len(item)]):
                    yield ids[d], self.item_ids[q], cosine, hit[0], len(item), low, hit[1]
                    break


def _search(docs: DataFrame, blocks: list[Block], schema: str, min_cosine: float) -> DataFrame:
    def make():
        def work(ids, texts):
            split = [text_words(t) for t in texts]
            slices = list(_slices([len(w) for w in split]))
            hits = [x for begin, end in slices for block in blocks for x in block.hits(ids[begin:end], split[begin:end], min_cosine)]
            return list(zip(*hits)) if hits else [[]] * 7

        return work

    return map_texts(docs, schema, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
