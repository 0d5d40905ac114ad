"""Language-model scoring: a causal self-attention model in numpy on the ids of a public vocabulary.

What is learned comes from the training documents, all of them and whole:

1. Counts of words, summed in each task and then over all tasks; counts of subword ids follow
   from them, each distinct word encoded once.
2. Frequent ids become tokens of their own; each rarer one is a member of a rest token, with its share
   by count.
3. The attention model is started on windows of a bounded sample, one a document.  Then, in a few
   rounds, shards of documents go on with it on consecutive windows, and the weights are averaged, by
   windows.  A document is in one round, with all its tokens; shards go by hash, so that neither weights nor scores
   depend on how the table is cut into partitions.
4. The vocabulary folds away how words are spelled (letters beyond A-Z in either case) and where white space stands.
   Both get probabilities of their own: of each id, that it is attached to the one before, and of each word, its
   share among the words of the same ids.  With them the score is that of the text's words, as the base's is.

5. A word's probability is mixed from the attention's and from its count's.  The count's share hangs on how many words came before; it is chosen
   on all documents of the last round, scored before the model trains on them, each without its own count.  A word
   without a count has the model's probability in the part that counts leave to such words, so that all words together have at most 1.

Scoring is one pass: texts fall into overlapping context windows, each token is scored once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import attention
from .common import discard, documents, id_and_text, id_hash, written
from .vocabularies import end_marks, kept, load_tokenizer, lowered, vocabulary, word_ids

#: Documents of which a window each starts the model; all, and whole, go into what follows.
START_DOCS, START_EPOCHS, START_RATE, GO_ON_RATE = 6000, 6, 0.01, 0.012
#: Rounds of training between which weights are averaged; the documents are dealt over them, and in a round over shards: one for so many documents, at most so many.
ROUNDS, SHARD_DOCS, MOST_SHARDS = 3, 4096, 1 << 13
#: Windows of a training step.
STEP_WINDOWS = 256
#: Tokens of a training window, and windows that a task holds at a time.
WINDOW, HELD_WINDOWS = 48, 4096
#: Words whose counts all tasks hold, the most frequent ones, at most so many; counts of the others are joined.
HEAD_WORDS = 1 << 18
_TOKENS, _SLOTS = attention.CLASSES * attention.SLOTS, attention.SLOTS
_END = _SLOTS - 1
#: Kinds of tokens that the model tells apart as inputs: all tokens of their own, the rest, and the beginning.
KINDS = attention.CLASSES * (_SLOTS - 1) + 2
#: Shares of the counts' probability that are tried, and numbers of words before, from which on a share of its own is chosen.
SHARES, GATES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99), (0, 1, 4, 16, 64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Blocks that go through the model at a time, and words of texts (or one text) that are laid out for it.
_BLOCKS, _WORDS = 1024, 60_000


class Tokens:
    """From ids of the vocabulary to tokens of the model."""

    def __init__(self, id_counts: np.ndarray):
        rank = np.empty(len(id_counts), np.int64)
        rank[np.argsort(-id_counts, kind="stable")] = np.arange(len(id_counts))
        classes = attention.CLASSES
        own = classes * (_SLOTS - 1)  # the last slot of a class is a rest token; that of class 0 ends a text
        rest = (1 + rank % (classes - 1)) * _SLOTS + _SLOTS - 1
        self.token = np.where(rank < own, rank % classes * _SLOTS + rank // classes, rest).astype(np.int32)
        smooth = id_counts + 0.1
        self.counts = np.bincount(self.token, smooth, _TOKENS)
        self.inside = np.log(smooth / self.counts[self.token]).astype(np.float32)
        order = np.arange(own)
        self.kinds = np.full(_TOKENS, KINDS - 2, np.int32)
        self.kinds[order % classes * _SLOTS + order // classes] = np.minimum(order, KINDS - 2)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), n: over all texts; the word of no bytes counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                counts.update(text.translate(_LOWER).split())
                counts[b""] += 1
            if len(counts) > 1 << 20:
                yield rows(counts)
                counts.clear()
        if counts:
            yield rows(counts)

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _begins(sizes: np.ndarray) -> np.ndarray:
    """Of ids of words one after the other, which begin a word."""
    out = np.zeros(int(sizes.sum()), bool)
    out[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return out


def closing_ids(tokenizer_path: str) -> np.ndarray:
    """Ids after which a word may end: those with the vocabulary's mark for it, or all if it has none."""

    def make() -> np.ndarray:
        out = end_marks(load_tokenizer(tokenizer_path))
        return out if out.any() else ~out

    return kept(("closing ids", tokenizer_path), make, small=True)


def _attachable(ids: np.ndarray, begins: np.ndarray, closing: np.ndarray) -> np.ndarray:
    """Ids inside a word that could as well begin one: the id before closes."""
    return ~begins & np.append(False, closing[ids[:-1]])[: len(ids)]


def encoded_words(counts: DataFrame, tokenizer_path: str) -> DataFrame:
    """word, n, ids (bytes, 32 bits each) and a key of them: each distinct word is encoded here, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer_path)
        for batch in batches:
            places = known.learned(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(_ids_bytes(known, places), pa.binary()), pa.array(_ids_key(known, places), pa.int64())], names=["word", "n", "ids", "key"])

    return counts.select("word", "n").mapInArrow(run, "word binary, n long, ids binary, key long")


def _ids_bytes(known, places: np.ndarray) -> list[bytes]:
    ends = 4 * np.cumsum(known.size[places])
    flat = known.ids(places).astype("<i4").tobytes()
    return [flat[a:e] for a, e in zip(chain((0,), ends.tolist()), ends.tolist())]


def _ids_key(known, places: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in _ids_bytes(known, places)]


def id_counts(words: DataFrame, tokenizer_path: str, size: int) -> np.ndarray:
    """Counts of each id, from the words and their counts, in three rows: all; beginning a word; attached to an id after which a word may end. Tasks send sums."""
    encoded = words if "ids" in words.columns else encoded_words(words, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, closing = np.zeros((3, size), np.int64), closing_ids(tokenizer_path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            flat, sizes = np.frombuffer(b"".join(ids), "<i4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            times, begins = np.repeat(batch.column("n").to_numpy(), sizes), _begins(sizes)
            for row, use in enumerate((slice(None), begins, _attachable(flat, begins, closing))):
                total[row] += np.bincount(flat[use], times[use], size).astype(np.int64)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in total)], names=["id", "n", "begins", "attached"])

    out = np.zeros((3, size))
    sums = [F.sum(c).alias(c) for c in ("n", "begins", "attached")]
    for r in encoded.where("word <> X''").select("n", "ids").mapInArrow(run, "id long, n long, begins long, attached long").groupBy("id").agg(*sums).collect():
        out[:, r["id"]] = r["n"], r["begins"], r["attached"]
    return out


def spelled_words(encoded: DataFrame) -> DataFrame:
    """word, n, spelled (natural log of its share among the words of the same ids); key of ids, their words' total and number, and whether the word is the first of them."""
    same = Window.partitionBy("key")
    among = encoded.select("word", "n", "key", F.sum("n").over(same).alias("total"), F.count(F.lit(1)).over(same).alias("forms"), (F.min("word").over(same) == F.col("word")).alias("first"))
    return among.withColumn("spelled", _share(F.col("n")))


def _share(n: Column) -> Column:
    return F.log((n + 0.1) / (F.coalesce("total", F.lit(0)) + 0.1 * (F.coalesce("forms", F.lit(0)) + 1)))


def frequent_words(counts: DataFrame, most: int = HEAD_WORDS) -> dict[bytes, tuple[int, float]]:
    """Counts and spelling of the most frequent words, at most ``most``, and of the end: a histogram of counts gives the bound that they are filtered by."""
    step = F.floor(F.log2("n") * 16)
    steps = sorted(((r["step"], r["k"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total, least = 0, None
    for at, k in steps:
        total += k
        if total >= most:
            break
        least = at
    chosen = counts.where((F.col("word") == F.lit(b"")) | ((step >= least) if least is not None else F.lit(False)))
    found = chosen.select("word", "n", "spelled").toArrow()
    return dict(zip(found.column(0).cast(pa.binary()).to_pylist(), zip(found.column(1).to_pylist(), found.column(2).to_pylist())))


def training_windows(docs: DataFrame, tokenizer_path: str, tokens: Tokens):
    """A function from Arrow batches of (doc_id, text) to windows of tokens, one a document, at a place by its id's hash."""

    def windows(batch: pa.RecordBatch) -> list[np.ndarray]:
        words, cut = word_ids(tokenizer_path), []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            at = zlib.crc32(b"window %d" % (doc or 0)) % max(1, len(text) - 4 * WINDOW)
            piece = lowered(text[at : at + 8 * WINDOW]).split()
            cut.append((piece if at == 0 else piece[1:], at + 8 * WINDOW >= len(text)))
        words.learn({w for piece, _ in cut for w in piece})
        out = []
        for piece, ends in cut:
            ids = tokens.token[words.ids(words.places(piece[:WINDOW] if not ends else piece))]
            out.append(np.append(ids, _END)[-WINDOW:].astype(np.int32) if ends else ids[:WINDOW])
        return [x for x in out if len(x) > 1]

    return windows


def whole_windows(docs: Iterator[pa.RecordBatch], tokenizer_path: str, tokens: Tokens) -> Iterator[list[np.ndarray]]:
    """Consecutive windows that cover each text and its end, ``HELD_WINDOWS`` at a time or, at the end, fewer."""
    words, held = word_ids(tokenizer_path), []
    for batch in docs:
        for pieces in _together([lowered(text).split() for text in batch.column(1).cast(pa.binary()).to_pylist()]):
            places = words.learned(list(chain.from_iterable(piece for piece, _ in pieces)))
            sequence = tokens.token[words.ids(places)]
            ids = np.append(0, np.cumsum(words.size[places]))[np.cumsum([len(piece) for piece, _ in pieces])]
            for (_, ends), begin, end in zip(pieces, [0, *ids.tolist()], ids.tolist()):
                own = np.append(sequence[begin:end], np.int32(_END)) if ends else sequence[begin:end]
                for i in range(0, len(own), WINDOW):
                    held.append(own[i : i + WINDOW])
                    if len(held) == HELD_WINDOWS:
                        yield held
                        held = []
    if held:
        yield held


def _together(texts: list[list[bytes]]) -> Iterator[list[tuple[list[bytes], bool]]]:
    """Words of texts, and whether a text ends with them: some texts at a time, or a piece of a long one."""
    out, n = [], 0
    for text in texts:
        for at in range(0, max(1, len(text)), WINDOW * HELD_WINDOWS):  # a word has a token at least
            piece = text[at : at + WINDOW * HELD_WINDOWS]
            if out and n + len(piece) > _WORDS:
                yield out
                out, n = [], 0
            out.append((piece, at + len(piece) == len(text)))
            n += len(piece)
    if out:
        yield out


def _dealt(docs: DataFrame, n_docs: int) -> tuple[DataFrame, int]:
    """docs with at and shard (shard % ROUNDS: the round), and the number of shards of a round."""
    shards = min(MOST_SHARDS, max(1, -(-n_docs // SHARD_DOCS)))
    return docs.withColumn("at", F.xxhash64("doc_id", "text")).withColumn("shard", F.pmod("at", F.lit(shards * ROUNDS))), shards


def _round(dealt: DataFrame, shards: int, k: int) -> DataFrame:
    """The rows of a round, each shard a task of its own: no two meet in one, as hashes of their numbers might."""
    return dealt.where(F.col("shard") % ROUNDS == k).repartitionById(shards, F.floor(F.col("shard") / ROUNDS).cast("int")).sortWithinPartitions("shard", "at", "doc_id")


def last_round(docs: DataFrame, n_docs: int) -> DataFrame:
    """The documents of the last round of training."""
    return _dealt(docs, n_docs)[0].where(F.col("shard") % ROUNDS == ROUNDS - 1).select("doc_id", "text")


def fit(docs: DataFrame, tokenizer_path: str, tokens: Tokens, n_docs: int) -> dict[str, np.ndarray]:
    """Weights learned from all of ``docs`` (doc_id, text; ``n_docs`` rows)."""
    *_, weights = fit_rounds(docs, tokenizer_path, tokens, n_docs)
    return weights


def fit_rounds(docs: DataFrame, tokenizer_path: str, tokens: Tokens, n_docs: int) -> Iterator[dict[str, np.ndarray]]:
    """Weights before the first round of training and after each."""
    windows = training_windows(docs, tokenizer_path, tokens)
    first = attention.init(KINDS)
    occurring = tokens.counts + 0.1
    occurring[_END] += n_docs
    first |= attention.biases(occurring)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes() for x in windows(batch)], pa.binary())], names=["window"])

    chosen = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(START_DOCS)
    sample = docs.join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(collect, "window binary").collect()
    started = attention.train(first, [np.frombuffer(x, "<i4") for x in sorted(bytes(r["window"]) for r in sample)], tokens.kinds, KINDS - 1, START_RATE, epochs=START_EPOCHS)
    yield started
    dealt, shards = _dealt(docs, n_docs)

    def round_of(weights: dict[str, np.ndarray]):
        def texts_of(batches: Iterator[pa.RecordBatch]):
            """Rows come sorted by shard: (shard, its batches) one shard after the other, a batch at a time."""
            pieces = (batch.slice(a, b - a) for batch in batches if batch.num_rows for a, b in _stretches(batch.column("shard").to_numpy()))
            return groupby(pieces, lambda piece: piece.column("shard")[0].as_py())

        def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, own_batches in texts_of(batches):
                own, n = weights, 0
                for found in whole_windows(own_batches, tokenizer_path, tokens):
                    own, n = attention.train(own, found, tokens.kinds, KINDS - 1, GO_ON_RATE, batch=STEP_WINDOWS), n + len(found)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([attention.flat(own).tobytes()], pa.binary())], names=["shard", "n", "weights"])

        return go_on

    def average(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        n, total = 0, 0.0
        for k, w in zip(table.column("n").to_pylist(), table.column("weights").to_pylist()):
            n, total = n + k, total + k * np.frombuffer(w, np.float32).astype(np.float64)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "weights": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})

    for k in range(ROUNDS):
        tasks = _round(dealt, shards, k).select("doc_id", "text", "shard").mapInArrow(round_of(started), "shard long, n long, weights binary")
        grouped = tasks.withColumn("part", F.pmod(F.floor(F.col("shard") / ROUNDS), F.lit(-(-shards // 64)))).groupBy("part")
        parts = sorted(grouped.applyInArrow(average, "part long, n long, weights binary").collect(), key=lambda r: r["part"])
        if total := sum(r["n"] for r in parts):
            started = attention.unflat(sum(r["n"] / total * np.frombuffer(r["weights"], np.float32).astype(np.float64) for r in parts), started)
        yield started


def _stretches(values: np.ndarray) -> list[tuple[int, int]]:
    bounds = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(bounds, bounds[1:]))


def attachment(counts: np.ndarray) -> np.ndarray:
    """Natural logs, 2 x ids: that an id after one that closes begins a word, and that it is attached."""
    return np.log((counts[1:] + 0.1) / (counts[1] + counts[2] + 0.2)).astype(np.float32)


def score_texts(docs: DataFrame, params: dict[str, np.ndarray], tokenizer_path: str, tokens: Tokens, attach: np.ndarray, head: dict[bytes, tuple[int, float]], n_train: int, n_kinds: int, shares: np.ndarray, held_in: bool = False) -> DataFrame:
    """row (unique), doc_id, n_tokens, known (of the head), and natural logs: base (of the head and the end), model (without the spelling of the rest), mixed (of the head and the end,
    for each row of ``shares``, which has a column for each of ``GATES``, and each gate); rest (other words, with keys of their ids, their gate and the model's log without spelling).

    held_in: words are mixed as if they had occurred once less, as words of training texts.
    """
    floor = math.log(n_train + 0.1 * (n_kinds + 1))
    logs = {w: math.log(n + 0.1) - floor for w, (n, _) in head.items()}
    spelling = {w: x for w, (_, x) in head.items()}
    unseen = math.log(0.1) - floor
    end_log, end_known = logs.get(b"", unseen), int(b"" in head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row, closing, ready = word_ids(tokenizer_path), TaskContext.get().partitionId() << 33, closing_ids(tokenizer_path), attention.prepared(params)
        work = attention.Work()
        of_place = _OfPlaces(words, logs, spelling)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            split = [t.translate(_LOWER).split() for t in texts]
            all_words, n = list(chain.from_iterable(split)), len(texts)
            sizes = np.fromiter(map(len, split), np.int64, n)
            special = [lowered(t).split() if b"<|" in t else s for s, t in zip(split, texts)]  # the same words, but for their case
            if differ := [i for i in range(n) if special[i] is not split[i]]:
                words.learn({w for ws in (*split, *special) for w in ws})
            places = encoded = words.learned(all_words)
            if differ:
                encoded = words.places(list(chain.from_iterable(special)))
            counted_word, spelled_word = of_place(places)
            # a text's words, then its end: all texts one after the other
            doc, ends = np.repeat(np.arange(n), sizes + 1), np.cumsum(sizes + 1) - 1
            is_word = np.ones(len(doc), bool)
            is_word[ends] = False
            place = np.arange(len(doc)) - np.repeat(ends - sizes, sizes + 1)
            counted, found = np.full(len(doc), end_log), np.empty(len(doc))
            counted[is_word] = counted_word
            bounds = np.append(0, np.cumsum(sizes))
            at = 0
            while at < n:
                upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _WORDS, "right")) - 1)
                found[bounds[at] + at : bounds[upto] + upto] = _word_scores(params, words, encoded[bounds[at] : bounds[upto]], sizes[at:upto], tokens, attach, closing, ready, work)
                at = upto
            found[is_word] += spelled_word
            inside = ~np.isnan(counted)
            model = np.bincount(doc, found, n)
            rare, gate = np.flatnonzero(~inside), np.searchsorted(GATES, place, "right") - 1
            rare_word = rare - doc[rare]
            rare_places = places[rare_word]
            fields = [pa.array([all_words[i] for i in rare_word.tolist()], pa.binary()), pa.array(_ids_key(words, rare_places), pa.int64()), pa.array(gate[rare], pa.int32()), pa.array(found[rare])]
            starts = np.append(0, np.cumsum(np.bincount(doc[rare], minlength=n)))
            rest = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(fields, names=["word", "key", "gate", "model"]))
            doc, gate, counted, found, is_word = doc[inside], gate[inside], counted[inside], found[inside], is_word[inside]
            base = np.bincount(doc, counted, n)
            if held_in:
                times = np.maximum(np.exp(counted + floor) - 1.1, 0)
                counted = np.log(times + 0.1) - floor + np.where(times < 0.5, found, 0)
            elif not end_known:
                counted = np.where(is_word, counted, counted + found)
            most, key = np.maximum(counted, found), doc * len(GATES) + gate
            a, b, whole = np.exp(counted - most), np.exp(found - most), np.bincount(key, most, n * len(GATES))
            mixed = np.stack([(whole + np.bincount(key, np.log(share[gate] * a + (1 - share)[gate] * b), n * len(GATES))).reshape(n, -1) for share in shares], 1)
            known = np.bincount(doc, minlength=n) - 1 + end_known
            each = pa.array(np.arange(n + 1, dtype=np.int32) * shares.size)
            columns = [pa.array(np.arange(row, row + n)), ids, pa.array(sizes + 1), pa.array(known), pa.array(base), pa.array(model), pa.ListArray.from_arrays(each, pa.array(mixed.ravel())), rest]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_tokens", "known", "base", "model", "mixed", "rest"])
            row += n

    return docs.mapInArrow(run, "row long, doc_id long, n_tokens long, known long, base double, model double, mixed array<double>, rest array<struct<word:binary,key:long,gate:int,model:double>>")


class _OfPlaces:
    """Logs of counts (nan: not of the head) and of spelling (0: none), by the places of words: asked once for each word that is remembered."""

    def __init__(self, words, logs: dict[bytes, float], spelling: dict[bytes, float]):
        self.words, self.logs, self.spelling, self.at = words, logs, spelling, None

    def __call__(self, places: np.ndarray) -> np.ndarray:
        if self.at is not self.words.at:  # the first call, or all that was remembered went
            self.at, self.values = self.words.at, np.empty((2, 0))
        if more := len(self.at) - self.values.shape[1]:
            new = list(islice(self.at, self.values.shape[1], None))  # words stand in the order of their places
            found = np.stack([np.fromiter(map(x.get, new, repeat(none)), np.float64, more) for x, none in ((self.logs, math.nan), (self.spelling, 0.0))])
            self.values = np.concatenate([self.values, found], 1)
        return self.values[:, places]


def _word_scores(params: dict[str, np.ndarray], words, places: np.ndarray, n_words: np.ndarray, tokens: Tokens, attach: np.ndarray, closing: np.ndarray, ready: tuple[np.ndarray, ...], work) -> np.ndarray:
    """The model's natural log of each word of each text, where white space stands included, and after each text that of its end. places: of the words of all texts; n_words: their numbers."""
    ids, sizes = words.ids(places), words.size[places]
    upto = np.append(0, np.cumsum(sizes))
    last_word = np.cumsum(n_words)
    n_ids = np.diff(upto[last_word], prepend=0)
    ends = np.cumsum(n_ids + 1) - 1
    is_id = np.ones(len(ids) + len(n_words), bool)
    is_id[ends] = False
    sequence = np.full(len(is_id), _END, np.int32)
    sequence[is_id] = tokens.token[ids]
    logs = _scores(params, np.split(sequence, ends[:-1] + 1), tokens, ready, work)
    begins = _begins(sizes)
    by_id = logs[is_id] + tokens.inside[ids] + np.where(begins, attach[0, ids], np.where(_attachable(ids, begins, closing), attach[1, ids], 0))
    so_far = np.append(0, np.cumsum(by_id))
    out = np.empty(len(places) + len(n_words))
    is_word = np.ones(len(out), bool)
    is_word[np.cumsum(n_words + 1) - 1] = False
    out[is_word], out[~is_word] = so_far[upto[1:]] - so_far[upto[:-1]], logs[ends]
    return out


def _scores(params: dict[str, np.ndarray], sequences: list[np.ndarray], tokens: Tokens, ready: tuple[np.ndarray, ...], work) -> np.ndarray:
    """Natural log probability of each token of each sequence."""
    inputs, targets, first, used = attention.blocks_of(sequences, tokens.kinds, KINDS - 1)
    out = np.empty(targets.shape, np.float64)
    for b in range(0, len(inputs), _BLOCKS):
        before = int(b > 0)  # the block before is context only
        out[b : b + _BLOCKS] = attention.log_probabilities(params, inputs[b - before : b + _BLOCKS], targets[b - before : b + _BLOCKS], first[b - before : b + _BLOCKS], ready, work)[before:]
    return out[used]


def _with_rest(scored: DataFrame, words: DataFrame, n_train: int, n_kinds: int, shares: np.ndarray, held_in: bool = False) -> DataFrame:
    """What the words beyond the head add to the rows of ``scored``: row, known_rest, base_rest, spelled_rest, mixed_rest (as ``mixed``).

    One join finds the counts; the few words that it finds none for are listed with their texts, and these alone meet the words of the same ids.
    """
    floor = F.lit(math.log(n_train + 0.1 * (n_kinds + 1)))
    added = ["known_rest", "base_rest", "spelled_rest"], [f"mixed_{i}" for i in range(len(shares))]

    def sums(found: DataFrame, *more: Column) -> DataFrame:
        """By row and gate. found: row, gate, model, n, spelled."""
        model, once_less = F.col("model") + F.col("spelled"), F.greatest(F.col("n") - 1, F.lit(0)) if held_in else F.col("n")
        counted = F.log(once_less + F.lit(0.1)) - floor + F.when(once_less > 0, 0.0).otherwise(model)

        def mixed(of_gates: np.ndarray) -> Column:
            of_gate = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("gate") + 1)
            a, b = F.col("counted") + of_gate(np.log(of_gates)), F.col("whole") + of_gate(np.log1p(-of_gates))
            return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))

        each = found.withColumns({"counted": counted, "whole": model, "base": F.log(F.col("n") + F.lit(0.1)) - floor})
        columns = [F.count_if(F.col("n") > 0), F.sum("base"), F.sum("spelled"), *(F.sum(mixed(x)) for x in shares)]
        return each.groupBy("row", "gate").agg(*(x.alias(name) for x, name in zip(columns, sum(added, []))), *more)

    rest = scored.select("row", F.explode("rest").alias("w")).select("row", "w.word", "w.key", "w.gate", "w.model")
    found = rest.join(words.select("word", "n", "spelled").hint("shuffle_hash"), "word", "left").repartition("row")
    unseen = F.collect_list(F.when(F.col("n").isNull(), F.struct("key", "gate", "model"))).alias("unseen")
    first = written(sums(found, unseen), "rest")
    listed = first.where(F.size("unseen") > 0).select("row", F.explode("unseen").alias("w")).select("row", "w.*")
    kinds = listed.join(words.where("first").select("key", "total", "forms"), "key", "left")
    every = first.drop("unseen").unionByName(sums(kinds.withColumns({"n": F.lit(0).cast("long"), "spelled": _share(F.lit(0))})))
    whole = [F.coalesce(F.sum(F.when(F.col("gate") == g, F.col(name))), F.lit(0.0)) for name in added[1] for g in range(shares.shape[1])]
    return every.groupBy("row").agg(*(F.sum(c).alias(c) for c in added[0]), F.array(*whole).alias("mixed_rest"))


def _mixed(joined: DataFrame) -> DataFrame:
    """mixed with the part of the rest, if a text has any."""
    return joined.withColumn("mixed", F.when(F.col("mixed_rest").isNull(), F.col("mixed")).otherwise(F.zip_with("mixed", "mixed_rest", lambda a, b: a + b)))


def best_shares(scored: DataFrame, rest: DataFrame, shares: np.ndarray) -> np.ndarray:
    """One row of shares: for each gate, that of the largest sum over all texts."""
    sums = _mixed(scored.select("row", "mixed").join(rest.select("row", "mixed_rest"), "row", "left")).select(F.posexplode("mixed").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(shares.size)
    for r in sums:
        total[r["at"]] = round(r["x"], 6)
    return shares[total.reshape(shares.shape).argmax(0), np.arange(shares.shape[1])][None, :]


def score_documents(docs: DataFrame, training: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, model_score (log10): a row for each row of ``docs``.

    score: of the attention and the counts mixed; model_score: of the attention alone.

    The model, the base and their shares learn from ``training``.  Null and empty texts are the end alone.  Null ids stay null;
    repeated rows stay repeated.  Empty training data: every count is 0.  An empty table gives an
    empty table; other columns are ignored.
    """
    docs, training = id_and_text(docs, id_col, text_col), id_and_text(training, id_col, text_col)
    counts = written(encoded_words(word_counts(training), tokenizer_path), "words")
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.sum(F.when(F.col("word") == F.lit(b""), F.col("n"))).alias("docs")).first()
    n_train, n_kinds, n_docs = totals["n"] or 0, totals["kinds"], totals["docs"] or 0
    found = id_counts(counts, tokenizer_path, load_tokenizer(tokenizer_path).get_vocab_size())
    tokens, attach = Tokens(found[0]), attachment(found)
    words = written(spelled_words(counts), "spelled")
    discard(counts)
    head = frequent_words(words)
    *_, before, params = fit_rounds(training, tokenizer_path, tokens, n_docs)
    tried = np.repeat(np.array(SHARES)[:, None], len(GATES), 1)
    held = written(score_texts(last_round(training, n_docs), before, tokenizer_path, tokens, attach, head, n_train, n_kinds, tried, held_in=True), "held")
    shares = best_shares(held, _with_rest(held, words, n_train, n_kinds, tried, held_in=True), tried)
    discard(held)
    scored = written(score_texts(docs, params, tokenizer_path, tokens, attach, head, n_train, n_kinds, shares), "scored")
    out = _mixed(scored.drop("rest").join(_with_rest(scored, words, n_train, n_kinds, shares), "row", "left"))
    log10 = lambda x, more: ((x + F.coalesce(more, F.lit(0.0))) / math.log(10)).alias
    score = F.aggregate("mixed", F.lit(0.0), lambda a, x: a + x) / math.log(10)
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("known_rest", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), log10(F.col("base"), "base_rest")("base_score"), score.alias("score"), log10(F.col("model"), "spelled_rest")("model_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_documents(docs, docs.where(id_hash() % 10 != 0), vocabulary("word_bpe_49k.json"))
    return scored.select("doc_id", (id_hash() % 10 == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "model_score")
