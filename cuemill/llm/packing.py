"""Packing documents into training sequences, in order, with little padding.

Every task takes the documents of its partition in the order in which they come and lays
their token ids one after the other.  Possible cuts are the ends of documents and of sentences,
and, in stretches without either, places a fixed number of ids apart.  A dynamic program
over the cuts minimises padding plus a penalty for each cut by its kind.  The padding
of a window is linear in its start, so that the best start within reach is the head of a
monotone queue; windows of a power of two, which aren't padded, are looked up.

Nothing is shuffled.  The stream is handled in blocks of bounded size; the last windows of
a block stay open and are decided anew with the next one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text
from .vocabularies import kept, load_tokenizer, lowered, vocabulary, word_ids

WINDOW = 2048
#: Id that ends each document.
END_ID = 1
#: What a cut costs, in ids of padding: at the end of a sentence, or elsewhere; cuts between documents are free.
SENTENCE_PENALTY, HARD_PENALTY = 12, 96
#: What each sequence costs, so that of equal paddings the one of fewer sequences wins.
SEQUENCE_COST = 1
#: Stretches without a document's or sentence's end get possible cuts so many ids apart.
HARD_STEP = 256
#: Ids handled at a time, and windows that stay open at the end of a block.
BLOCK_IDS, OPEN_WINDOWS = 1 << 19, 8


def padding(length: int, window: int = WINDOW) -> int:
    """Sequences are padded to the window, except at a power of two."""
    return 0 if length & (length - 1) == 0 else window - length


def best_cuts(places: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """The cuts, out of places (ascending, from 0, no gap above the window), that cost least; the first and last stay."""
    cost, back = [0] * len(places), [0] * len(places)
    where = np.array(places)

    def before(power: int) -> list[int]:
        """Of each place, the cut that lies so many ids before it, or -1."""
        at = np.searchsorted(where, where - power)
        return np.where(where[at] == where - power, at, -1).tolist()

    halves, quarters = before(window // 2), before(window // 4)  # the window itself has no padding anyway; shorter ones make too many sequences
    queue: deque[int] = deque([0])
    keys = [0] * len(places)
    for j in range(1, len(places)):
        p = places[j]
        low = p - window
        while places[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = keys[i] + window - p
        if (k := halves[j]) >= 0 and cost[k] < best:
            best, i = cost[k], k
        if (k := quarters[j]) >= 0 and cost[k] < best:
            best, i = cost[k], k
        best += penalties[j] + SEQUENCE_COST
        cost[j], back[j], keys[j] = best, i, best + p
        key = keys[j]
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [places[-1]], len(places) - 1
    while j:
        j = back[j]
        cuts.append(places[j])
    return cuts[::-1]


def possible_cuts(ids: np.ndarray, doc_ends: np.ndarray, is_sentence_end: np.ndarray, window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Places at which a stream may be cut, with 0 and its length, and the penalty of each."""
    step = min(HARD_STEP, window)
    sentence = np.flatnonzero(is_sentence_end[ids]) + 1
    soft = np.unique(np.concatenate([[0], sentence, doc_ends, [len(ids)]]))
    gaps = np.diff(soft)
    wide = np.flatnonzero(gaps > step)
    hard = np.concatenate([np.arange(soft[i] + step, soft[i + 1], step) for i in wide]) if len(wide) else np.zeros(0, np.int64)
    places = np.concatenate([soft, hard])
    penalties = np.concatenate([np.full(len(soft), SENTENCE_PENALTY), np.full(len(hard), HARD_PENALTY)])
    free = np.isin(places, doc_ends) | (places == 0)
    penalties[free] = 0
    order = np.argsort(places, kind="stable")
    return places[order].tolist(), penalties[order].tolist()


def split_tail(cuts: list[int], window: int) -> list[int]:
    """The last window of a stream, cut at powers of two where that is cheaper than its padding."""
    length = cuts[-1] - cuts[-2] if len(cuts) > 1 else 0
    if not length or (length.bit_count() - 1) * HARD_PENALTY >= padding(length, window):
        return cuts
    out, rest = cuts[:-1], length
    while rest:
        power = 1 << (rest.bit_length() - 1)
        out.append(out[-1] + power)
        rest -= power
    return out


def sentence_ends(tokenizer) -> np.ndarray:
    """Of each id, whether its token is only full stops, exclamation or question marks, alone or ending a word."""
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max([END_ID, *vocab.values()]) + 1, bool)
    for token, i in vocab.items():
        text = token.removesuffix("</w>")
        out[i] = bool(text) and not text.strip(".!?")
    return out


class Packer:
    """The stream of one task."""

    def __init__(self, tokenizer_path: str, window: int):
        self.words, self.window = word_ids(tokenizer_path), window
        self.ends = kept(("sentence ends", tokenizer_path), lambda: sentence_ends(load_tokenizer(tokenizer_path)), small=True)
        self.ids = np.zeros(0, np.int32)
        # documents that have ids in the stream: id, place of the first of them, ids of the document before it, ids in all
        self.doc_ids: list = []
        self.at: list[int] = []
        self.before: list[int] = []
        self.sizes: list[int] = []
        self.sequence = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0

    def add(self, doc_ids: list, texts: list[bytes]) -> None:
        split = [lowered(t).split() for t in texts]
        places = self.words.learned(list(chain.from_iterable(split)))
        ids = self.words.ids(places)
        ends = np.concatenate([[0], np.cumsum(self.words.size[places])])
        per_doc = np.diff(ends[np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])])
        stream = np.empty(len(ids) + len(texts), np.int32)
        last = np.cumsum(per_doc + 1) - 1
        own = np.ones(len(stream), bool)
        own[last] = False
        stream[own], stream[last] = ids, END_ID
        self.at += (len(self.ids) + last - per_doc).tolist()
        self.doc_ids += doc_ids
        self.before += [0] * len(texts)
        self.sizes += (per_doc + 1).tolist()
        self.ids = np.concatenate([self.ids, stream])

    def take(self, last: bool) -> tuple[list, pa.RecordBatch] | None:
        """Decides the windows of the stream, all if it is the last call, and returns their pieces."""
        if not len(self.ids):
            return None
        starts = np.array(self.at, np.int64)
        doc_ends = starts + np.array(self.sizes, np.int64) - np.array(self.before, np.int64)
        places, penalties = possible_cuts(self.ids, doc_ends, self.ends, self.window)
        cuts = best_cuts(places, penalties, self.window)
        cuts = split_tail(cuts, self.window) if last else cuts[: max(1, len(cuts) - OPEN_WINDOWS)]
        until = cuts[-1]
        if not until:
            return None
        window_starts = np.array(cuts[:-1], np.int64)
        first = np.unique(np.concatenate([window_starts, starts[starts < until]]))
        bounds = np.append(first, until)
        doc = np.searchsorted(starts, first, "right") - 1
        seq = np.searchsorted(window_starts, first, "right") - 1
        before = np.array(self.before, np.int64)
        data = np.ascontiguousarray(self.ids[:until], "<i4")
        binary = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(data)])
        out = [
            pa.array([self.doc_ids[i] for i in doc.tolist()], pa.int64()),
            pa.array(before[doc] + first - starts[doc]),
            pa.array(np.diff(bounds)),
            binary,
            pa.array(np.array(self.sizes, np.int64)[doc]),
            pa.array(self.sequence + seq),
            pa.array(first - window_starts[seq]),
        ]
        self.sequence += len(window_starts)
        # what stays: the stream from the last cut, and the documents that end after it
        k = int(np.searchsorted(doc_ends, until, "right"))
        self.ids = self.ids[until:].copy()
        self.before = [b + max(0, until - a) for a, b in zip(self.at[k:], self.before[k:])]
        self.at = [max(0, a - until) for a in self.at[k:]]
        self.doc_ids, self.sizes = self.doc_ids[k:], self.sizes[k:]
        return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` ids.

    One row for each piece: doc_id, start (ids of its document before it), length, ids
    (unsigned little-endian 32-bit), doc_tokens (ids of the document with the end id), sequence_id,
    offset (place in the sequence).  Each id of each document lies in one piece; the pieces of a
    document come in order, in one or consecutive sequences.  The vocabulary must drop white space.

    Null and empty texts: the end id alone.  Null ids stay null; repeated rows are packed as often
    as they come.  An empty table gives an empty table.  Other columns are ignored.
    """
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tokenizer_path, window)
        for batch in batches:
            packer.add(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())
            if len(packer.ids) >= BLOCK_IDS and (out := packer.take(False)):
                yield pa.RecordBatch.from_arrays(out, names=names)
        if out := packer.take(True):
            yield pa.RecordBatch.from_arrays(out, names=names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
