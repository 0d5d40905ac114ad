"""N-gram Jaccard join by parity sketches, exact.

The set of a document is that of its distinct word shingles, as 64-bit hashes.  Two sets of a
and b shingles with a Jaccard similarity of at least p percent differ in at most
(a + b) * (100 - p) / (100 + p) shingles.

* **Size bands.**  Sets are put in bands of sizes; a set whose partners can be in the next band
  is in that one too.
* **Parity sketch.**  In a band, shingles are dealt by hash to blocks, and every block is
  the XOR of the hashes of its shingles.  A shingle that only one of two sets has changes one block.
* **Pigeonhole.**  A band has more blocks than any two of its sets may differ in, so that linked
  sets agree in some, at least in as many as there are *spare* ones.  All blocks are ranked by how many shingles they
  hold, then by hash; a set leaves out the lowest ones, one fewer than are spare.  Of the blocks in which linked
  sets agree, the highest has so many below it in both sets, so neither leaves it out, while blocks of no or
  one shingle, which many documents share by chance, give no keys.  In bands of small sets
  linked sets agree in two or three blocks beyond those left out, and the keys are all choices of so many blocks.
* **Verification.**  First, members of a bucket are checked against its smallest one, on the whole
  sets, and components are formed.  Buckets that still hold several components are open.  Of
  crowded ones, members meet again only where they share one of their rarest shingles: linked sets have
  ``percent`` of each set in common, so of the shingles of a set, in order of how many such members have them, the first ones beyond
  that share hold one of the other's.  A passage that many documents share is frequent there and makes no pairs.
  In what is left,
  members are compared with those of other components by longer parity sketches, in chunks of
  bounded size: XOR-ing two sketches leaves no more bits than the sets differ in.  Pairs that the
  sketches allow are checked on the whole sets.

A task first groups what it has itself: of equal sets and of equal blocks one row goes to the
shuffle, so that a bucket has no more rows there than there are tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, id_and_text, lean_worker, written
from .components import connected_components
from .vocabularies import kept

#: Members of an open bucket that are compared at a time with as many others.
CHUNK = 1024
#: Comparisons for each member from which on an open bucket is crowded.
CROWDED = 1024
#: Tables of one or two numbers a row are broadcast up to so many rows, 8 MB.
BROADCAST_ROWS = 1 << 19
#: Keys that a task holds before it hands them on.
HELD_KEYS = 1 << 19
#: Of a member's open buckets, so many of the smallest keys go along, to give out pairs once (mostly: doubles do no harm).
KEYS_ALONG = 16
#: Rows of open buckets that a task gathers, and bytes of sketches that it compares, at a time.
HELD_ROWS, PAIR_BYTES = 1 << 12, 1 << 22
#: Bits of the sketches of verification: so many for each shingle, a power of two between these.
SKETCH_BITS, LEAST_BITS, MOST_BITS = 2, 256, 1 << 13
#: Words whose hashes a Python worker remembers.
REMEMBERED = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    known = kept("word hashes", dict)
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > REMEMBERED:
            known.clear()
        known.update((w, xxhash.xxh64_intdigest(w)) for w in set(words) if w not in known)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of fewer words than ``width`` the whole sequence is one."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = _word_hashes(words)
    size = min(width, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(33))) * _ODD[2 + i % 6] + hashes[i : len(hashes) - size + 1 + i]
    return np.unique(_mixed(mixed))


class Bands:
    """Sizes of the bands and numbers of their blocks."""

    def __init__(self, percent: int):
        self.percent, self.ratio = percent, max(1.25, 1.2 * 100 / percent)

    def bounds(self, size: int) -> tuple[int, int, int]:
        """Number, first and last size of the band of a size."""
        low, number = 1, 0
        while (high := max(low + 1, math.ceil(low * self.ratio))) <= size:
            low, number = high, number + 1
        return number, low, high - 1

    def blocks(self, last: int) -> tuple[int, int, int]:
        """Number of blocks, blocks that are left out, and blocks that make a key, where ``last`` is the band's largest size."""
        differ = 2 * last * (100 - self.percent) // (100 + self.percent)
        if not differ:
            return 1, 0, 1
        chosen = 3 if differ <= 3 else 2 if differ <= 10 else 1
        out = 1 if chosen > 1 else max(2, differ // 8 + 1)
        return differ + chosen + out, out, chosen

    def of(self, size: int) -> list[tuple[int, int, int, int]]:
        """Bands that a set of this size is in: number, blocks, blocks left out, blocks of a key."""
        number, _, last = self.bounds(size)
        out = [(number, *self.blocks(last))]
        if size * 100 // self.percent > last:
            out.append((number + 1, *self.blocks(self.bounds(last + 1)[2])))
        return out


def block_keys(shingles: np.ndarray, bands: Bands, memo: dict) -> np.ndarray:
    """Keys of a set, one for each bucket that it is in."""
    size, out = len(shingles), []
    if size not in memo:
        memo[size] = bands.of(size)
    mixed = _mixed(shingles)
    for number, blocks, left_out, chosen in memo[size]:
        block = ((shingles >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        first = np.flatnonzero(np.append(True, block[order][1:] != block[order][:-1]))
        words, held = np.zeros(blocks, np.uint64), np.bincount(block, minlength=blocks)
        words[block[order][first]] = np.bitwise_xor.reduceat(mixed[order], first)
        keys = _mixed(words + _mixed(np.arange(blocks).astype(np.uint64) * _ODD[3] + np.uint64(number + 1)))
        keys = keys[np.lexsort((keys, held))[left_out:]]
        if chosen > 1:
            if (len(keys), chosen) not in memo:
                memo[len(keys), chosen] = np.array(list(combinations(range(len(keys)), chosen)))
            keys = _mixed(np.bitwise_xor.reduce(keys[memo[len(keys), chosen]], axis=1))
        out.append(keys)
    return np.concatenate(out)


def bucket_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """k1, k2, doc, lo, n: a row for each document (k2 not null: k1 and k2 are its set's digest; n: its size), and one for each bucket that it is in.

    lo: another member, smaller in the task, that stands for it in the shuffle; else null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        bands, memo, first = Bands(percent), {}, {}
        keys, owners, held = [], [], 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                shingles = shingle_set(text, width)
                digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
                k1, k2 = np.frombuffer(digest, "<i8").tolist()
                if doc is None or not len(shingles):
                    rows.append((k1, k2, doc, doc, len(shingles)))
                    continue
                if digest in first:
                    rows.append((k1, k2, doc, first[digest], len(shingles)))
                    continue
                first[digest] = doc
                rows.append((k1, k2, doc, None, len(shingles)))
                own = block_keys(shingles, bands, memo)
                keys.append(own)
                owners.append(np.full(len(own), doc, np.int64))
                held += len(own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)
            if held >= HELD_KEYS:
                yield from grouped(keys, owners)
                keys, owners, held = [], [], 0
        if keys:
            yield from grouped(keys, owners)

    def grouped(keys: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, owner = np.concatenate(keys).view(np.int64), np.concatenate(owners)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        fresh = np.append(True, key[1:] != key[:-1])
        least = owner[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        use = fresh | (owner != least)
        key, owner, least, fresh = key[use], owner[use], least[use], fresh[use]
        for i in range(0, len(key), 1 << 16):
            part = slice(i, i + (1 << 16))
            n = len(key[part])
            yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.nulls(n, pa.int64()), pa.array(owner[part]), pa.array(least[part], mask=fresh[part]), pa.nulls(n, pa.int64())], names=names)

    names = ["k1", "k2", "doc", "lo", "n"]
    return docs.mapInArrow(run, "k1 long, k2 long, doc long, lo long, n long")


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits that an odd number of shingles have, as bytes; long sketches fold onto shorter ones by XOR of their halves."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (SKETCH_BITS * max(1, len(shingles)) - 1).bit_length()))
    odd = np.bincount((_mixed(shingles) >> np.uint64(17)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc, n (size of the set), sketch, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([parity_sketch(x).tobytes() for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc", "n", "sketch", "shingles"])

    return docs.mapInArrow(run, "doc long, n long, sketch binary, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    # sizes and short sketches go first; only pairs that they allow get the whole sets
    light = lambda end: sets.select(F.col("doc").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}"))
    full = lambda end: sets.select(F.col("doc").alias(end), F.col("shingles").alias(f"x_{end}"))

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            a, b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            keep = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
            for i, (x, y) in enumerate(zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist())):
                if keep[i]:
                    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                    size = min(len(x), len(y))
                    keep[i] = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) * (100 + percent) <= int(a[i] + b[i]) * (100 - percent)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    near = pairs.join(light("a"), "a").join(light("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(allowed, "a long, b long")
    near = written(near, "pairs")
    out = written(near.join(full("a"), "a").join(full("b"), "b").select("a", "b", "x_a", "x_b").mapInArrow(run, "a long, b long"), "verified")
    discard(near)
    return out


def rarest_shared(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """k1, doc, component: buckets of the members (doc, component) that share one of their rarest shingles; linked ones share some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            for doc, of, n, blob in zip(*(batch.column(c).to_pylist() for c in ("doc", "of", "n", "shingles"))):
                shingles = np.frombuffer(blob, np.int64)
                for i in range(0, n, 1 << 16):
                    part = shingles[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(part), x, np.int64)) for x in (doc, of, n)), pa.array(part)], names=["doc", "of", "n", "shingle"])

    own = sets.join(_small(members.select("doc").distinct()), "doc", "left_semi").select("doc", F.xxhash64("shingles").alias("of"), "n", "shingles").dropDuplicates(["doc", "of"])
    shingles = own.mapInArrow(run, "doc long, of long, n long, shingle long")
    shared = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    each = Window.partitionBy("doc", "of")
    ranked = shingles.join(shared, "shingle").select("*", F.row_number().over(each.orderBy("df", "shingle")).alias("place"), F.count(F.lit(1)).over(each).alias("held"))
    # those that nobody shares come first and make no bucket
    first = ranked.where(f"n - held + place <= n - (n * {percent} + 99) div 100 + 1").select("doc", F.xxhash64(F.lit("rare"), "shingle").alias("k1")).distinct()
    return first.join(members, "doc").select("k1", "doc", "component")


def open_buckets(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """k1, doc, component, size: members of the buckets whose pairs are to be compared; and the tables that this reads.

    members: k1, doc, component.  Buckets of one component have nothing to compare, and of a bucket of
    two the only pair was checked before.  Members of crowded buckets, in which each would be compared ``CROWDED`` times or more, are put in buckets of
    their rarest shingles instead; these are compared as they are, so no pair is lost.
    """

    def sized(rows: DataFrame, least: int) -> DataFrame:
        own = rows.groupBy("k1", "component").agg(F.count(F.lit(1)).alias("own"))
        size = own.groupBy("k1").agg(F.sum("own").alias("size"), (F.pow(F.sum("own"), F.lit(2)) / 2 - F.sum(F.pow("own", F.lit(2))) / 2).alias("across"))
        return rows.join(size.where(f"across > 0 AND size >= {least}"), "k1").select("k1", "doc", "component", "size", "across")

    first = written(sized(members, 3), "sized")
    crowded = F.col("across") >= CROWDED * F.col("size")
    heavy = first.where(crowded).select("doc", "component").distinct()
    light = first.where(~crowded).drop("across")
    if heavy.isEmpty():
        return light, [first]
    again = written(rarest_shared(heavy, sets, percent), "rare")
    return light.union(sized(again, 2).drop("across")), [first, again]


def _sketch_matrix(sketches: list[bytes], size: int) -> np.ndarray:
    return np.stack([folded(np.frombuffer(x, np.uint8), size) for x in sketches]).view(np.uint64)


def _allowed_pairs(rows: dict[str, np.ndarray], sketches: list[bytes], keys: list[np.ndarray], percent: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs of documents of one group that are in different components and that sizes and sketches allow, but for those that another group gives out.

    rows: group (sorted), k1, doc, component, part, across, n.  keys: of each row, its smallest keys.
    """
    order = np.lexsort((rows["component"], rows["group"]))  # a row meets the components behind its own one
    rows, sketches, keys = {c: x[order] for c, x in rows.items()}, [sketches[i] for i in order], [keys[i] for i in order]
    group, n, lengths = rows["group"], rows["n"], np.fromiter(map(len, sketches), np.int64, len(sketches))
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    shortest = np.repeat(np.minimum.reduceat(lengths, first), np.diff(np.append(first, len(group))))
    a, b = [], []
    for size in np.unique(shortest).tolist():
        at = np.flatnonzero(shortest == size)
        bits, own = _sketch_matrix([sketches[i] for i in at], size), group[at]
        last = np.flatnonzero(np.append((own[1:] != own[:-1]) | (rows["component"][at][1:] != rows["component"][at][:-1]), True))
        behind = last[np.searchsorted(last, np.arange(len(at)))] + 1
        later = np.searchsorted(own, own, "right") - behind  # rows of the group in other components behind each one
        upto = np.cumsum(later)
        for low in range(0, int(upto[-1]), PAIR_BYTES // size):  # so many pairs at a time, whatever the groups
            k = np.arange(low, min(low + PAIR_BYTES // size, int(upto[-1])))
            x = np.searchsorted(upto, k, "right")
            y = behind[x] + k - (upto[x] - later[x])
            i, j = at[x], at[y]
            ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            ok &= ~rows["across"][i] | (rows["part"][i] != rows["part"][j])
            x, y, i, j = x[ok], y[ok], i[ok], j[ok]
            ok = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
            i, j = i[ok], j[ok]
            here = [np.intersect1d(keys[x], keys[y])[:1].tolist() in ([], [k]) for x, y, k in zip(i.tolist(), j.tolist(), rows["k1"][i].tolist())]
            i, j = i[here], j[here]
            a.append(np.minimum(rows["doc"][i], rows["doc"][j]))
            b.append(np.maximum(rows["doc"][i], rows["doc"][j]))
    return a, b


def open_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of a bucket, in different components, that sketches allow.

    members: k1, doc, component, size (rows of the bucket).  Buckets are dealt into
    chunks, and each two chunks of a bucket meet once: no task holds more than two chunks and some thousand rows besides.
    A pair is given out by the bucket of the smallest key that is known to hold both.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        held: list[pa.RecordBatch] = []

        def found(table: pa.Table) -> pa.RecordBatch:
            k1, i, j = (table.column(c).to_numpy() for c in ("k1", "i", "j"))
            fresh = np.append(True, (k1[1:] != k1[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            rows = {c: table.column(c).to_numpy() for c in ("k1", "doc", "component", "part", "n")} | {"group": np.cumsum(fresh), "across": i != j}
            lists = table.column("keys").combine_chunks()
            keys = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
            a, b = _allowed_pairs(rows, table.column("sketch").to_pylist(), keys, percent)
            a, b = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= HELD_ROWS:
                table = pa.Table.from_batches(held)
                k1, i, j = (table.column(c).to_numpy() for c in ("k1", "i", "j"))
                same = (k1 == k1[-1]) & (i == i[-1]) & (j == j[-1])  # the last group may go on
                if cut := int(np.argmax(same)):
                    yield found(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if held:
            yield found(pa.Table.from_batches(held))

    members = members.withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    lists = members.groupBy("doc").agg(F.slice(F.sort_array(F.collect_set("k1")), 1, KEYS_ALONG).alias("keys"))  # no more are collected than a set has buckets
    dealt = members.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int"))
    dealt = dealt.select("k1", "doc", "component", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("k1", "doc", "component", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    dealt = dealt.join(sets.select("doc", "n", "sketch").join(lists, "doc"), "doc").select("k1", "doc", "component", "part", "i", "j", "n", "sketch", "keys")
    return dealt.repartition("k1", "i", "j").sortWithinPartitions("k1", "i", "j").mapInArrow(compare, "a long, b long").distinct()


def _small(table: DataFrame) -> DataFrame:
    """Marked for broadcast if a count says that it is small; else Spark joins it as it likes."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that can be reached by links): one row for each row of ``docs``.

    Link: 100 * intersection >= percent * union of the sets of ``width``-word shingles (A-Z in lower case).
    Null and empty texts have no shingles and no link.  Rows with a null id have no link and a null
    component.  Rows with the same id are one node.  An empty table gives an empty table; other
    columns are ignored.  Exact: no link is lost, whatever the sizes of groups and buckets.
    """
    docs = id_and_text(docs, id_col, text_col)
    # what a task has grouped already goes anywhere: only the ones that stand for it meet the other tasks' rows
    spread = Window.partitionBy("k1", "k2", "apart")
    rows = bucket_rows(docs, width, percent).withColumn("apart", F.when(F.col("lo").isNotNull(), F.col("doc")))
    rows = rows.select("*", F.min("doc").over(spread).alias("least"), F.count(F.lit(1)).over(spread).alias("members"))
    rows = rows.where("k2 IS NOT NULL OR lo IS NOT NULL OR members > 1").select("k1", "k2", "doc", F.coalesce("lo", "least").alias("lo"), "n")
    rows = written(rows, "buckets")
    each = written(rows.where("k2 IS NOT NULL"), "documents")
    buckets = rows.where("k2 IS NULL").select("k1", "doc", "lo")
    same = each.where("n > 0 AND doc <> lo").select(F.col("lo").alias("a"), F.col("doc").alias("b"))
    star = written(buckets.where("doc <> lo").select(F.col("lo").alias("a"), F.col("doc").alias("b")).distinct(), "star")
    wanted = star.select(F.col("a").alias("doc_id")).union(star.select("b")).distinct()
    sets = written(shingle_sets(docs.join(_small(wanted), "doc_id", "left_semi"), width), "sets")
    links = verified(star, sets, percent)
    labels = connected_components(same.union(links))
    discard(links)
    # a bucket all of whose members are linked to their smallest one is settled; one with a pair that isn't is open
    label = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    apart = star.join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select(F.col("a").alias("lo"), F.col("b").alias("doc"))
    apart = written(apart, "apart")
    still = written(buckets.join(_small(apart), ["lo", "doc"]).select("k1").distinct(), "open")
    members = buckets.join(_small(still), "k1")
    members = members.select("k1", "doc").union(members.select("k1", F.col("lo"))).distinct()
    members = members.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").select("k1", "doc", F.coalesce("component", "doc").alias("component"))
    members = written(members, "members")
    discard(apart, still)
    buckets, tables = open_buckets(members, sets, percent)
    links = verified(open_pairs(buckets, sets, percent), sets, percent)
    found = links.join(label("a"), "a", "left").join(label("b"), "b", "left")
    merged = written(found.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")), "links")
    if not merged.isEmpty():
        old, labels = labels, connected_components(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).union(merged))
        discard(old)
    discard(rows, star, sets, members, links, merged, *tables)
    out = each.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), width=3, percent=90)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 90 * (p.n + q.n - common)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c ON c.doc_id = d.doc_id
"""
