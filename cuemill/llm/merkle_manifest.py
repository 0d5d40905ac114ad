"""Merkle manifest of a dataset, its trees stored in van Emde Boas order.

Each group has a tree over its rows' digests, in order; a tree of trees, over the groups in order, gives the root.  A
node is the hash of the two below it, or of the one that the end of a row leaves.

* **Blocks.**  A tree is cut into aligned subtrees of ``LEVELS`` levels of hashing.  The roots of a tier's blocks are
  the leaves of the next tier, until one block is left: three tiers hold a billion rows.
* **Layout.**  A block is one array of digests.  A subtree is cut at half its height into a top and
  the subtrees under it, each stored whole, one after the other, and cut in the same way: wherever caches or pages end, a path from
  a leaf to the root touches few of them.  ``address`` gives the place of a node by arithmetic alone; construction and
  retrieval of siblings both use it, and no links are stored.
* **Order at scale.**  Rows are dealt by ranges and numbered within them; only counts by range and group
  are summed up across.  No task holds more than a range or a block, however large a group is.
* **Proofs.**  Paths go down the tiers, one row for each block; a task then has a block and the path of its root,
  and gives the proof of each of its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, id_hash, written

#: Levels of hashing in a block, which has twice 2 ** LEVELS nodes of 32 bytes.
LEVELS = 10
#: key: the group; block: its number in the tier; total: leaves of the whole tier; nodes: digests in van Emde Boas order; ids, claims: of the leaves.
BLOCK = "key string, block long, total long, levels int, root binary, nodes binary, ids array<long>, claims array<binary>"
#: Of a block's root. turns: of each level upwards, whether the sibling is left (L), right (R) or not there (N); siblings: digests one after the other.
PATH = "key string, block long, turns string, siblings binary, subroot binary, top binary"
PROOF = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes of a depth (0: root) in a tree of so many levels of nodes, in van Emde Boas order."""
    base, index = np.zeros(len(index), np.int64), np.asarray(index, np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        bottom, depth = levels - top, depth - top
        base += (1 << top) - 1 + (index >> depth) * ((1 << bottom) - 1)
        index, levels = index & ((1 << depth) - 1), bottom
    return base


def node_hash(*digests: bytes) -> bytes:
    """Digests are hashed as lower-case hexadecimal text."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def build(digests: list[bytes], levels: int) -> np.ndarray:
    """Nodes of a tree over these leaves, with so many levels of nodes; places of nodes that don't exist stay zero."""
    nodes, n = np.zeros(((1 << levels) - 1, 32), np.uint8), len(digests)
    nodes[address(levels, levels - 1, np.arange(n))] = np.frombuffer(b"".join(digests), np.uint8).reshape(n, 32)
    for depth in range(levels - 2, -1, -1):
        below = [x.tobytes() for x in nodes[address(levels, depth + 1, np.arange(n))]]
        n = (n + 1) // 2
        made = b"".join(node_hash(*below[2 * i : 2 * i + 2]) for i in range(n))
        nodes[address(levels, depth, np.arange(n))] = np.frombuffer(made, np.uint8).reshape(n, 32)
    return nodes


def siblings(nodes: np.ndarray, levels: int, n: int) -> Iterator[tuple[str, bytes]]:
    """Of each of the n leaves: its turns and its siblings' digests, upwards, taken by address."""
    turns, found = [[] for _ in range(n)], [[] for _ in range(n)]
    count = n
    for depth in range(levels - 1, 0, -1):
        at = np.arange(n) >> (levels - 1 - depth)
        other = at ^ 1
        there = other < count
        digests = nodes[address(levels, depth, np.where(there, other, 0))]
        for i in range(n):
            turns[i].append("N" if not there[i] else "R" if at[i] % 2 == 0 else "L")
            if there[i]:
                found[i].append(digests[i].tobytes())
        count = (count + 1) // 2
    for t, d in zip(turns, found):
        yield "".join(t), b"".join(d)


def folded(digest: bytes, turns: str, path: bytes) -> bytes:
    """The root that a leaf's digest and its siblings give."""
    at = 0
    for turn in turns:
        if turn == "N":
            digest = node_hash(digest)
        else:
            other, at = path[at : at + 32], at + 32
            digest = node_hash(other, digest) if turn == "L" else node_hash(digest, other)
    return digest


class Manifest(NamedTuple):
    #: Of the groups' trees and of the tree over the groups, the tables of blocks, lowest tier first.
    groups: list[DataFrame]
    top: list[DataFrame]


def numbered(rows: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """rows (key, id, digest, claim) with index (place in the key, from 0) and total (rows of the key), by the columns of ``order``.

    Equal rows come in an order of no matter of their own, so that ranges can be cut among them.
    """
    rows, order = written(rows, name), ("key", *order, "tie")
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), name)
    discard(rows)
    by_key = Window.partitionBy("key")
    ranges = dealt.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("key", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(by_key).alias("total"))
    return dealt.join(ranges, ["key", "part"]).select("key", (F.col("at") + F.col("shift")).alias("index"), "total", "digest", "id", "claim")


def _tier(leaves: DataFrame, height: int, name: str) -> DataFrame:
    """The blocks of a tier of leaves (key, index, total, digest, id, claim)."""

    def make(table: pa.Table) -> pa.Table:
        rows = table.sort_by("index")
        total, levels = rows["total"][0].as_py(), height + 1
        if total <= 1 << height:
            levels = (total - 1).bit_length() + 1
        nodes = build(rows["digest"].to_pylist(), levels)
        row = {"key": rows["key"][0].as_py(), "block": rows["index"][0].as_py() >> height, "total": total, "levels": levels, "root": nodes[0].tobytes(), "nodes": nodes.tobytes()}
        return pa.Table.from_pylist([row | {"ids": rows["id"].to_pylist(), "claims": rows["claim"].to_pylist()}], schema)

    schema = _arrow(BLOCK)
    return written(leaves.groupBy("key", F.shiftright("index", height).alias("block")).applyInArrow(make, BLOCK), name)


def forest(leaves: DataFrame, height: int, name: str) -> list[DataFrame]:
    """Tables of blocks, lowest tier first, of numbered leaves."""
    tiers = [_tier(leaves, height, name)]
    while tiers[-1].where(f"total > {1 << height}").limit(1).count():
        up = tiers[-1].where(f"total > {1 << height}")
        total = F.shiftright(F.col("total") + (1 << height) - 1, height)
        nothing = F.lit(None)
        tiers.append(_tier(up.select("key", F.col("block").alias("index"), total.alias("total"), F.col("root").alias("digest"), nothing.cast("long").alias("id"), nothing.cast("binary").alias("claim")), height, name))
    return tiers


def build_manifest(leaves: DataFrame, height: int = LEVELS) -> Manifest:
    """The manifest of leaves (key: their group, in the order of groups; id; digest; claim: a digest to prove).

    In a group leaves come by id, nulls first, then by digest. The tables lie in the shared folder.
    """
    groups = forest(numbered(leaves, ("id", "digest"), "leaves"), height, "blocks")
    roots = [t.where(f"total <= {1 << height}").select(F.lit("").alias("key"), F.lit(None).cast("long").alias("id"), F.col("root").alias("digest"), F.col("key").cast("binary").alias("claim")) for t in groups]
    return Manifest(groups, forest(numbered(reduce(DataFrame.union, roots), ("claim",), "subroots"), height, "top"))


def _each_leaf(blocks: DataFrame, schema: str, leaf: Callable[[dict, int, bytes, str, bytes], dict]) -> DataFrame:
    """A row of each leaf of blocks that have the path of their root: ``leaf`` gets the block's row, the leaf's place, digest, turns and siblings, up to the top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
                nodes, n = np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32), len(row["ids"])
                own = nodes[address(row["levels"], row["levels"] - 1, np.arange(n))]
                out = [leaf(row, i, own[i].tobytes(), turns + row["turns"], path + row["siblings"]) for i, (turns, path) in enumerate(siblings(nodes, row["levels"], n))]
                yield pa.RecordBatch.from_pylist(out, arrow)

    arrow = _arrow(schema)
    return blocks.mapInArrow(run, schema)


def _with_paths(tiers: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The blocks of the lowest tier with the paths of their roots. tops: paths of the trees' own roots."""

    def below(row: dict, i: int, digest: bytes, turns: str, path: bytes) -> dict:
        return {"key": row["key"], "block": (row["block"] << height) + i, "turns": turns, "siblings": path, "subroot": row["subroot"], "top": row["top"]}

    out = None
    for tier in reversed(tiers):
        last = tier.where(f"total <= {1 << height}").join(tops, ["key", "block"])
        out = last if out is None else last.unionByName(tier.where(f"total > {1 << height}").join(_each_leaf(out, PATH, below), ["key", "block"]))
    return out


def prove(manifest: Manifest, height: int = LEVELS) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root of every leaf (PROOF), as hexadecimal text.

    The proof is the siblings from the leaf to the root of its group, and on to that of all groups; its digest is given, and the
    root that it gives with the leaf's claim, or with the leaf where there is no claim.
    """

    def group(row: dict, i: int, digest: bytes, turns: str, path: bytes) -> dict:
        return {"key": row["claims"][i].decode(), "block": 0, "turns": turns, "siblings": path, "subroot": digest, "top": row["top"]}

    def proof(row: dict, i: int, digest: bytes, turns: str, path: bytes) -> dict:
        root = folded(row["claims"][i] or digest, turns, path)
        return {"id": row["ids"][i], "leaf": digest.hex(), "subroot": row["subroot"].hex(), "root": row["top"].hex(), "proof_sha256": hashlib.sha256(path.hex().encode()).hexdigest(), "folded_root": root.hex()}

    root = manifest.top[-1].select("key", "block", F.lit("").alias("turns"), F.lit(b"").alias("siblings"), F.lit(None).cast("binary").alias("subroot"), F.col("root").alias("top"))
    tops = written(_each_leaf(_with_paths(manifest.top, root, height), PATH, group), "paths")
    return _each_leaf(_with_paths(manifest.groups, tops, height), PROOF, proof)


def field(column: Column) -> Column:
    """A value as it is hashed: its length in bytes, a colon and itself; null: a hyphen."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def manifest_of(rows: DataFrame, columns: tuple[str, ...], group: str, id_col: str, claim: dict[str, Column] | None = None, claimed: Column | None = None, height: int = LEVELS) -> Manifest:
    """The manifest of a table: a leaf for each row, from ``columns`` in their order; a tree for each value of ``group``.

    Where ``claimed`` holds, ``claim`` replaces columns, and the row's proof is held against the digest of that.

    Nulls: a null is hashed as a hyphen; rows whose group is null are a group, the first one; null ids come first, a null id
    or value of ``claimed`` makes no claim.  Empty texts are hashed as such, very long ones whole.  Ties: rows of one id come by their digests; rows that
    repeat have a leaf each.  No rows: no blocks and no proofs.  Other columns are ignored.
    """
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    tampered = F.when(claimed, row_digest([(claim or {}).get(c, F.col(c)) for c in columns])) if claimed is not None else F.lit(None).cast("binary")
    leaves = rows.select(key.alias("key"), F.col(id_col).cast("long").alias("id"), row_digest([F.col(c) for c in columns]).alias("digest"), tampered.alias("claim"))
    return build_manifest(leaves, height)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its leaf, roots and proof, verified against claims that add 1 to n_chars where 7 divides the id's crc32."""
    rows = documents(spark, sf_dir)
    claimed = F.when(F.col("doc_id").isNotNull(), id_hash() % 7 == 0)
    proofs = prove(manifest_of(rows, ("doc_id", "source", "lang", "n_chars", "text"), "lang", "doc_id", {"n_chars": F.col("n_chars") + 1}, claimed))
    return proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELDS = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")]
_TAMPERED = [x.replace("n_chars", "(n_chars + 1)") for x in _FIELDS]
#: crc32 of a text of ASCII, by its rule.
_CRC = "xor(list_reduce(list_transform(range(1, len({0}) + 1), lambda i: ord({0}[i])::BIGINT), lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295)"
_UP = "list_transform(range(0, (len(nodes) + 1) // 2), lambda j: sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], '')))"
_TURN = "CASE WHEN nodes[xor(i >> d, 1) + 1] IS NULL THEN 'N' WHEN (i >> d) & 1 = 1 THEN 'L' || nodes[xor(i >> d, 1) + 1] ELSE 'R' || nodes[xor(i >> d, 1) + 1] END"
ORACLE_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || lang, '') AS key, sha256({" || ".join(_FIELDS)}) AS leaf, sha256({" || ".join(_TAMPERED)}) AS changed, {_CRC.format("(doc_id::VARCHAR)")} % 7 = 0 AS claimed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM rows),
trees AS (SELECT key, 0 AS d, list(leaf ORDER BY i) AS nodes FROM leaves GROUP BY key UNION ALL SELECT key, d + 1, {_UP} FROM trees WHERE len(nodes) > 1),
subroots AS (SELECT key, nodes[1] AS subroot, row_number() OVER (ORDER BY key) - 1 AS i FROM trees WHERE len(nodes) = 1),
tops AS (SELECT 0 AS d, list(subroot ORDER BY i) AS nodes FROM subroots UNION ALL SELECT d + 1, {_UP} FROM tops WHERE len(nodes) > 1),
ways AS (SELECT key, i, list({_TURN} ORDER BY d) AS way FROM leaves JOIN trees USING (key) WHERE len(nodes) > 1 GROUP BY key, i),
more AS (SELECT key, list({_TURN} ORDER BY d) AS way FROM subroots, tops WHERE len(nodes) > 1 GROUP BY key),
proofs AS (
  SELECT doc_id, leaf, subroot, CASE WHEN claimed THEN changed ELSE leaf END AS claim, list_concat(coalesce(ways.way, []), coalesce(more.way, [])) AS way
  FROM leaves JOIN subroots USING (key) LEFT JOIN ways ON ways.key = leaves.key AND ways.i = leaves.i LEFT JOIN more ON more.key = leaves.key),
done AS (
  SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root, sha256(array_to_string(list_transform(way, lambda x: x[2:]), '')) AS proof_sha256,
         list_reduce(way, lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END), claim) AS folded_root
  FROM proofs)
SELECT *, folded_root = root AS verified FROM done
"""
