"""Merkle manifest of a dataset, and multiproofs of many of its leaves at once (operator 11).

A leaf is the digest of a row's fields. Leaves ascend within a group (a language) and form its binary tree;
the groups' subroots, in the groups' order, form the tree on top (tree -1). The tree is built bottom up in
blocks of 2^BLOCK nodes, each of them a task's group, so that a group of any size takes a round more for
each BLOCK levels.

Proofs are made by partitions of leaves (what is asked for of one block). A partition walks up from its
leaves and notes, level by level, the siblings that it neither holds nor can derive: the smallest set of node
coordinates that proves all its leaves. It fetches these once, derives the nodes that its leaves share, and
expands each leaf's own proof from what it then holds. Nodes that cover much of the dataset, of which there
are few by their span, are sent to every task; all others are joined by coordinate.

Edge cases: a null field counts as `-`; rows without a group form the first group; rows without doc_id
come first in theirs; rows of one doc_id are ordered by their digests, so that repeated rows are leaves of their
own with equal digests; an empty table has neither nodes nor root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm import storage

#: Levels that a block's task builds, and the leaves of a partition that makes proofs: 2^BLOCK.
BLOCK = 10
#: A node goes to every task if its parent spans this part of all leaves: at most 2 * SHARED nodes a level.
SHARED = 512
#: Rows of small tables that may be broadcast.
FEW = 1 << 17
TOP = -1
NODE = "tree long, level int, i long, n long, hash string"


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def document_leaf(n_chars: Column | None = None) -> Column:
    """The digest of a document; n_chars: in place of the column."""
    return digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") if n_chars is None else n_chars, F.col("text"))


def height(n: int) -> int:
    """Levels above n leaves."""
    return max(0, int(n) - 1).bit_length()


def _height(n: str) -> Column:
    return F.when(F.col(n) <= 1, 0).otherwise(F.length(F.bin(F.col(n) - 1)))


@dataclass
class Manifest:
    """leaves: rows with their place (tree, i; n: leaves of the tree). nodes: all nodes above the leaves, and the leaves of tree -1.
    subroots: tree, group, n, hash. root: None where there are no rows."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    trees: int
    rows: int
    root: str | None


def _placed(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with _part and _at, sorted by ranges of (group, order), and a row (group, _part, _n, _first, _before) for each part of a group.

    A row's place in its group is _before + _at - _first. A group may hold most rows, so it is never gathered: its parts' counts are summed.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = storage.written(ranged.withColumn("_part", F.shiftright("_at", 33)), "ranged")
    part = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return ranged, part.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def _join(left: DataFrame, right: DataFrame, rows: int, *names: str) -> DataFrame:
    """left with right's columns, by names equal or null alike; rows: of right."""
    right = _small(right.withColumnsRenamed({c: f"_r_{c}" for c in names}), rows)
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names]
    return left.join(right, on).drop(*(f"_r_{c}" for c in names))


def _up(hashes: list[str]) -> list[str]:
    return [hashlib.sha256("".join(hashes[k : k + 2]).encode()).hexdigest() for k in range(0, len(hashes), 2)]


def _grown(level: DataFrame, at: int) -> DataFrame:
    """The nodes of up to BLOCK levels above `level` (tree, i, n, hash)."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("i").to_numpy(), kind="stable")
        own, n = table.column("hash").take(pa.array(order)).to_pylist(), table.column("n")[0].as_py()
        first, out = int(table.column("i").to_numpy().min()), []
        for k in range(at + 1, at + BLOCK + 1):
            if k > height(n):
                break
            own, first = _up(own), first >> 1
            out.append((k, first, own))
        sizes = [len(x) for _, _, x in out]
        total = sum(sizes)
        return pa.table({
            "tree": pa.array(np.full(total, key[0].as_py()), pa.int64()),
            "level": pa.array(np.repeat([k for k, _, _ in out], sizes), pa.int32()) if out else pa.array([], pa.int32()),
            "i": pa.array(np.concatenate([np.arange(f, f + len(x)) for _, f, x in out]) if out else [], pa.int64()),
            "n": pa.array(np.full(total, n), pa.int64()),
            "hash": pa.array([h for _, _, x in out for h in x], pa.string()),
        })

    return level.withColumn("block", F.shiftright("i", BLOCK)).groupBy("tree", "block").applyInArrow(build, NODE)


def _tree(leaves: DataFrame, most: int) -> DataFrame:
    """All nodes above leaves (tree, i, n, hash), of which a tree has up to `most`."""
    level, out = leaves.select("tree", "i", "n", "hash"), []
    for at in range(0, max(1, height(most)), BLOCK):
        out.append(storage.written(_grown(level, at), "nodes"))
        level = out[-1].where((F.col("level") == at + BLOCK) & (_height("n") > at + BLOCK)).select("tree", "i", "n", "hash")
    nodes = out[0]
    for more in out[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def manifest(rows: DataFrame, group: str, order: str, leaf: str = "leaf") -> Manifest:
    """The manifest of rows with a digest `leaf`: a tree for each `group`, its leaves by `order`, then digest. Other columns stay with the leaves."""
    ranged, parts = _placed(rows, [group], [order, leaf])
    parts = storage.written(parts, "parts")
    groups, places = _placed(parts.groupBy(group).agg(F.sum("_n").alias("n")), [], [group])
    trees = storage.written(groups.join(F.broadcast(places), "_part").select(group, "n", (F.col("_before") + F.col("_at") - F.col("_first")).alias("tree")), "trees")
    count, most, total = trees.agg(F.count("*"), F.max("n"), F.sum("n")).first()
    parts = _join(parts, trees, count, group)
    leaves = _join(ranged, parts, parts.count(), group, "_part").withColumn("i", F.col("_before") + F.col("_at") - F.col("_first"))
    leaves = storage.written(leaves.select("tree", "i", "n", *rows.columns), "leaves")
    nodes = _tree(leaves.withColumn("hash", F.col(leaf)), most or 0)
    ends = leaves.where("n = 1").select("tree", F.col(leaf).alias("hash")).unionByName(nodes.where(F.col("level") == _height("n")).select("tree", "hash"))
    subroots = storage.written(_join(trees, ends, count, "tree"), "subroots")
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(count).cast("long").alias("n"), "hash")
    above = _tree(top, count)
    nodes = nodes.unionByName(top.withColumn("level", F.lit(0))).unionByName(above)
    root = (above if count > 1 else top.withColumn("level", F.lit(0))).where(F.col("level") == height(count)).first()
    return Manifest(leaves, nodes, subroots, count, total or 0, root and root["hash"])


def missing(asked: np.ndarray, n: int) -> list[np.ndarray]:
    """For each level of a tree of n leaves, the nodes that a proof of the leaves `asked` needs beside those it derives from them."""
    known, out = np.unique(asked), []
    for level in range(height(n)):
        beside = known ^ 1
        out.append(np.setdiff1d(beside[beside < -(-n >> level)], known))
        known = np.unique(known >> 1)
    return out


def requests(held: Manifest, asked: DataFrame) -> DataFrame:
    """tree and block of each partition of leaves, and coordinates (at, level, i) of the nodes that it must fetch."""
    trees = held.trees

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        own = missing(table.column("i").to_numpy(), table.column("n")[0].as_py())
        top = missing(np.array([tree]), trees)
        sizes = [len(x) for x in (*own, *top)]
        at = np.repeat([tree] * len(own) + [TOP] * len(top), sizes) if sizes else []
        level = np.repeat([*range(len(own)), *range(len(top))], sizes) if sizes else []
        total = int(sum(sizes))
        return pa.table({"tree": pa.array([tree] * total, pa.int64()), "block": pa.array([block] * total, pa.int64()), "at": pa.array(at, pa.int64()), "level": pa.array(level, pa.int32()), "i": pa.array(np.concatenate([*own, *top]) if total else [], pa.int64())})

    return asked.select("tree", F.shiftright("i", BLOCK).alias("block"), "i", "n").groupBy("tree", "block").applyInArrow(walk, "tree long, block long, at long, level int, i long")


def _fetched(held: Manifest, wanted: DataFrame, leaf: str) -> DataFrame:
    """wanted with the hash of each coordinate."""
    span = F.least(F.col("n"), F.expr("shiftleft(1L, level + 1)"))
    span = F.when(F.col("tree") == TOP, span * (held.rows / max(1, held.trees))).otherwise(span)  # on average
    wide = span >= max(2, held.rows / SHARED)
    coordinate = ["at", "level", "i"]
    nodes = held.nodes.where("tree >= 0 OR level < %d" % max(1, height(held.trees))).select(F.col("tree").alias("at"), "level", "i", "hash", wide.alias("wide"))
    nodes = nodes.unionByName(held.leaves.select(F.col("tree").alias("at"), F.lit(0).alias("level"), "i", F.col(leaf).alias("hash"), wide_leaf(held).alias("wide")))
    shared = storage.written(nodes.where("wide").drop("wide"), "shared")
    few = shared.count()
    out = wanted.join(_small(shared, few), coordinate, "left")
    near, far = out.where("hash IS NOT NULL"), out.where("hash IS NULL").drop("hash")
    return near.unionByName(far.join(nodes.where("NOT wide").drop("wide").hint("merge"), coordinate).select(*near.columns))


def wide_leaf(held: Manifest) -> Column:
    return F.least(F.col("n"), F.lit(2)) >= max(2, held.rows / SHARED)


def proofs(held: Manifest, asked: DataFrame | None = None, leaf: str = "leaf", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Leaf, subroot and proof of every leaf of `asked` (rows of held.leaves; None: all of them).

    proof: an entry for each level, from the leaf by way of the subroot to the root: the sibling's hash (null for a node that has none) and whether
    it stands to the left.
    """
    asked = held.leaves if asked is None else asked
    wanted = storage.written(requests(held, asked), "requests")
    found = _fetched(held, wanted, leaf)
    trees = held.trees
    schema = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in carry) + f", {leaf} string, subroot string, proof array<struct<hash:string,left:boolean>>"
    kinds = {c: t for c, t in zip(carry, (f.type for f in _arrow(asked.select(*carry))), strict=True)}

    def expand(key: tuple, own: pa.Table, fetched: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        i, n = own.column("i").to_numpy(), own.column("n")[0].as_py() if own.num_rows else 0
        given: dict[tuple[int, int], list[tuple[int, str]]] = {}
        for at, level, place, value in zip(*(fetched.column(c).to_pylist() for c in ("at", "level", "i", "hash")), strict=True):
            given.setdefault((at, level), []).append((place, value))
        store: list[str] = []
        columns: list[np.ndarray] = []  # for each level, where in `store` each row's sibling is; -1: none
        sides: list[np.ndarray] = []
        known = dict(zip(i.tolist(), own.column(leaf).to_pylist(), strict=True))
        subroot = None
        for at, leaves, place in ((tree, n, i), (TOP, trees, np.full(len(i), tree))):
            for level in range(height(leaves)):
                known.update(given.get((at, level), ()))
                where = np.array(sorted(known), np.int64)
                base = len(store)
                store += [known[k] for k in where.tolist()]
                beside = (place >> level) ^ 1
                columns.append(np.where(beside < -(-leaves >> level), base + np.searchsorted(where, beside), -1))
                sides.append(beside & 1 == 0)
                known = {k >> 1: hashlib.sha256((known[k] + known.get(k + 1, "")).encode()).hexdigest() for k in where.tolist() if k % 2 == 0 and (k + 1 in known or k + 1 >= -(-leaves >> level))}
            if at == tree:
                subroot = known[0]
                known = {tree: subroot}
        depth, rows = len(columns), own.num_rows
        take = np.stack(columns, 1).ravel() if depth else np.zeros(0, np.int64)
        hashes = pa.array(store, pa.string()).take(pa.array(np.maximum(take, 0), mask=take < 0))
        left = pa.array(np.stack(sides, 1).ravel() if depth else [], pa.bool_())
        entries = pa.StructArray.from_arrays([hashes, left], ["hash", "left"])
        proof = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * depth, pa.int32()), entries)
        return pa.table({**{c: own.column(c).cast(kinds[c]) for c in carry}, leaf: own.column(leaf), "subroot": pa.array([subroot] * rows, pa.string()), "proof": proof})

    left = asked.withColumn("block", F.shiftright("i", BLOCK)).groupBy("tree", "block")
    return left.cogroup(found.groupBy("tree", "block")).applyInArrow(expand, schema)


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.when(s.getField("hash").isNull(), h).when(s.getField("left"), F.concat(s.getField("hash"), h)).otherwise(F.concat(h, s.getField("hash"))), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select(F.col("doc_id").cast("long"), "source", "lang", F.col("n_chars").cast("long"), "text")
    more = document_leaf(F.col("n_chars").cast("decimal(20,0)") + 1)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = docs.select("lang", "doc_id", document_leaf().alias("leaf"), F.when(chosen & F.col("n_chars").isNotNull(), more).alias("tampered"))
    held = manifest(rows, "lang", "doc_id")
    out = proofs(held, carry=("doc_id", "tampered"))
    hashes = F.transform("proof", lambda s: F.coalesce(s.getField("hash"), F.lit("")))
    out = out.select("doc_id", "leaf", "subroot", F.lit(held.root).cast("string").alias("root"), F.sha2(F.concat_ws("", hashes), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
