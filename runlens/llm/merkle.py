"""Merkle manifest of a table: one tree per group, one tree over the groups' roots, and a membership proof for every row.

* Leaves are hashed by built-in functions and put in order by a range shuffle of narrow rows. A task numbers its rows as it
  reads them; one row per partition says where the numbering of a tree that spans partitions goes on.
* Trees grow in rounds: a task hashes a block of `BLOCK` neighbouring nodes up `LOG_BLOCK` levels and hands its top to the next
  round, so a table of n rows takes log(n) / `LOG_BLOCK` rounds and no task holds more than one block.
* Proofs come from pointer jumping. Each node starts with the segment towards its parent: its sibling, or nothing. A round joins each
  node with the ancestor its segment reaches and appends that ancestor's segment, which doubles the distance. Only levels that the
  next round still points to are kept, so the ancestors' side shrinks fast, and log2(height) rounds reach the root. A last join
  appends the segments of the tree over the roots. A node high up is repeated for slabs of the leaves below it, so no join key is hot.
* Each round is written to the shared folder, so a lost executor costs one round.

A hash is the lowercase hex SHA-256 of its inputs put together, hashes as hex text. Every two consecutive nodes of a level have a
parent; the last one may have a single child. Inside the tables hashes travel as 32 bytes.

Defined cases: a null field is `-`; a null group is a tree of its own, before all others; groups go in the order of their UTF-8 bytes;
null keys come first; rows with the same key go by their leaf; repeated rows are leaves of their own; an empty table has no
rows and no root; further columns are not part of a leaf unless they are named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.session import cut_lineage

LOG_BLOCK = 10
#: Joins with an ancestor of more leaves go by slabs of 2^LOG_SLAB of them, so the rows below one node don't gather.
LOG_SLAB = 12
BLOCK = 1 << LOG_BLOCK
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE, TOP, ROOT = 0, 1, 2


def leaf_hash(values: list[Column]) -> Column:
    """The hash of one row: `-` for null, else the value's length in bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the partition and each row's place among its tree's rows here; rows come in order."""
    part, tree, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1])
        k = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
        if batch.column(0)[0].as_py() == tree:
            k[: starts[1] if len(starts) > 1 else None] += seen
        tree, seen = batch.column(0)[batch.num_rows - 1].as_py(), int(k[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(k)], names=[*batch.schema.names, "part", "k"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (tree, ...) with `pos`, the place of each in its tree by `order`; written once.

    Only one row per partition goes to the driver. Rows alike in everything may be split at any place, so none of them gathers.
    """
    spark, names = rows.sparkSession, ["tree", *[c for c in rows.columns if c != "tree"]]
    ranged = rows.select(*names, F.monotonically_increasing_id().alias("salt_")).repartitionByRange("tree", *order, "salt_")
    placed = cut_lineage(ranged.sortWithinPartitions("tree", *order).select(*names).mapInArrow(_place, _ddl(rows, names) + ", part int, k long"), "merkle-leaves")
    ends = placed.groupBy("part", "tree").agg(F.count("*").alias("n")).groupBy("part").agg(F.min(F.struct("tree", "n")).alias("first"), F.max(F.struct("tree", "n")).alias("last"))
    starts, tree, held = [], None, 0
    for part, first, last in sorted(ends.collect()):
        start = held if first.tree == tree else 0
        starts.append((part, first.tree, start))
        tree, held = last.tree, last.n + (start if first.tree == last.tree else 0)
    at = F.broadcast(spark.createDataFrame(starts, "part int, first_ string, start_ long"))  # one row per partition
    return placed.join(at, "part").select(*names, (F.col("k") + F.when(F.col("tree") == F.col("first_"), F.col("start_")).otherwise(0)).alias("pos"))


def _grow(payload: list[str], level: int):
    """A task of one round: all nodes of a block below its top, with their siblings; the block's top, or the root of its tree."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["pos"].to_numpy(), kind="stable")))
        tree, first = key[0].as_py(), key[1].as_py() << LOG_BLOCK
        now = [h.hex().encode() for h in table["hash"].to_pylist()]
        whole = first == 0 and len(now) < BLOCK  # the only block of its tree
        kinds, levels, places, hashes, siblings = [], [], [], [], []

        def add(kind: int, up: int, pos: int, h: bytes | None, segment: list[bytes]) -> None:
            kinds.append(kind)
            levels.append(level + up)
            places.append(pos)
            hashes.append(h)
            siblings.append(segment)

        up = 0
        while (len(now) > 1) if whole else (up < LOG_BLOCK):
            raw = [bytes.fromhex(h.decode()) for h in now]
            for i in range(len(now)):
                add(NODE, up, (first >> up) + i, None, [raw[i ^ 1] if i ^ 1 < len(now) else b""])
            now = [hashlib.sha256(b"".join(now[i : i + 2])).hexdigest().encode() for i in range(0, len(now), 2)]
            up += 1
        if whole and up == 0 and level == 0:
            add(NODE, 0, 0, None, [])  # a lone leaf is its own root
        add(ROOT if whole else TOP, up, first >> up, bytes.fromhex(now[0].decode()), [])
        own = table.num_rows if level == 0 else 0
        cols = [pa.array([tree] * len(kinds)), pa.array(kinds, pa.int32()), pa.array(levels, pa.int32()), pa.array(places, pa.int64()), pa.array(hashes, pa.binary()), pa.array(siblings, pa.list_(pa.binary()))]
        for name in payload:
            col = table[name].combine_chunks()
            cols.append(pa.concat_arrays([col.slice(0, own), pa.nulls(len(kinds) - own, col.type)]))
        return pa.Table.from_arrays(cols, names=["tree", "kind", "level", "pos", "hash", "siblings", *payload])

    return run


def forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots) of the trees over `leaves` (tree, pos, hash, payload ...); leaves keep their payload.

    nodes: tree, level, pos, siblings (none or one; empty where there is none), payload. roots: tree, height, hash.
    """
    payload = [c for c in leaves.columns if c not in ("tree", "pos", "hash")]
    kinds, names = _ddl(leaves, payload), ["tree", "pos", "hash", *payload]
    nodes, roots, level, rows = [], [], 0, leaves
    while True:
        groups = rows.select(*names, F.shiftright("pos", LOG_BLOCK).alias("block")).groupBy("tree", "block")
        schema = "tree string, kind int, level int, pos long, hash binary, siblings array<binary>" + (", " + kinds if payload else "")
        made = cut_lineage(groups.applyInArrow(_grow(payload, level), schema), "merkle-nodes")
        nodes.append(made.filter(F.col("kind") == NODE).drop("kind", "hash"))
        roots.append(made.filter(F.col("kind") == ROOT).select("tree", F.col("level").alias("height"), "hash"))
        rows = made.filter(F.col("kind") == TOP)
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, roots)
        level += LOG_BLOCK


def jump(nodes: DataFrame) -> DataFrame:
    """The leaves with all siblings up to their root, by doubling: after r rounds a segment spans 2^r levels."""
    payload = [c for c in nodes.columns if c not in ("tree", "level", "pos", "siblings")]
    height = 1 + (nodes.agg(F.max("level")).first()[0] or 0)
    span = 1
    while span < height:
        step = F.col("level") % (2 * span)
        slab = min(span, LOG_SLAB)
        low = nodes.filter(step == 0).withColumn("slab", F.shiftright("pos", slab))
        first = F.shiftleft("pos", span - slab)
        slabs = F.explode(F.sequence(first, first + (1 << (span - slab)) - 1)) if slab < span else F.col("pos")
        high = nodes.filter(step == span).select("tree", (F.col("level") - span).alias("level"), slabs.alias("slab"), F.col("siblings").alias("more"))
        joined = low.join(high, ["tree", "level", "slab"], "left")
        siblings = F.when(F.col("more").isNull(), F.col("siblings")).otherwise(F.concat("siblings", "more"))
        span *= 2
        nodes = joined.select("tree", "level", "pos", siblings.alias("siblings"), *payload)
        if span < height:
            nodes = cut_lineage(nodes, "merkle-segments")
    return nodes.filter(F.col("level") == 0).drop("level")


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, forged: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: key, leaf, forged, subroot, root, pos, top_pos, height, siblings (32-byte hashes towards the root).

    `forged` names fields and what an attacker makes of them; the leaf of the forged row is returned beside the true one (null without it).
    """
    forged = forged or {}
    tree = F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("n"))
    fake = F.unhex(leaf_hash([forged.get(f, F.col(f)) for f in fields])) if forged else F.lit(None).cast("binary")
    leaves = rows.select(tree.alias("tree"), F.col(key).alias("key"), F.unhex(leaf_hash([F.col(f) for f in fields])).alias("hash"), fake.alias("forged"))
    leaves = leaves.withColumn("forged", F.nullif("forged", "hash"))
    nodes, roots = forest(numbered(leaves, ["key", "hash"]).withColumn("leaf", F.col("hash")))
    tops = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash", "height")
    top_nodes, top_roots = forest(numbered(tops, ["name"]).withColumn("subroot", F.col("hash")))
    root = [r.hash for r in top_roots.collect()]  # one row, or none
    slabs = F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), F.greatest(F.col("height") - LOG_SLAB, F.lit(0))).cast("long") - 1))
    above = jump(top_nodes).select(F.col("name").alias("tree"), slabs.alias("slab"), F.col("pos").alias("top_pos"), "subroot", F.col("siblings").alias("more"))
    out = jump(nodes).withColumn("slab", F.shiftright("pos", LOG_SLAB)).join(above, ["tree", "slab"])
    return out.select(
        F.col("key").alias(key), "leaf", "forged", "subroot", F.lit(bytes(root[0]) if root else None).cast("binary").alias("root"), "pos", "top_pos",
        F.size("siblings").alias("height"), F.concat("siblings", "more").alias("siblings"))


def text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def fold(leaf: Column, siblings: Column, pos: Column, height: Column, top_pos: Column) -> Column:
    """The root that a leaf (hex text) and its siblings lead to; the bits of both places say on which side a sibling stands."""
    steps = F.transform(siblings, lambda x, i: F.struct(text(x).alias("x"), F.when(i < height, F.getbit(pos, i)).otherwise(F.getbit(top_pos, F.greatest(i - height, F.lit(0)))).alias("right")))
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.when(s.right == 1, F.concat(s.x, acc)).otherwise(F.concat(acc, s.x)).cast("binary"), 256))


def verify(proofs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of what `manifest` gives, and the root recomputed from the forged leaf where there is one: verified if it is the true root."""
    start = text(F.coalesce("forged", "leaf"))
    shown = proofs.select(
        key, text(F.col("leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"), text(F.col("root")).alias("root"),
        F.sha2(F.array_join(F.transform("siblings", text), "").cast("binary"), 256).alias("proof_sha256"),
        fold(start, F.col("siblings"), F.col("pos"), F.col("height"), F.col("top_pos")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
