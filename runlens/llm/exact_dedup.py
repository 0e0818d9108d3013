"""Exact dedup with counting quotient filters.

Each partition builds a filter of its texts' 64-bit fingerprints: the high bits (quotient) name a block, the low bits
(remainders) are kept sorted with their counts. Blocks of the same quotient merge without loss, by merging sorted remainders and
adding counts; blocks, not rows, are shuffled. Only texts whose fingerprint counts above one go to byte verification: they are
grouped by (fingerprint, SHA-256) and a group stands only if its least and greatest text are the same bytes; otherwise the
text itself becomes part of the key.

Defined cases: null text equals the empty text; null ids are rows like others (they keep nothing if a row with an id is equal);
an empty table gives an empty result; further columns are ignored; equal ids of equal texts count as two rows of the group, both marked as kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.session import cut_lineage

#: Fingerprints that one block should hold about; blocks double with the rows.
BLOCK_ROWS = 1 << 18
BLOCK_SCHEMA = "quotient int, remainders binary, counts binary"


def merge(remainders: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct remainders with the sum of their counts."""
    order = np.argsort(remainders, kind="stable")
    r, c = remainders[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
    return r[first], np.add.reduceat(c, first) if len(r) else c


def build_filters(bits: int, flush: int = 1 << 20):
    """Task: fingerprints -> filter blocks. Every `flush` rows the blocks so far are emitted, so memory is bounded."""

    def blocks(fp: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        fp, n = merge(fp, n)
        low = np.uint64(64 - bits)
        q = (fp >> low).astype(np.int64) if bits else np.zeros(len(fp), np.int64)
        cut = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])).tolist() + [len(fp)]
        rem = fp & np.uint64((1 << (64 - bits)) - 1)
        parts = [(int(q[a]), rem[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], names=["quotient", "remainders", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            rows += b.num_rows
            if rows >= flush:
                fp = np.concatenate(held)
                yield blocks(fp, np.ones(len(fp), np.int64))
                held, rows = [], 0
        if rows:
            fp = np.concatenate(held)
            yield blocks(fp, np.ones(len(fp), np.int64))

    return run


def merge_filters(bits: int):
    """Task: the blocks of one quotient from all partitions -> fingerprints that count above one."""

    def run(table: pa.Table) -> pa.Table:
        q = np.uint64(table.column("quotient")[0].as_py())
        r = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("remainders")])
        c = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("counts")])
        r, c = merge(r, c)
        many = c > 1
        fp = r[many] | (q << np.uint64(64 - bits)) if bits else r[many]
        return pa.table({"fp": pa.array(fp.view(np.int64)), "n": pa.array(c[many])})

    return run


def repeated_fingerprints(rows: DataFrame, fp: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(fp, n) for the values of the long column `fp` that occur more than once."""
    total = rows.count()
    bits = max(0, min(30, (max(total, 1) // block_rows).bit_length()))
    filters = rows.select(fp).mapInArrow(build_filters(bits), BLOCK_SCHEMA)
    return filters.groupBy("quotient").applyInArrow(merge_filters(bits), "fp long, n long")


def exact_groups(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id (largest doc_id of equal texts), group_size, kept, text_sha256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("fp"), F.sha2(text, 256).alias("text_sha256"))
    many = cut_lineage(repeated_fingerprints(keyed, "fp", block_rows).select("fp"), "repeated-fingerprints")
    routed = keyed.join(many, "fp", "left_semi")
    verified = cut_lineage(
        routed.groupBy("fp", "text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.min("text").alias("lo"), F.max("text").alias("hi"))
        .select("fp", "text_sha256", "keep_id", "group_size", (F.col("lo") == F.col("hi")).alias("same")),
        "verified-groups",
    )
    same, mixed = verified.where("same").drop("same"), verified.where("not same").select("fp", "text_sha256")
    narrow = keyed.select("doc_id", "fp", "text_sha256").join(same, ["fp", "text_sha256"], "left")
    sound = narrow.select("doc_id", "text_sha256", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    if mixed.isEmpty():
        out = sound
    else:  # different texts under one fingerprint and one SHA-256: compare the texts themselves
        rest = keyed.join(mixed, ["fp", "text_sha256"], "left_semi")
        by_text = rest.groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        again = rest.join(by_text, ["fp", "text"]).select("doc_id", "text_sha256", "keep_id", "group_size")
        out = narrow.join(mixed, ["fp", "text_sha256"], "left_anti").select("doc_id", "text_sha256", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size")).unionByName(again)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat an id with its text, one stays."""
    groups = cut_lineage(exact_groups(docs, block_rows).select("doc_id", "kept", "text_sha256"), "exact-groups")
    gone = cut_lineage(groups.where("not kept").select("doc_id"), "rejected")  # of a size that Spark knows
    stays = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = groups.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return stays
    return stays.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(stays.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))
