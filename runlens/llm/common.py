"""Helpers shared by the operators: texts as byte arrays inside tasks, word hashes, samples, written tables.

Python tasks take Arrow batches and work on the UTF-8 bytes of whole texts with numpy, in chunks of `CHUNK_BYTES` (a longer
text is a chunk of its own). A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
BATCH_ROWS = 1000
#: Hash slots by which tokens are counted where an order from rare to frequent ones is wanted.
SLOTS = 1 << 16
SLOT_BLOCK = 1 << 10

_MULT = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}

#: Bytes that end a word: blank and the ASCII control characters tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words made of letters and digits; bytes from 0x80 belong to letters outside ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LETTER = WORD.copy()
LETTER[0x30:0x3A] = False
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 32


def bound_batches(df: DataFrame) -> DataFrame:
    """`df`, with Arrow batches of `BATCH_ROWS` rows where the session has Spark's default: texts are long, workers are small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key, "10000") == "10000":
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def sampled(df: DataFrame, key: str, rate: Column | float) -> DataFrame:
    """Rows whose hashed key falls below `rate`: the same rows each time, whatever the partitioning."""
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < F.lit(rate) * (1 << 30))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): texts joined with one blank after each; text i is bytes[offsets[i]:offsets[i + 1] - 1]."""
    for batch in batches:
        col = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
        n = len(col)
        if not n:
            continue
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
            part = offs[i : j + 1] - offs[i]
            new = part + np.arange(j - i + 1)
            out = np.full(int(new[-1]), 0x20, np.uint8)
            mask = np.ones(len(out), bool)
            mask[new[1:] - 1] = False
            out[mask] = data[offs[i] : offs[j]]
            yield batch.slice(i, j - i), out, new
            i = j


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the accented capitals of Latin-1; other letters stay."""
    out = ASCII_LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 32
    return out


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of bytes for which `inside` holds; `data` as chunks() gives it."""
    k = inside[data]
    edge = np.flatnonzero(k[1:] != k[:-1]) + 1
    if len(k) and k[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.concatenate([edge, [len(k)]])
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes:
    """64-bit hashes of any byte ranges of one chunk, from prefix sums of byte values times powers of an odd number."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(_POWERS.get("up", ())) < n:
            inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
            for name, base in (("up", _MULT), ("down", inverse)):
                p = np.full(max(n, CHUNK_BYTES + (1 << 18)), base, np.uint64)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_TABLE[data] * _POWERS["up"][: n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _POWERS["down"][starts] + (ends - starts).astype(np.uint64))


def windows(h: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of every run of `width` words of one text."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = mix(out + h[at + k])
    return at, out


def char_positions(data: np.ndarray, offs: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Code points before the byte positions `at` within their texts."""
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return before[at] - before[offs[doc]]


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column: consecutive runs of `values` of the given lengths."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), values)


def slot_blocks(counts: np.ndarray) -> pa.RecordBatch:
    """Counts of the hash slots as rows (block, counts)."""
    blocks = counts.reshape(-1, SLOT_BLOCK)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), binary([b.tobytes() for b in blocks])], names=["block", "counts"])


def _add_task(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
    return pa.table({"block": table.column("block").slice(0, 1).combine_chunks(), "counts": binary([total.tobytes()])})


def slot_ranks(blocks: DataFrame) -> np.ndarray:
    """Rank of each hash slot by the number of tokens in it: SLOTS numbers, whatever the corpus."""
    rows = blocks.groupBy("block").applyInArrow(_add_task, "block int, counts binary").collect()
    counts = np.zeros(SLOTS, np.int64)
    for r in rows:
        counts[r["block"] * SLOT_BLOCK : (r["block"] + 1) * SLOT_BLOCK] = np.frombuffer(r["counts"], np.int64)
    ranks = np.zeros(SLOTS, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(SLOTS, dtype=np.uint64)
    return ranks


def rarity_keys(h: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The rank of a hash's slot in the high bits, the rest of the hash below: small keys are rare tokens, no two hashes share one."""
    return ranks[(h & np.uint64(SLOTS - 1)).astype(np.int64)] << np.uint64(48) | h >> np.uint64(16)


def near_by_place(percent: int) -> Column:
    """The length filter, and the positional filter for the first common token: what follows it on either side bounds the overlap.

    `place_x` and `place_y` hold a set's size above its 32 low bits and the token's position in them."""
    n = lambda x: F.shiftright(f"place_{x}", 32)
    after = lambda x: n(x) - F.col(f"place_{x}").bitwiseAND(0xFFFFFFFF) - 1
    lengths = 100 * F.least(n("x"), n("y")) >= percent * F.greatest(n("x"), n("y"))
    return lengths & ((100 + percent) * (1 + F.least(after("x"), after("y"))) >= percent * (n("x") + n("y")))
