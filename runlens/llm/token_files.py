"""Token ids of a corpus in compressed files: static range asymmetric numeral systems over shared frequencies.

Writing. Documents are put in ascending order by a range shuffle and tokenised; the ids are written once, in order. Their counts over
the whole corpus, scaled to a sum of 2^`SCALE_BITS`, are the one frequency table all blocks share. A second pass cuts each run of ids into
blocks of `BLOCK_TOKENS` and codes every block on its own: token i belongs to lane i mod `LANES`, all lanes share one stream of
32-bit words, and every `CHECKPOINT_ROWS` rows the lanes' states and the place in the stream are kept. A block so has segments that can be
decoded apart from each other, each with a checksum; the block has one over its ids.

Reading. A task decodes the segments of several blocks side by side. Blocks list the documents they hold with their places in the run, so
each block gives its pieces without the others; a document cut by a block's end comes together by xor, as the checksum
of a piece can be moved past the ids that follow it.

Files: `blocks` holds one row per block (a Parquet file is written as a whole or not at all, on any store), `frequencies` one row per id. A
file lists runs in ascending order; `part` and `run` say where a run stands in the corpus. Memory in a task is a few blocks and one text.
The driver holds the frequency table (at most the vocabulary) and one row per run.

Defined cases: null text is empty and gives the end id alone; null ids come first; rows with the same id go by a hash of their text (null as empty), then by the text; repeated rows are
written as often as they occur; special-token strings in a text give their ids; an empty table gives files without rows and reads
as one; further columns are ignored. A damaged block, or one read with another table, raises ValueError.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import common
from runlens.llm.packing import TextEncoder, WordEncoder
from runlens.session import cut_lineage

LANES, ROWS, CHECKPOINT_ROWS = 128, 512, 128
BLOCK_TOKENS = LANES * ROWS
SCALE_BITS = 20
#: Blocks coded side by side.
TOGETHER = 16
END_ID = 1
MAGIC = b"rAN1"
HEADER = struct.Struct("<4sHHIIII")
LOW, WORD_BITS = np.uint64(1 << 31), np.uint64(32)


# ---- the model ----------------------------------------------------------------------------------------------------

def scaled(counts: dict[int, int], bits: int = SCALE_BITS) -> tuple[list[int], list[int]]:
    """Ids in ascending order and their frequencies: in proportion to the counts, at least 1, 2^bits in all."""
    ids = sorted(counts)
    if not ids:
        return [], []
    if 2 * len(ids) > 1 << bits:
        raise ValueError(f"{len(ids)} different ids are too many for frequencies of {bits} bits")
    total = sum(counts.values())
    freq = [max(1, (counts[i] << bits) // total) for i in ids]
    over = sum(freq) - (1 << bits)
    if over > 0:  # rare ids were raised to 1: the others give in proportion
        spare = sum(freq) - len(freq)
        freq = [f - (f - 1) * over // spare for f in freq]
        over = sum(freq) - (1 << bits)
    k = 0
    order = sorted(range(len(ids)), key=lambda i: (-freq[i], i))
    while over > 0:  # what rounding left, one by one from the most frequent
        if freq[order[k % len(order)]] > 1:
            freq[order[k % len(order)]] -= 1
            over -= 1
        k += 1
    freq[order[0]] -= over
    return ids, freq


class Model:
    """Frequencies, their sums and the id of each slot. Ids are handled by their rank among those that occur."""

    def __init__(self, ids: list[int], freq: list[int], bits: int = SCALE_BITS):
        self.bits = bits
        self.ids = np.array(ids, np.uint32)
        self.freq = np.array(freq, np.uint64)
        self.before = np.cumsum(self.freq) - self.freq
        self.slot = np.repeat(np.arange(len(ids), dtype=np.int32), self.freq.astype(np.int64))
        self.pad = int(np.argmax(self.freq)) if len(ids) else 0
        if len(ids) and len(self.slot) != 1 << bits:
            raise ValueError("frequencies don't add up")
        self.rank = np.zeros(int(self.ids.max(initial=0)) + 1, np.int32)
        self.rank[self.ids] = np.arange(len(ids))

    def encode(self, ids: np.ndarray) -> list[bytes]:
        """The blocks of a run of ids; all but the last hold `BLOCK_TOKENS`."""
        whole = len(ids) // BLOCK_TOKENS
        out = []
        for i in range(0, whole, TOGETHER):
            some = ids[i * BLOCK_TOKENS : min(whole, i + TOGETHER) * BLOCK_TOKENS]
            out += self._encode(some, len(some) // BLOCK_TOKENS, BLOCK_TOKENS)
        rest = ids[whole * BLOCK_TOKENS :]
        return out + (self._encode(rest, 1, len(rest)) if len(rest) else [])

    def _encode(self, ids: np.ndarray, blocks: int, tokens: int) -> list[bytes]:
        rows = -(-tokens // LANES)
        ranks = np.full(blocks * rows * LANES, self.pad, np.int32)
        ranks[: len(ids)] = self.rank[ids]
        ranks = ranks.reshape(blocks, rows, LANES).transpose(1, 0, 2).reshape(rows, blocks * LANES)
        freq, before = self.freq[ranks], self.before[ranks]
        scale, limit = np.uint64(self.bits), np.uint64(63 - self.bits)
        x = np.full(blocks * LANES, LOW)
        words, used, states = np.zeros(ranks.shape, np.uint32), np.zeros(ranks.shape, bool), {}
        for r in range(rows - 1, -1, -1):
            f = freq[r]
            full = x >= f << limit
            words[r], used[r] = x.astype(np.uint32), full
            x = np.where(full, x >> WORD_BITS, x)
            q = x // f
            x = (q << scale) + (x - q * f) + before[r]
            if r % CHECKPOINT_ROWS == 0:
                states[r] = x.astype("<u8")
        out = []
        for b in range(blocks):
            own = slice(b * LANES, (b + 1) * LANES)
            head, body, n_words = [], [], 0
            for r in sorted(states):
                part = words[r : r + CHECKPOINT_ROWS, own][used[r : r + CHECKPOINT_ROWS, own]].astype("<u4").tobytes()
                state = states[r][own].tobytes()
                head.append(struct.pack("<II", n_words, zlib.crc32(part, zlib.crc32(state))) + state)
                body.append(part)
                n_words += len(part) // 4
            mine = ids[b * tokens : (b + 1) * tokens].astype("<u4")
            fields = HEADER.pack(MAGIC, LANES, CHECKPOINT_ROWS, tokens, rows, n_words, zlib.crc32(mine.tobytes()))
            out.append(b"".join([fields, *head, *body]))
        return out

    def segments(self, block: bytes) -> tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]:
        """Number of ids, their checksum, and (states, words) of each segment; a segment that fails its checksum raises ValueError."""
        if len(block) < HEADER.size:
            raise ValueError("a block is cut off")
        magic, lanes, step, tokens, rows, n_words, crc = HEADER.unpack_from(block)
        count = -(-rows // step) if step else 0
        size = 8 + 8 * lanes
        if magic != MAGIC or lanes != LANES or step != CHECKPOINT_ROWS or len(block) != HEADER.size + count * size + 4 * n_words:
            raise ValueError("not a block of this format, or cut off")
        heads = [struct.unpack_from("<II", block, HEADER.size + k * size) for k in range(count)]
        ends = [h[0] for h in heads[1:]] + [n_words]
        base, out = HEADER.size + count * size, []
        for k, ((first, check), end) in enumerate(zip(heads, ends, strict=True)):
            at = HEADER.size + k * size + 8
            part = block[base + 4 * first : base + 4 * end]
            if zlib.crc32(part, zlib.crc32(block[at : at + 8 * lanes])) != check:
                raise ValueError("a segment fails its checksum")
            out.append((np.frombuffer(block, "<u8", lanes, at), np.frombuffer(part, "<u4")))
        return tokens, crc, out

    def decode_segments(self, segments: list[tuple[np.ndarray, np.ndarray]], rows: int = CHECKPOINT_ROWS) -> np.ndarray:
        """Ids of segments, side by side: one line each, `rows` rows of all lanes. What stands behind a short segment's end has no meaning."""
        x = np.stack([s for s, _ in segments]).astype(np.uint64)
        words = np.concatenate([w for _, w in segments] + [np.zeros(LANES, np.uint32)]).astype(np.uint64)
        at = np.cumsum([0] + [len(w) for _, w in segments])[:-1].astype(np.int64)
        scale, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        out = np.zeros((rows, *x.shape), np.int32)
        last = len(words) - 1
        for r in range(rows):
            slot = x & mask
            s = self.slot[slot]
            out[r] = s
            x = self.freq[s] * (x >> scale) + slot - self.before[s]
            need = x < LOW
            place = at[:, None] + np.cumsum(need, axis=1, dtype=np.int32)
            at = place[:, -1]
            x = np.where(need, x << WORD_BITS | words[np.minimum(place - 1, last)], x)
        return self.ids[out.transpose(1, 0, 2).reshape(len(segments), -1)]

    def decode(self, blocks: list[bytes]) -> list[np.ndarray]:
        """The ids of whole blocks, held against their checksums."""
        parts = [self.segments(b) for b in blocks]
        ids = self.decode_segments([s for _, _, own in parts for s in own]) if blocks else None
        out, k = [], 0
        for tokens, crc, own in parts:
            mine = ids[k : k + len(own)].reshape(-1)[:tokens]
            k += len(own)
            if zlib.crc32(mine.astype("<u4").tobytes()) != crc:
                raise ValueError("a block's ids fail their checksum: another frequency table?")
            out.append(mine)
        return out

    def decode_range(self, block: bytes, first: int, last: int) -> np.ndarray:
        """Ids first to last (exclusive) of a block, from the segments that hold them alone."""
        size = CHECKPOINT_ROWS * LANES
        tokens, _, own = self.segments(block)
        last = min(last, tokens)
        if first >= last:
            return self.ids[:0]
        k = first // size
        return self.decode_segments(own[k : (last - 1) // size + 1]).reshape(-1)[first - k * size : last - k * size]


# ---- checksums of pieces ------------------------------------------------------------------------------------------

def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits reflected (the highest bit is x^0)."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def moved(crc: int, size: int) -> int:
    """What a piece's crc32 adds to that of a whole in which `size` bytes follow it: the whole's is the xor over its pieces."""
    power, square, n = 1 << 31, 1 << 30, 8 * size
    while n:
        if n & 1:
            power = _times(power, square)
        square = _times(square, square)
        n >>= 1
    return _times(crc, power)


# ---- writing ------------------------------------------------------------------------------------------------------

_ENCODERS: dict[str, TextEncoder] = {}
#: What the fast encoder assumes of a tokenizer file.
WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def encoder_of(path: str) -> TextEncoder:
    """The word-wise encoder where the file has the parts it assumes, else the plain one; one for each worker."""
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        _ENCODERS[path] = (WordEncoder if all(parts.get(k) == v for k, v in WORDS.items()) else TextEncoder)(path)
    return _ENCODERS[path]


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, k = encoder_of(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, tokens = [], []
            for doc_id, own in encoder.encode(batch):
                ids.append(doc_id)
                tokens.append(own.astype("<u2").tobytes() if not len(own) or int(own.max()) < 1 << 16 else b"\x01" + own.astype("<u4").tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(k, k + len(ids))), pa.array(ids, pa.int64()), common.binary(tokens)], names=["part", "k", "doc_id", "ids"])
                k += len(ids)

    return run


def _ids(raw: bytes) -> np.ndarray:
    """Two bytes an id, or an odd number of bytes: a mark and four an id."""
    return (np.frombuffer(raw, "<u4", offset=1) if len(raw) % 2 else np.frombuffer(raw, "<u2")).astype(np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often this task sees each id."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        cells = batch.column(0).to_pylist()
        short, long = b"".join(c for c in cells if not len(c) % 2), b"".join(c[1:] for c in cells if len(c) % 2)
        for part, kind in ((short, "<u2"), (long, "<u4")):
            n = np.bincount(np.frombuffer(part, kind))
            if len(n) > len(total):
                total = np.append(total, np.zeros(len(n) - len(total), np.int64))
            total[: len(n)] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["id", "n"])


BLOCKS = "part int, run long, block int, first long, n_tokens int, doc_ids array<long>, doc_starts array<long>, doc_tokens array<long>, payload binary"


def _encode_task(ids: list[int], freq: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(ids, freq)
        at, k, first, number, end = None, 0, 0, 0, 0  # the run, its next row, ids before the buffer, next block, ids so far
        held: list[np.ndarray] = []
        docs: list[tuple[int | None, int, int]] = []  # those that reach into the buffer: id, start in the run, length

        def emit(last: bool) -> pa.RecordBatch | None:
            nonlocal first, number, held, docs
            buffer = np.concatenate(held) if held else np.zeros(0, np.uint32)
            cut = len(buffer) if last else len(buffer) // BLOCK_TOKENS * BLOCK_TOKENS
            rows, begin = [], 0
            for payload in model.encode(buffer[:cut]):
                n = min(BLOCK_TOKENS, cut - begin)
                low, high = first + begin, first + begin + n
                while docs and docs[0][1] + docs[0][2] <= low:
                    docs.pop(0)
                inside = []
                for d in docs:
                    if d[1] >= high:
                        break
                    inside.append(d)
                docs = docs[len(inside) - 1 :] if inside else docs
                rows.append((at[0], at[1], number, low, n, [d[0] for d in inside], [d[1] for d in inside], [d[2] for d in inside], payload))
                begin += n
                number += 1
            first += cut
            held = [buffer[cut:]] if cut < len(buffer) else []
            if not rows:
                return None
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for part, place, doc_id, raw in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if at is None or (part, place) != (at[0], k):
                    if at is not None and (made := emit(True)) is not None:
                        yield made
                    at, first, number, end, held, docs = (part, place), 0, 0, 0, [], []
                own = _ids(raw)
                held.append(own)
                docs.append((doc_id, end, len(own)))
                end, k = end + len(own), place + 1
                if end - first >= TOGETHER * BLOCK_TOKENS and (made := emit(False)) is not None:
                    yield made
        if at is not None and (made := emit(True)) is not None:
            yield made

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Writes the token files of `docs` (doc_id, text) below `path`. `tokenizer_path` is read on the executors, where it must be installed."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash_"), F.monotonically_increasing_id().alias("salt_"))
    # rows alike in everything may be split at any place
    ranged = keyed.repartitionByRange("doc_id", "hash_", "salt_").sortWithinPartitions("doc_id", "hash_", "text").select("doc_id", "text")
    ids = cut_lineage(common.bound_batches(ranged).mapInArrow(_tokenise(tokenizer_path), "part int, k long, doc_id long, ids binary"), "token-ids")
    counts = ids.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    known, freq = scaled({r.id: r.n for r in counts})
    spark = docs.sparkSession
    spark.createDataFrame([(i, f) for i, f in zip(known, freq, strict=True)], "id long, freq long").coalesce(1).write.mode("overwrite").parquet(f"{path}/frequencies")
    ids.select("part", "k", "doc_id", "ids").mapInArrow(_encode_task(known, freq), BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")


# ---- reading ------------------------------------------------------------------------------------------------------

def load_model(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    rows = sorted(spark.read.schema("id long, freq long").parquet(f"{path}/frequencies").collect())
    return [r.id for r in rows], [r.freq for r in rows]


def _pieces(ids: list[int], freq: list[int], with_ids: bool):
    """(run, document, length, moved checksum[, ids]) of every document's part of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(ids, freq)
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(i, TOGETHER).to_pylist()
                rows = []
                for b, tokens in zip(some, model.decode([b["payload"] for b in some]), strict=True):
                    low, high = b["first"], b["first"] + b["n_tokens"]
                    if len(tokens) != b["n_tokens"]:
                        raise ValueError("a block holds another number of ids than its row says")
                    raw = tokens.astype("<u4").tobytes()
                    for doc_id, start, n in zip(b["doc_ids"], b["doc_starts"], b["doc_tokens"], strict=True):
                        a, z = max(start, low), min(start + n, high)
                        crc = zlib.crc32(raw[4 * (a - low) : 4 * (z - low)])
                        after = start + n - z
                        rows.append((b["part"], b["run"], start, doc_id, n, a - start, z - a, moved(crc, 4 * after) if after else crc, tokens[a - low : z - low] if with_ids else None))
                names = ["part", "run", "doc_start", "doc_id", "doc_tokens", "at", "length", "crc", "ids"][: 8 + with_ids]
                kinds = [pa.int32(), *[pa.int64()] * 7, pa.list_(pa.int64())]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)][: len(names)], names=names)

    return run


PIECES = "part int, run long, doc_start long, doc_id long, doc_tokens long, at long, length long, crc long"


def read_pieces(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per piece (a document's part of a block), with `start`, the ids before its document in the whole corpus."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    runs = sorted(blocks.groupBy("part", "run").agg(F.sum("n_tokens").alias("n")).collect())  # one row per run
    starts, total = [], 0
    for part, run, n in runs:
        starts.append((part, run, total))
        total += n
    at = F.broadcast(spark.createDataFrame(starts, "part int, run long, before_ long"))
    pieces = blocks.mapInArrow(_pieces(*load_model(spark, path), with_ids), PIECES + ", ids array<long>" * with_ids)
    return pieces.join(at, ["part", "run"]).withColumn("start", F.col("before_") + F.col("doc_start")).drop("part", "run", "doc_start", "before_")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, all from the files."""
    whole = F.sum("length") == F.col("doc_tokens")
    out = read_pieces(spark, path).groupBy("start", "doc_id", "doc_tokens").agg(
        F.when(whole, F.sum("length")).otherwise(F.raise_error(F.lit("a block of a document is missing"))).alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def documents_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document with its ids: doc_id, start, ids."""
    pieces = F.sort_array(F.collect_list(F.struct("at", "ids")))
    return read_pieces(spark, path, with_ids=True).groupBy("start", "doc_id").agg(F.flatten(F.transform(pieces, lambda p: p.ids)).alias("ids")).select("doc_id", "start", "ids")
