"""Hierarchical packing of tokenised documents into sequences of several context sizes.

Each task tokenises its documents and packs them in blocks of about `block_tokens` ids, so nothing is shuffled and memory
is bounded; blocks follow the order of the scan, which a repeated task sees again, so sequence ids are stable.

In a block, a document of at least the longest context is cut into full windows first. What remains of each document is
routed to the smallest tier that holds it. Tiers are packed from the longest: every piece opens a window of its tier, and the gap
is filled with pieces of shorter tiers, the largest that fit first; the last one is cut where the window is full and its rest goes
back to its tier. When a tier runs out before its window is full, the window's pieces are cut down to the full windows of
shorter contexts. All windows are full and a power of two long, so none is padded; the last ids of a block make at most one
window of each power of two.

Sequences of a block are dealt into step groups, longest first and each to the lightest group, so steps carry about
equal numbers of tokens.

Defined cases: null text is empty and gives the end id alone; special-token strings in a text give their ids, as the
tokenizer does by default; an empty table gives an empty result; repeated rows are packed as often as they occur; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from runlens.llm import common

TIERS = (2048, 1024, 512, 256)
BLOCK_TOKENS = 1 << 21
STEP_TOKENS = 1 << 16
END_ID = 1


class TextEncoder:
    """Ids of whole texts by any tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, rows: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
        for i in range(0, rows.num_rows, 256):
            part = rows.slice(i, 256)
            texts = [t or "" for t in part.column("text").to_pylist()]
            for doc_id, e in zip(part.column("doc_id").to_pylist(), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                yield doc_id, np.array([*e.ids, END_ID], np.uint32)


class WordEncoder(TextEncoder):
    """The same ids for tokenizers that lower-case, drop white space and split runs of letters, single digits and runs of signs.

    Words of ASCII and Latin-1 letters, digits and signs are split here, over whole byte arrays; each distinct piece goes
    through the tokenizer's model once in a chunk. Any other word (an apostrophe or `<`, a control character, other letters)
    is a piece by itself and goes through the whole tokenizer.
    """

    #: Pieces remembered at most (about 40 bytes each); beyond that the memory starts afresh.
    KEPT = 1 << 19
    CHUNK = 2 << 20

    def __init__(self, path: str):
        super().__init__(path)
        self.forget()
        kind = np.full(256, 3, np.uint8)
        kind[[0x20, 0x09, 0x0A, 0x0D]] = 0
        kind[common.LETTER] = 1
        kind[0x30:0x3A] = 2
        self.kind = kind
        self.odd = np.zeros(256, bool)
        self.odd[[*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x27, 0x3C, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the code points from 256 in order
        stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(stay)))}

    def pieces(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after lower-casing, starts and ends of the pieces."""
        kind = self.kind[data]
        odd = self.odd[data]
        pair = np.zeros(len(data), bool)
        pair[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7) & (data[1:] < 0xC0)
        odd |= (data >= 0x80) & (data < 0xC0) & ~pair
        starts, ends, _ = common.words(data, np.zeros(1, np.int64), ~common.BLANK)
        if odd.any() and len(starts):
            before = np.concatenate([[0], np.cumsum(odd)])
            strange = np.flatnonzero(before[ends] > before[starts])
            for a, b in zip(starts[strange].tolist(), ends[strange].tolist(), strict=True):
                kind[a:b] = 4
        low = np.where(kind == 4, data, common.lower(data))
        new = np.ones(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        at = np.flatnonzero(new)
        stop = np.concatenate([at[1:], [len(data)]])
        real = kind[at] != 0
        return low, at[real], stop[real]

    def forget(self) -> None:
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.first = array("I"), array("q", [0])

    def learn(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Ids of new pieces, in order, at the end of `flat`."""
        raw, model, whole = low.tobytes(), self.tokenizer.model.tokenize, self.tokenizer.encode
        odd = np.concatenate([[0], np.cumsum(self.odd[low] | self._lone(low))])
        high = np.concatenate([[0], np.cumsum(low >= 0x80)])
        strange, beyond = odd[ends] > odd[starts], high[ends] > high[starts]
        flat, first, alphabet = self.flat, self.first, self.alphabet
        for a, b, x, y in zip(starts.tolist(), ends.tolist(), strange.tolist(), beyond.tolist(), strict=True):
            if x:
                flat.extend(whole(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids)
            elif y:
                flat.extend([t.id for t in model(raw[a:b].decode("latin-1").translate(alphabet))])
            else:
                flat.extend([t.id for t in model(raw[a:b].decode("ascii").replace("\x7f", alphabet[0x7F]))])
            first.append(len(flat))

    @staticmethod
    def _lone(data: np.ndarray) -> np.ndarray:
        """Bytes from 0x80 that aren't the second byte of a Latin-1 letter behind 0xC3, nor 0xC3 itself."""
        out = (data >= 0x80) & (data != 0xC3)
        out[1:] &= ~((data[:-1] == 0xC3) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        return out

    def encode(self, rows: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
        for part, data, offs in common.chunks(iter([rows]), size=self.CHUNK):
            low, starts, ends = self.pieces(data)
            h, where, back = np.unique(common.Hashes(low).of(starts, ends), return_index=True, return_inverse=True)
            at = np.searchsorted(self.hashes, h)
            new = np.flatnonzero(np.append(self.hashes, np.uint64(0))[at] != h if len(self.hashes) else np.ones(len(h), bool))
            if len(self.hashes) + len(new) > self.KEPT and len(self.hashes):
                self.forget()
                new = np.arange(len(h))
            place = np.arange(len(self.first) - 1, len(self.first) - 1 + len(new))
            self.learn(low, starts[where[new]], ends[where[new]])
            self.hashes, self.place = np.concatenate([self.hashes, h[new]]), np.concatenate([self.place, place])
            order = np.argsort(self.hashes, kind="stable")
            self.hashes, self.place = self.hashes[order], self.place[order]
            first, flat = np.frombuffer(self.first, np.int64), np.frombuffer(self.flat, np.uint32)
            number = self.place[np.searchsorted(self.hashes, h)][back]
            begin, count = first[number], first[number + 1] - first[number]
            after = np.concatenate([[0], np.cumsum(count)])
            ids = flat[np.repeat(begin - after[:-1], count) + np.arange(after[-1])]
            del first, flat  # else the arrays could not grow
            cut = after[np.searchsorted(starts, offs)]
            for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                yield doc_id, np.append(ids[cut[i] : cut[i + 1]], np.uint32(END_ID))


#: One encoder for each tokenizer file and worker process.
_ENCODERS: dict[tuple, TextEncoder] = {}


def encoder_of(path: str, by_word: bool) -> TextEncoder:
    if (path, by_word) not in _ENCODERS:
        _ENCODERS[path, by_word] = (WordEncoder if by_word else TextEncoder)(path)
    return _ENCODERS[path, by_word]


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every id of documents of these lengths once."""
    top, sequences = tiers[0], []
    routed: dict[int, deque] = {t: deque() for t in tiers}

    def route(doc: int, start: int, length: int) -> None:
        if length:
            routed[next(t for t in reversed(tiers) if length <= t)].append((doc, start, length))

    for doc, n in enumerate(lengths):
        full = n // top
        sequences += [[(doc, k * top, top)] for k in range(full)]
        route(doc, full * top, n - full * top)
    rest: list[tuple[int, int, int]] = []
    for i, tier in enumerate(tiers):
        here = routed[tier]
        while here:
            window, gap = [], tier
            while gap and here and here[0][2] <= gap:
                piece = here.popleft()
                window.append(piece)
                gap -= piece[2]
            for shorter in tiers[i + 1 :]:
                while gap and routed[shorter] and routed[shorter][0][2] <= gap:
                    piece = routed[shorter].popleft()
                    window.append(piece)
                    gap -= piece[2]
            if gap:  # cut one piece of what is left, longest tier first
                source = next((routed[t] for t in tiers[i:] if routed[t]), None)
                if source is not None:
                    doc, start, length = source.popleft()
                    cut = min(gap, length)
                    window.append((doc, start, cut))
                    gap -= cut
                    route(doc, start + cut, length - cut)
            if gap:
                rest += window
            else:
                sequences.append(window)
    left = sum(p[2] for p in rest)
    todo = deque(rest)
    while left:  # what no tier could fill: full windows of falling powers of two
        gap = min(top, 1 << (left.bit_length() - 1))
        left -= gap
        window = []
        while gap:
            doc, start, length = todo.popleft()
            cut = min(gap, length)
            window.append((doc, start, cut))
            gap -= cut
            if cut < length:
                todo.appendleft((doc, start + cut, length - cut))
        sequences.append(window)
    return sequences


def balance(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each sequence: longest first, each to the group with the fewest tokens so far."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n, g = groups[0]
        heapq.heapreplace(groups, (n + sizes[i], g))
        out[i] = g
    return out


def _pack_task(path: str, tiers: tuple[int, ...], block_tokens: int, step_tokens: int, by_word: bool, with_ids: bool):
    def emit(block: int, ids: list, docs: list[np.ndarray]) -> pa.RecordBatch:
        part = TaskContext.get().partitionId()
        sequences = pack([len(d) for d in docs], tiers)
        steps = balance([sum(p[2] for p in s) for s in sequences], step_tokens)
        rows = []
        for k, (pieces, step) in enumerate(zip(sequences, steps, strict=True)):
            offset, total = 0, sum(p[2] for p in pieces)
            for doc, start, length in pieces:
                own = docs[doc][start : start + length]
                rows.append((ids[doc], start, length, zlib.crc32(own.astype("<u4").tobytes()), len(docs[doc]), part << 40 | block << 20 | k, offset, total, part << 40 | block << 20 | step, own if with_ids else None))
                offset += length
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group", "ids"][: 9 + with_ids]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 10
        return pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n, c in zip(names, cols, strict=False)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, by_word)
        ids, docs, held, block = [], [], 0, 0
        for batch in batches:
            for doc_id, tokens in encoder.encode(batch):
                ids.append(doc_id)
                docs.append(tokens)
                held += len(tokens)
                if held >= block_tokens:
                    yield emit(block, ids, docs)
                    ids, docs, held, block = [], [], 0, block + 1
        if docs:
            yield emit(block, ids, docs)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS, by_word: bool = True, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, step_group[, ids].

    `tokenizer_path` is read on the executors, where it must be installed. `tiers` falls in powers of two.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError("tiers must be falling powers of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long" + ", ids array<int>" * with_ids
    return common.bound_batches(docs).select("doc_id", "text").mapInArrow(_pack_task(tokenizer_path, tuple(tiers), block_tokens, step_tokens, by_word, with_ids), schema)
