"""Exact Jaccard self-join of word-shingle sets by universe partition and pigeonhole.

Sets fall into size bands, so narrow that a set's partners lie in its own band and the next. In the scheme of a band the token
universe is cut by hash into `m` segments. Two sets that are similar enough differ in at most `H` tokens (the band's bound), so
among segments that together allow for more than `H` differences one must agree: segments compared as they are allow for one
difference each, segments compared within one deletion for two. Every set indexes all its segments, and one-deletion
neighbourhoods for the scheme's `doubles`; as a probe (in its own band and the one below) it picks the cheapest allocation:
full segments with many tokens first, then deletions, empty segments last.

Signatures that many texts of one chunk share are joined there, and one member stands for them in the shuffle. Candidates are checked in two steps, both exact: first every member of
a signature's group against the group's smallest id; then, only in small groups that still span several components, every pair that
is not yet in one component and passes the size bound and a bound of the difference from parity sketches. So large groups of near copies are settled
by their star, and no group is expanded into all its pairs. Groups of more than `CROWD` members that still span several components
(texts around one common passage, say) are not paired at all: of similar sets the n - ceil(t n) + 1 rarest shingles share one, so
their members meet over those, after length and positional filters: first all with the least edited set, then those that are still
apart, and only with members outside the shingle's main component.
Equal sets are one class from the start.

Sets are held as 64-bit hashes of their shingles; a false equality has odds below one in 10^10 for a pair of texts.
The result is components; links inside a component are not all listed.

Defined cases: null and empty texts have no shingle and stand alone; with fewer words than `WIDTH` the whole word sequence is
the one shingle; rows that repeat a doc_id with another text are one node of the graph; a null doc_id is its own class by its
text and never a smallest id unless the class has no other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common
from runlens.llm.components import components
from runlens.session import cut_lineage

WIDTH = 5
PERCENT = 80
#: Bands up to this set size have one-deletion neighbourhoods for all segments; larger ones for one segment in 16.
SMALL = 64
#: Segments over what the pigeonhole needs, so that empty and small ones can be left out.
SPARE = 1.15
#: Signatures that a partition should hold about.
RANGE_ROWS = 1 << 20
#: A signature with so many documents in one chunk is joined there first.
LOCAL_GROUP = 8
#: Open groups of more members are not expanded into pairs; their members meet over shared rare shingles.
CROWD = 8

#: Shingles (8 bytes each) of sets that meet in one place to be verified; larger neighbourhoods are split.
PLACE_TOKENS = 1 << 21

INDEX, PROBE, STANDS = 1, 2, 4
ROLES = np.uint64(7)
_C1, _C2, _C3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


class Schemes:
    """Bands and the partition of each, up to the size `largest`."""

    def __init__(self, largest: int, percent: int = PERCENT):
        edges = [1]
        while edges[-1] <= largest:
            last = edges[-1]
            edges.append(max(last + 1, 100 * (last - 1) // percent + 1))
        self.edges = np.array(edges, np.int64)
        top = self.edges[1:] - 1
        self.errors = (100 - percent) * (top + 100 * top // percent) // (100 + percent)
        self.segments = np.where(self.errors == 0, 1, np.ceil(SPARE * (self.errors + 1))).astype(np.int64)
        self.doubles = np.where(self.errors == 0, 0, np.where(top <= SMALL, self.segments, -(-self.segments // 16)))

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the distinct shingles of each text, ascending within the text."""
    low = common.ASCII_LOWER[data]
    starts, ends, doc = common.words(low, offs, ~common.BLANK)
    h = common.Hashes(low).of(starts, ends)
    at, sh = common.windows(h, doc, width)
    of = doc[at]
    n = len(offs) - 1
    count = np.bincount(doc, minlength=n)
    first = np.searchsorted(doc, np.arange(n))
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = []
        for d in short:
            x = np.zeros(1, np.uint64)
            for w in h[first[d] : first[d] + count[d]]:
                x = common.mix(x + w)
            extra.append(common.mix(x + np.uint64(count[d]))[0])
        sh, of = np.concatenate([sh, np.array(extra, np.uint64)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        sh, of = sh[order], of[order]
    cut = np.searchsorted(of, np.arange(n + 1))
    sh = sh.copy()
    for d in np.flatnonzero(np.diff(cut) > 1):
        sh[cut[d] : cut[d + 1]].sort()
    keep = np.ones(len(sh), bool)
    keep[1:] = (sh[1:] != sh[:-1]) | (of[1:] != of[:-1])
    return sh[keep], np.bincount(of[keep], minlength=n)


def _sum_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


def signatures(s: Schemes, sh: np.ndarray, counts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set number, role) of all sets in their own band's scheme, or with `lower` as probes in the band below."""
    band = s.band(counts) - lower
    use = np.flatnonzero((counts > 0) & (band >= 0))
    keep = np.repeat((counts > 0) & (band >= 0), counts)
    h, n, band = sh[keep], counts[use], band[use]
    m, need, doubles = s.segments[band], s.errors[band] + 1, s.doubles[band]
    tok_set = np.repeat(np.arange(len(use)), n)
    base = np.concatenate([[0], np.cumsum(m)])
    seg_of = (((h >> np.uint64(32)) * m[tok_set].astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + base[tok_set]
    total = int(base[-1])
    size = np.bincount(seg_of, minlength=total)
    tok = common.mix(h ^ _C1)
    content = _sum_by(tok, size)
    seg_set = np.repeat(np.arange(len(use)), m)
    seg_no = np.arange(total) - base[seg_set]
    salt = (band[seg_set] + 1).astype(np.uint64) * _C2 + (seg_no + 1).astype(np.uint64) * _C3
    double = seg_no < doubles[seg_set]
    # options of one difference each: a segment as it is, or one more by its deletions; all of a tier come before the next
    cap = np.minimum(size, (1 << 18) - 1)
    exact_key = seg_set << 24 | np.where(size == 0, 4, 0) << 20 | (1 << 18) - 1 - cap
    up = np.flatnonzero(double)
    up_key = seg_set[up] << 24 | np.where(size[up] == 0, 5, 1) << 20 | cap[up]
    key, option = np.concatenate([exact_key, up_key]), np.concatenate([np.arange(total), up + total])
    order = np.argsort(key, kind="stable")
    of = key[order] >> 24
    rank = np.arange(len(order)) - np.searchsorted(of, np.arange(len(use)))[of]
    chosen = np.zeros(2 * total, bool)
    chosen[option[order[rank < need[of]]]] = True
    full, more = chosen[:total], chosen[total:]

    a = lambda seg, x: common.mix(x + salt[seg])
    b = lambda seg, x: common.mix(x + salt[seg] + _C1)
    every = np.arange(total)
    out = []
    if lower:
        at = np.flatnonzero(full)
        out.append((a(at, content[at]), seg_set[at], np.full(len(at), PROBE)))
    else:
        out.append((a(every, content), seg_set, np.where(full, INDEX | PROBE, INDEX)))
        t = np.flatnonzero(double[seg_of])
        out.append((b(seg_of[t], content[seg_of[t]] - tok[t]), tok_set[t], np.full(len(t), INDEX)))
    t = np.flatnonzero(more[seg_of])
    out.append((a(seg_of[t], content[seg_of[t]] - tok[t]), tok_set[t], np.full(len(t), PROBE)))
    at = np.flatnonzero(more)
    out.append((b(at, content[at]), seg_set[at], np.full(len(at), PROBE)))
    sig, number, role = (np.concatenate(x) for x in zip(*out, strict=True))
    return sig, use[number], role


def _summary_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the set's size, two digests of it, 256 parity bits, and a parity sketch of one or two bits a shingle."""
    for rows, data, offs in common.chunks(batches):
        sh, n = shingle_sets(data, offs)
        x = common.mix(sh ^ _C2)
        cols = [_sum_by(x, n), _sum_by(common.mix(x ^ _C3), n)]
        bit = np.uint64(1) << (x & np.uint64(63))
        word = (x >> np.uint64(6)) & np.uint64(3)
        for k in range(4):
            run = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.where(word == k, bit, np.uint64(0)))]) if len(x) else np.zeros(1, np.uint64)
            end = np.cumsum(n)
            cols.append(run[end] ^ run[end - n])
        cut = np.concatenate([[0], np.cumsum(n)])
        sketches = common.binary([parity_sketch(x[a:b]) for a, b in zip(cut, cut[1:], strict=False)])
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(c.view(np.int64)) for c in cols), sketches], names=["doc_id", "n_shingles", "k1", "k2", "p0", "p1", "p2", "p3", "sketch"])


def parity_sketch(x: np.ndarray) -> bytes:
    """For each slot of the hashes' low bits the parity of their number; a power of two of slots, at least one a hash."""
    slots = max(64, 1 << max(0, len(x) - 1).bit_length())
    odd = np.bincount((x & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets from their sketches (bytes as arrays); the longer one is folded."""
    if len(a) > len(b):
        a, b = b, a
    return int(np.bitwise_count(np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0) ^ a).sum())


def _plausible_task(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ok = []
            for n, x, y in zip(rows.column("n").to_pylist(), rows.column("sketch_a"), rows.column("sketch_b"), strict=True):
                differ = least_difference(*(np.frombuffer(t.as_buffer(), np.uint8) for t in (x, y)))
                ok.append((100 + percent) * differ <= (100 - percent) * n)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column("a").filter(keep), rows.column("b").filter(keep)], names=["a", "b"])

    return run


def _plausible(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sizes and sketches leave possible."""
    side = lambda x: rows.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "sketch_a", "sketch_b").mapInArrow(_plausible_task(percent), "a long, b long").distinct()


def _signature_task(largest: int, percent: int):
    """Rows (signature with the role in its low bits, id, rep): `rep` is set for members that meet here and go on beside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Schemes(largest, percent)
        for rows, data, offs in common.chunks(batches):
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
            sh, n = shingle_sets(data, offs)
            parts = [signatures(s, sh, n, lower) for lower in (False, True)]
            sig, number, role = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(sig, kind="stable")
            sig, role, own = sig[order] & ~ROLES, role[order].astype(np.uint64), ids[number[order]].astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([new, [len(sig)]]))
            # signatures that many texts of the chunk share: the members go on beside, the smallest stands for them
            big = size >= LOCAL_GROUP
            crowd = np.repeat(big, size)
            least = np.minimum.reduceat(own, new) if len(new) else own
            roles = np.bitwise_or.reduceat(role, new) if len(new) else role
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([sig | role, sig[new[big]] | roles[big] | np.uint64(STANDS)]).view(np.int64)), pa.array(np.concatenate([own, least[big]])),
                pa.array(np.concatenate([np.repeat(least, size), least[big]]), mask=np.concatenate([~crowd, np.ones(int(big.sum()), bool)]))], names=["sig", "id", "rep"])

    return run


def _candidate_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature rows of a partition -> star edges (kind 0, of groups of two rows kind 2: smaller id a, b, shared signatures) and members of larger groups (kind 1: signature, id, role)."""

    def batch(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n.astype(np.int32))], names=["kind", "a", "b", "n"])

    def edges(a: np.ndarray, b: np.ndarray, kind: int = 0) -> pa.RecordBatch:
        a, b = a[a != b], b[a != b]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        return batch(kind, a[first], b[first], np.diff(np.concatenate([first, [len(a)]])))

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for rows in batches:
        sig, own = (rows.column(c).to_numpy().view(kind) for c, kind in (("sig", np.uint64), ("id", np.int64)))
        met = rows.column("rep").is_valid().to_numpy(zero_copy_only=False)
        if met.any():
            at = np.flatnonzero(met)
            yield edges(rows.column("rep").take(pa.array(at)).to_numpy(), own[at])
            yield batch(1, (sig[at] & ~ROLES).view(np.int64), own[at], sig[at] & np.uint64(INDEX | PROBE))
        held.append((sig[~met], own[~met]))
    sig, own = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, t) for k, t in ((0, np.uint64), (1, np.int64)))
    del held
    order = np.argsort(sig)
    sig, own = sig[order], own[order]
    role, sig = (sig & ROLES).astype(np.int8), sig & ~ROLES
    if not len(sig):
        return
    new = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.concatenate([new, [len(sig)]]))
    roles = np.bitwise_or.reduceat(role, new)
    live = ((size > 1) & (roles & INDEX > 0) & (roles & PROBE > 0)) | (roles & STANDS > 0)
    keep = np.repeat(live, size)
    sig, own, role, size, roles = sig[keep], own[keep], role[keep], size[live], roles[live]
    if not len(sig):
        return
    start = np.cumsum(size) - size
    keep = np.repeat((size > 2) | (roles & STANDS > 0), size)
    least = np.repeat(np.minimum.reduceat(own, start), size)
    yield edges(least[keep], own[keep])
    yield edges(least[~keep], own[~keep], 2)
    yield batch(1, sig[keep].view(np.int64), own[keep], role[keep] & (INDEX | PROBE))


def _set_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offs in common.chunks(batches):
        sh, n = shingle_sets(data, offs)
        cut = np.concatenate([[0], np.cumsum(n)])
        yield pa.RecordBatch.from_arrays([rows.column("place"), rows.column("doc_id"), pa.nulls(rows.num_rows, pa.int64()), common.binary([sh[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)])], names=["place", "a", "b", "tokens"])


def _verify_task(percent: int):
    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if not len(a) or 100 * len(a) < percent * len(b):
            return False
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return 100 * both >= percent * (len(a) + len(b) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple[int, int], list[np.ndarray]] = {}  # a list, as rows may repeat an id
        pairs: list[tuple[int, int, int]] = []
        for rows in batches:
            for place, a, b, tokens in zip(*(rows.column(c).to_pylist() for c in ("place", "a", "b", "tokens")), strict=True):
                if b is None:
                    sets.setdefault((place, a), []).append(np.frombuffer(tokens, np.uint64))
                else:
                    pairs.append((place, a, b))
        links = [(a, b) for place, a, b in pairs if any(similar(x, y) for x in sets[place, a] for y in sets[place, b])]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _slot_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(common.SLOTS, np.int64)
    for _, data, offs in common.chunks(batches):
        sh, _ = shingle_sets(data, offs)
        counts += np.bincount((sh & np.uint64(common.SLOTS - 1)).astype(np.int64), minlength=common.SLOTS)
    yield common.slot_blocks(counts)


def _rare_task(ranks, percent: int):
    """A row for each of the rarest shingles of a set that every similar set shares one of; `place` holds the set's size and the position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in common.chunks(batches):
            sh, n = shingle_sets(data, offs)
            key = common.rarity_keys(sh, ranks.value)
            key = key[np.lexsort((key, np.repeat(np.arange(len(n)), n)))]
            size = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            row = np.repeat(np.arange(len(n)), size)
            pos = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            word = key[(np.cumsum(n) - n)[row] + pos].view(np.int64)
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(word), rows.column("doc_id").take(of), rows.column("component").take(of), pa.array(n[row].astype(np.int64) << 32 | pos)], names=["word", "id", "component", "place"])

    return run


def _rare_shingles(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(word, id, place): the rarest shingles of `members` (doc_id, component), where sets of different components share them."""
    held = cut_lineage(texts.join(members, "doc_id").select("doc_id", "component", "text"), "crowd-texts")
    ranks = held.sparkSession.sparkContext.broadcast(common.slot_ranks(held.select("text").mapInArrow(_slot_task, "block int, counts binary")))  # SLOTS numbers
    words = cut_lineage(held.mapInArrow(_rare_task(ranks, percent), "word long, id long, component long, place long"), "rare-shingles")
    return cut_lineage(words.join(_mixed(words), "word").drop("component"), "mixed-shingles")


def _mixed(words: DataFrame) -> DataFrame:
    """(word): the shingles whose sets lie in different components."""
    return words.groupBy("word").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("word")


def _side(words: DataFrame, x: str) -> DataFrame:
    return words.select("word", *[F.col(c).alias(f"{c}_{x}") for c in words.columns if c != "word"])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))


def _head_pairs(words: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each set with the one of its shingle that has the fewest rarer ones: the least edited of near copies."""
    heads = words.groupBy("word").agg(F.min(F.struct(F.col("place").bitwiseAND(0xFFFFFFFF).alias("position"), "id", "place")).alias("m")).select("word", F.col("m.id").alias("id"), F.col("m.place").alias("place"))
    return _ordered(_side(words, "x").join(_side(heads, "y"), "word").where((F.col("id_x") != F.col("id_y")) & common.near_by_place(percent))).distinct()


def _rare_pairs(words: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in different components that share a shingle of `words` (word, id, place, component) and may be similar."""
    words = cut_lineage(words.join(_mixed(words), "word"), "open-shingles")
    # pairs inside the component that most of a shingle's sets belong to are never formed
    main = words.groupBy("word", "component").agg(F.count("*").alias("sets")).groupBy("word").agg(F.max(F.struct("sets", "component")).alias("m")).select("word", F.col("m.component").alias("main"))
    outside = words.join(main, "word").where("component <> main").drop("main")
    return _ordered(_side(words, "x").join(_side(outside, "y"), "word").where((F.col("component_x") != F.col("component_y")) & common.near_by_place(percent))).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar. The sets of a neighbourhood meet in one place; one of many tokens is split over several."""
    width = lambda c: sizes.select(F.col("class_id").alias(c), F.col("n_shingles").alias(f"n_{c}"))
    sized = cut_lineage(pairs.join(width("b"), "b"), "sized-pairs")
    tokens = sized.agg(F.sum("n_b")).first()[0] or 0
    parts = max(1, -(-2 * tokens // PLACE_TOKENS))
    splits = sized.groupBy("a").agg(F.ceil(F.sum("n_b") / PLACE_TOKENS).alias("splits"))
    placed = sized.join(splits, "a").select(F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("splits"))), F.lit(8 * parts)).alias("place"), "a", "b")
    placed = cut_lineage(placed, "placed-pairs")
    ids = placed.select("place", F.col("a").alias("doc_id")).union(placed.select("place", "b")).distinct()
    sets = texts.join(cut_lineage(ids, "wanted-sets"), "doc_id").select("place", "doc_id", "text").mapInArrow(_set_task, "place long, a long, b long, tokens binary")
    return placed.select("place", "a", "b", F.lit(None).cast("binary").alias("tokens")).unionByName(sets).repartition(parts, "place").mapInArrow(_verify_task(percent), "a long, b long")


def similar_components(docs: DataFrame, percent: int = PERCENT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links of Jaccard >= percent / 100)."""
    texts = common.bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut_lineage(texts.mapInArrow(_summary_task, "doc_id long, n_shingles long, k1 long, k2 long, p0 long, p1 long, p2 long, p3 long, sketch binary"), "shingle-sets")
    totals = rows.agg(F.max("n_shingles"), F.sum("n_shingles")).first()
    largest, tokens = totals[0] or 0, totals[1] or 0
    classes = cut_lineage(rows.where("n_shingles > 0").groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("class_id"), F.first("p0").alias("p0"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("p3").alias("p3")), "set-classes")
    member = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "k1", "k2").join(classes.select("n_shingles", "k1", "k2", "class_id"), ["n_shingles", "k1", "k2"])
    of = cut_lineage(member.select("doc_id", "class_id"), "class-of")

    ranges = max(1, -(-int(tokens * 0.6) // range_rows))
    marks = texts.where("doc_id is not null").mapInArrow(_signature_task(largest, percent), "sig long, id long, rep long")
    # members that have met already go anywhere; the others to their signature, whatever their role
    place = F.coalesce(F.when(F.col("rep").isNotNull(), F.col("id")), F.shiftright("sig", 3))
    found = cut_lineage(marks.repartition(ranges, place).mapInArrow(_candidate_task, "kind int, a long, b long, n int"), "candidates")

    to = lambda name: of.select(F.col("doc_id").alias(name), F.col("class_id").alias(f"class_{name}"))
    edges = found.where("kind <> 1").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("kind").alias("kind")).join(to("a"), "a").join(to("b"), "b").select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"), "n", "kind").where("a <> b")
    edges = cut_lineage(edges.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("kind").alias("kind")), "star-edges")
    members = found.where("kind = 1").select(F.col("a").alias("sig"), "b", F.col("n").alias("role")).distinct().join(to("b"), "b").groupBy("sig", F.col("class_b").alias("id")).agg(F.bit_or("role").alias("role"))
    members = cut_lineage(members, "group-members")

    # first each set meets the set with which it shares most signatures
    size = lambda x: classes.select(F.col("class_id").alias(x), F.col("n_shingles").alias(f"n_{x}"))
    sized = edges.join(size("a"), "a").join(size("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    stars = cut_lineage(sized.groupBy("b").agg(F.max(F.struct("n", -F.col("a"))).alias("m")).select((-F.col("m")["col2"]).alias("a"), "b"), "star-pairs")
    links = cut_lineage(_verified(cut_lineage(_plausible(stars, rows, percent), "plausible-stars"), texts, classes, percent), "star-links")
    first = components(links)

    label = lambda df, found: df.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = cut_lineage(label(members, first), "labelled-members")
    # groups of the same members in the same roles (told by two digests) give the same pairs: one of them stands for all
    digest = lambda k: F.bit_xor(F.xxhash64("id", "role", F.lit(k)))
    groups = labelled.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bit_or("role").alias("roles"), F.count("*").alias("members"), digest(1).alias("d1"), digest(2).alias("d2"))
    open_groups = groups.where(f"lo <> hi and roles = {INDEX | PROBE}").groupBy("members", "d1", "d2").agg(F.min("sig").alias("sig")).select("sig", (F.col("members") > CROWD).alias("crowd"))
    opened = cut_lineage(labelled.join(open_groups, "sig"), "open-members")
    crowds = opened.where("crowd").select(F.col("id").alias("doc_id"), "component").distinct()
    shingles = _rare_shingles(crowds, texts, percent)
    heads = cut_lineage(_head_pairs(shingles, percent).join(stars, ["a", "b"], "left_anti"), "head-pairs")
    stars = stars.unionByName(heads)
    near_heads = cut_lineage(_verified(cut_lineage(_plausible(heads, rows, percent), "plausible-heads"), texts, classes, percent), "head-links")
    links = links.unionByName(near_heads)
    first = components(links) if not near_heads.isEmpty() else first
    facts = label(classes.select(F.col("class_id").alias("id"), "n_shingles", "p0", "p1", "p2", "p3"), first)
    about = lambda x: facts.select(*[F.col(c).alias(f"{c}_{x}") for c in facts.columns])
    differ = sum((F.bit_count(F.col(f"p{k}_x").bitwiseXOR(F.col(f"p{k}_y"))) for k in range(4)), F.lit(0))
    near = (F.col("component_x") != F.col("component_y")) & (100 * F.least("n_shingles_x", "n_shingles_y") >= percent * F.greatest("n_shingles_x", "n_shingles_y")) & ((100 + percent) * differ <= (100 - percent) * (F.col("n_shingles_x") + F.col("n_shingles_y")))
    rest = opened.where("not crowd").drop("component", "crowd").join(facts, "id")
    side = lambda x, bit: rest.where(f"role & {bit} > 0").select("sig", *[F.col(c).alias(f"{c}_{x}") for c in facts.columns])
    inside = _ordered(side("x", INDEX).join(side("y", PROBE), "sig").where(near))
    # an edge of a larger group is a pair of its members
    beside = _ordered(edges.where("kind = 2").select(F.col("a").alias("id_x"), F.col("b").alias("id_y")).join(about("x"), "id_x").join(about("y"), "id_y").where(near))
    pairs = cut_lineage(inside.unionByName(beside).unionByName(_rare_pairs(label(shingles, first), percent)).distinct().join(stars, ["a", "b"], "left_anti"), "open-pairs")
    more = cut_lineage(_verified(cut_lineage(_plausible(pairs, rows, percent), "plausible-pairs"), texts, classes, percent), "open-links")
    final = components(links.unionByName(more)) if not more.isEmpty() else first
    # a row finds its class by its set, not by its id: ids may repeat or be missing
    named = classes.select("n_shingles", "k1", "k2", "class_id").join(final.withColumnRenamed("id", "class_id"), "class_id", "left")
    return rows.select("doc_id", "n_shingles", "k1", "k2").join(named, ["n_shingles", "k1", "k2"], "left").select("doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group of similar ones (the smallest doc_id), and all that are alone; all columns stay."""
    gone = cut_lineage(similar_components(docs, percent).where("doc_id <> component_id").select("doc_id"), "rejected")  # of a size that Spark knows
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
