"""Benchmark decontamination over template windows.

Texts become sequences of canonical tokens: numbers, units that follow a number, and names (capitalised words inside a
sentence; neighbours count as one) turn into typed placeholders, other words into their lower case. Windows of `WIDTH` canonical
tokens are hash-joined between documents and benchmark items, so a question with other numbers or names still meets its
template. The slots under a diagonal (document position less item position) must then agree: each value of the item stands for
one value in the document, the one that most windows of the diagonal support (of equals the value itself, then the smallest), and
windows that contradict it don't count. A document is contaminated by an item if the others cover enough of the item's windows.

The benchmark goes over the documents in blocks of at most `BLOCK_WINDOWS` windows, the bound of what is broadcast; every block
is held against all documents. Items with fewer tokens than a window are one window of their own length, down to
`LEAST` tokens; shorter ones match nothing.

Defined cases: null and empty texts match nothing; repeated items or documents give a row for each distinct pair of ids, with the
largest coverage; an empty table gives an empty result; further columns are ignored; whole texts count, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common
from runlens.session import cut_lineage

WIDTH = 8
LEAST = 4
#: Windows need so many words that are no placeholders.
PLAIN = 3
MIN_COVERAGE = 0.3
BLOCK_WINDOWS = 1 << 17
#: Units that count after a number.
UNITS = "mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg t ton tons oz lb lbs pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent pct dollar dollars cent cents euro euros usd eur kb mb gb tb hz khz mhz ghz w kw v degrees degree".split()

NUM, UNIT, NAME = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F))


def canonical(data: np.ndarray, offs: np.ndarray):
    """(token hashes, slot values (0: no slot), text) after canonicalisation."""
    digit = (data >= 0x30) & (data <= 0x39)
    inner = np.zeros(len(data), bool)
    inner[1:-1] = ((data[1:-1] == 0x2E) | (data[1:-1] == 0x2C)) & digit[:-2] & digit[2:]
    kind = np.where(digit | inner, 2, np.where(common.LETTER[data], 1, 0)).astype(np.int8)
    edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, np.int64)
    stop = np.concatenate([edge[1:], [len(kind)]])
    real = kind[edge] > 0
    starts, ends = edge[real], stop[real]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.searchsorted(offs, starts, "right") - 1
    low = common.lower(data)
    h = common.Hashes(low).of(starts, ends)
    number = kind[starts] == 2
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    after_number = np.concatenate([[False], number[:-1]]) & ~first
    probe = np.frombuffer(" ".join(UNITS).encode() + b" ", np.uint8)
    a, b, _ = common.words(probe, np.zeros(1, np.int64), common.LETTER)
    unit = after_number & ~number & np.isin(h, common.Hashes(probe).of(a, b))
    # a name: a capital, then a lower-case letter, and no sentence end between it and the word before
    pad = np.append(data, np.uint8(0x20))
    capital = (low[starts] != data[starts]) | ((data[starts] == 0xC3) & (np.append(low, 0)[starts + 1] != pad[starts + 1]))
    second = np.where(data[starts] == 0xC3, starts + 2, starts + 1)
    wide = np.append(pad, np.uint8(0x20))
    lower_second = (second < ends) & (((wide[second] >= 0x61) & (wide[second] <= 0x7A)) | ((wide[second] == 0xC3) & (np.append(pad, 0)[np.minimum(second + 1, len(pad))] >= 0x9F)))
    breaks = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b".!?:\n\r", np.uint8)) & ~inner)])
    before = np.concatenate([[0], ends[:-1]])
    inside = ~first & (breaks[starts] == breaks[before])
    name = capital & lower_second & inside & ~number & ~unit
    token = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, h)))
    slot = np.where(number | unit | name, h | np.uint64(1), np.uint64(0))
    drop = np.concatenate([[False], name[1:] & name[:-1] & ~first[1:]])
    if drop.any():  # neighbouring names are one slot, whose value is all of them
        group = np.cumsum(~drop) - 1
        joined = np.zeros(group[-1] + 1, np.uint64)
        np.add.at(joined, group, slot * (np.uint64(2) * (np.arange(len(slot)) - np.flatnonzero(~drop)[group]).astype(np.uint64) + np.uint64(1)))
        keep = ~drop
        token, doc, slot = token[keep], doc[keep], np.where(slot[keep] != 0, joined | np.uint64(1), np.uint64(0))
    return token, slot, doc


def template_windows(token: np.ndarray, slot: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of the windows with enough plain words."""
    at, h = common.windows(token, doc, width)
    plain = np.concatenate([[0], np.cumsum(slot == 0)])
    ok = plain[at + width] - plain[at] >= min(PLAIN, width)
    return at[ok], common.mix(h[ok] + np.uint64(width))


def _slots(slot: np.ndarray, at: np.ndarray, width: int) -> pa.Array:
    """The slot values within each window, in order."""
    block = slot[at[:, None] + np.arange(width)] if len(at) else np.zeros((0, width), np.uint64)
    used = block != 0
    return common.lists(pa.array(block[used].view(np.int64)), used.sum(1))


def _item_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offs in common.chunks(batches):
        token, slot, doc = canonical(data, offs)
        n = np.bincount(doc, minlength=rows.num_rows)
        first = np.searchsorted(doc, np.arange(rows.num_rows))
        for width in range(LEAST, WIDTH + 1):
            at, h = template_windows(token, slot, doc, width)
            use = (n[doc[at]] == width) if width < WIDTH else np.ones(len(at), bool)
            at, h = at[use], h[use]
            yield pa.RecordBatch.from_arrays([rows.column("item_id").take(pa.array(doc[at])), pa.array(at - first[doc[at]]), pa.array(h.view(np.int64)), pa.array(np.full(len(at), width)), _slots(slot, at, width)], names=["item_id", "item_pos", "window", "width", "item_slots"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """The template windows of the benchmark items (item_id, item_pos, window, width, item_slots)."""
    return benchmark.select("item_id", "text").mapInArrow(_item_task, f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, item_pos long, window long, width long, item_slots array<long>")


def _hit_task(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, widths = block.value
        seen = np.zeros(1 << 22, bool)
        seen[(known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for rows, data, offs in common.chunks(batches):
            token, slot, doc = canonical(data, offs)
            first = np.searchsorted(doc, np.arange(rows.num_rows))
            for width in widths:
                at, h = template_windows(token, slot, doc, width)
                maybe = np.flatnonzero(seen[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
                at, h = at[maybe], h[maybe]
                hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                at, h = at[hit], h[hit]
                if len(at):
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(doc[at])), pa.array(at - first[doc[at]]), pa.array(h.view(np.int64)), _slots(slot, at, width)], names=["doc_id", "doc_pos", "window", "doc_slots"])

    return run


def consistent(diagonal: np.ndarray, window: np.ndarray, item: np.ndarray, doc: np.ndarray, n_windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows that agree, diagonals, their slots with a changed value) from slots: diagonal, window (in order), item and document value.

    In each diagonal an item value stands for the document value in most windows, of equals for itself, then for the smallest."""
    good = np.ones(n_windows, bool)
    if not len(window):
        return good, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a window supports a pair once
    o = np.lexsort((window, doc, item, diagonal))
    d, a, b, w = diagonal[o], item[o], doc[o], window[o]
    pair = np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    once = pair | np.concatenate([[True], w[1:] != w[:-1]])
    at = np.flatnonzero(pair)
    count = np.add.reduceat(once.astype(np.int64), at)
    d, a, b = d[at], a[at], b[at]
    rank = np.lexsort((b, a != b, -count, a, d))
    top = np.concatenate([[True], (d[rank][1:] != d[rank][:-1]) | (a[rank][1:] != a[rank][:-1])])
    won = np.zeros(len(at), bool)
    won[rank[top]] = True
    number = np.cumsum(pair) - 1
    good[w[~won[number]]] = False
    # changed values are counted over the windows that stay
    stays = np.zeros(len(at), bool)
    stays[number[good[w]]] = True
    which, changed = np.unique(d[won & stays & (a != b)], return_counts=True)
    return good, which, changed


def _agree_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        met = rows.column("met")
        windows = met.flatten()
        diagonal = np.repeat(np.arange(rows.num_rows), np.diff(met.offsets.to_numpy()))
        slots = windows.field("slots")
        held = np.diff(slots.offsets.to_numpy())
        pairs = slots.flatten()
        window = np.repeat(np.arange(len(windows)), held)
        good, which, changed = consistent(diagonal[window], window, *(pairs.field(k).to_numpy(zero_copy_only=False) for k in ("item_slots", "doc_slots")), len(windows))
        total = np.zeros(rows.num_rows, np.int64)
        total[which] = changed
        keep = np.flatnonzero(good)
        of = diagonal[keep]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(of)), rows.column("item_id").take(pa.array(of)), windows.field("item_pos").take(pa.array(keep)), pa.array(total[of])], names=["doc_id", "item_id", "item_pos", "changed"])


def contamination(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Pairs with a matching window: doc_id, item_id, windows (matched under consistent slots), item_windows, coverage, changed_slots, contaminated."""
    spark = common.bound_batches(docs).sparkSession
    items = cut_lineage(item_windows(benchmark.where(F.col("item_id").isNotNull())), "item-windows")
    totals = items.groupBy("item_id").agg(F.countDistinct("item_pos").alias("item_windows"))
    n = items.count()
    parts = max(1, -(-n // block_windows))
    out = None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part) if parts > 1 else items
        rows = own.select("window", "width").distinct().toPandas()  # one block: about block_windows numbers
        if not len(rows) and part + 1 < parts:
            continue
        block = spark.sparkContext.broadcast((np.sort(rows["window"].to_numpy().view(np.uint64)) if len(rows) else np.zeros(1, np.uint64), sorted({int(w) for w in rows["width"]})))
        hits = docs.select("doc_id", "text").mapInArrow(_hit_task(block), "doc_id long, doc_pos long, window long, doc_slots array<long>")
        met = hits.join(F.broadcast(own.drop("width")), "window").select("doc_id", "item_id", "item_pos", (F.col("doc_pos") - F.col("item_pos")).alias("diagonal"), F.arrays_zip("item_slots", "doc_slots").alias("slots"))
        out = met if out is None else out.unionByName(met)
    # a diagonal has at most one row for each window of its item
    diagonals = out.groupBy("doc_id", "item_id", "diagonal").agg(F.collect_set(F.struct("item_pos", "slots")).alias("met")).select("doc_id", "item_id", "met")
    agreeing = diagonals.mapInArrow(_agree_task, f"doc_id long, item_id {benchmark.schema['item_id'].dataType.simpleString()}, item_pos long, changed long")
    # one row per position of the item: how often a passage recurs in a document doesn't matter
    spread = agreeing.groupBy("doc_id", "item_id", "item_pos").agg(F.min("changed").alias("changed"))
    pairs = spread.groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"), F.max("changed").cast("long").alias("changed_slots"))
    covered = pairs.join(totals, "item_id").withColumn("coverage", F.col("windows") / F.col("item_windows"))
    return covered.select("doc_id", "item_id", "windows", "item_windows", "coverage", "changed_slots", (F.col("coverage") >= min_coverage).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Documents that no benchmark item contaminates, with all their columns."""
    gone = cut_lineage(contamination(docs, benchmark, min_coverage).where("contaminated").select("doc_id").distinct(), "rejected")  # of a size that Spark knows
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
