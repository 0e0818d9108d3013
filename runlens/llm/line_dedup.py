"""Line dedup by an exact set-similarity join.

A line is the set of its lower-cased blank-separated words. A line is removed when an earlier line (by doc_id, then line
number) of the corpus has a Jaccard similarity of `PERCENT` to it; equal sets have 1.

Words are ordered by rarity: a word's key has the rank of its hash slot by corpus count in the high bits and its hash below, so the
smallest keys of a line are its rarest words and all lines agree on the order. Two similar lines share a word of their prefixes
(the first n - ceil(t n) + 1 words). Equal sets become one row before prefixes are spread over words, so a line repeated everywhere
costs one row for each task. The row of a prefix word is narrow (a hash of the word, the set's number, size and position, up to 256
parity bits), so candidates pass the length, positional and parity bounds where they meet, and only those that pass are written and
verified on their words. First each set meets the earliest set of its `STAR_WORDS` prefix words of the smallest hashes; then the
sets that found no earlier match there meet all sets of their prefix words, so the variants of a common line don't meet each other.

All steps are DataFrame operations. Only the ranks of the slots (`SLOTS` numbers) pass through the driver.

Sets are known by 64 and words by 64 bits of hash; a false match has odds below one in 10^10 for a pair of lines.

Defined cases: lines without words (blank, empty or null texts) are never removed and match nothing; ties don't exist within a
document; rows that repeat a doc_id count as one document, so of their equal lines all with the first line number stay; a null
doc_id comes before all others; an empty table gives an empty result; further columns are ignored; long texts and lines are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm import common
from runlens.session import cut_lineage

PERCENT = 80
SLOTS = common.SLOTS
#: Prefix words by which a set meets the earliest set of each.
STAR_WORDS = 4
#: Words up to which 64 and 128 parity bits are enough to tell most lines apart.
SHORT, LONG = 40, 90
#: Parity of a set's words in 64 slots: of all words, and of those with one bit of the key set, with another, and with both.
_BITS = ["parity", "odd", "high", "both"]
#: Blanks within a line, for a regular expression.
_BLANKS = " \\t\\x0b\\f\\r"
#: Bits of a key below the rank.
_LOW = 48


def _lines() -> Column:
    return F.split(F.lower("text"), "\n")


def _hashes(line: Column) -> Column:
    """64-bit hashes of the distinct words of a line; blanks are the space and tab to carriage return."""
    words = F.array_remove(F.split(line, f"[{_BLANKS}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _slot(h: Column) -> Column:
    return F.shiftrightunsigned(h, _LOW).cast("int")


def slot_ranks(docs: DataFrame) -> Column:
    """Array of the rank of each hash slot by the number of its words in lines; folded to a literal when a plan is optimised."""
    words = docs.select(F.explode(_lines()).alias("line")).select(F.explode(_hashes(F.col("line"))).alias("h"))
    counts = np.zeros(SLOTS, np.int64)
    for r in words.groupBy(_slot(F.col("h")).alias("slot")).count().collect():
        counts[r["slot"]] = r["count"]
    ranks = np.empty(SLOTS, np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(SLOTS) - SLOTS // 2  # signed: the rank fills the high bits of a key
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<long>")


def _keys(line: Column, ranks: Column) -> Column:
    """The keys of the distinct words of a line, rare words first."""
    return F.sort_array(F.transform(_hashes(line), lambda h: F.shiftleft(F.get(ranks, _slot(h)), _LOW).bitwiseOR(h.bitwiseAND((1 << _LOW) - 1))))


def _prefix_size(percent: int) -> Column:
    n = F.col("n")
    return (n - F.expr(f"({percent}L * n + 99) div 100") + 1).cast("int")


def keyed_lines(docs: DataFrame, ranks: Column, percent: int = PERCENT) -> DataFrame:
    """Lines with words: doc_id, line_no, set_id, n (words of the set), prefix (hashes of its rarest words), and
    parity bits: 64 up to `SHORT` words, 128 up to `LONG` words, else 256."""
    lines = docs.select("doc_id", F.posexplode(_lines()).alias("line_no", "line")).where(F.col("line").rlike(f"[^{_BLANKS}]"))
    keys = lines.select("doc_id", "line_no", _keys(F.col("line"), ranks).alias("keys")).select("*", F.size("keys").alias("n"))
    prefix = F.transform(F.slice("keys", 1, _prefix_size(percent)), lambda k: F.hash(k))
    one = F.lit(1).cast("long")
    half = lambda k, bit: F.shiftright(k, bit).bitwiseAND(one)
    parity = lambda bit: F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", bit(k), k.bitwiseAND(63).cast("int"))))
    above = lambda words, bits: F.when(F.col("n") > words, bits).otherwise(0)
    bits = [parity(lambda k: one), above(SHORT, parity(lambda k: half(k, 6))), above(LONG, parity(lambda k: half(k, 7))), above(LONG, parity(lambda k: half(k, 6).bitwiseAND(half(k, 7))))]
    return keys.select("doc_id", "line_no", F.xxhash64("keys").alias("set_id"), "n", prefix.alias("prefix"), *[b.alias(c) for c, b in zip(_BITS, bits, strict=True)])


def _doc() -> Column:
    """The document's place in the order of documents; null comes first."""
    return F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc")


def _earlier() -> Column:
    return (F.col("doc_x") < F.col("doc_y")) | ((F.col("doc_x") == F.col("doc_y")) & (F.col("line_x") < F.col("line_y")))


def _near(percent: int) -> Column:
    """The length and positional filters, and the parity bound: sets differ in no fewer words than their parities in bits."""
    n = lambda x: F.shiftright(f"place_{x}", 32)
    known = [None, SHORT, LONG, LONG]
    x = [F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y")) for c in _BITS]
    every, odd, high, both = [b if k is None else F.when(F.least(n("x"), n("y")) > k, b).otherwise(0) for b, k in zip(x, known, strict=True)]
    quarters = [both, odd.bitwiseXOR(both), high.bitwiseXOR(both), every.bitwiseXOR(odd).bitwiseXOR(high).bitwiseXOR(both)]
    differ = sum((F.bit_count(q) for q in quarters), F.lit(0))
    return common.near_by_place(percent) & ((100 + percent) * differ <= (100 - percent) * (n("x") + n("y")))


def _side(rows: DataFrame, x: str) -> DataFrame:
    return rows.select("word", *[F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != "word"])


def _place(pos: Column | str) -> Column:
    """The set's size above the word's position, as `near_by_place` takes them."""
    return (F.shiftleft(F.col("n").cast("long"), 32) + pos).alias("place")


def _star_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(x, y): each set y with the earliest set x of each of its star words, where the bounds allow a match."""
    # the hashes are a fixed order of words: variants of a line choose the same ones
    placed = F.transform("prefix", lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    rows = sets.select("id", "doc", "line", "n", *_BITS, F.inline(F.slice(F.sort_array(placed), 1, STAR_WORDS)))
    rows = rows.select("word", "id", "doc", "line", _place(F.col("pos")), *_BITS).repartition("word")
    heads = rows.groupBy("word").agg(F.count("*").alias("sets"), F.min(F.struct("doc", "line", "id", "place", *_BITS)).alias("head")).where("sets > 1")
    heads = heads.select("word", *[F.col(f"head.{c}").alias(f"{c}_x") for c in ["id", "doc", "line", "place", *_BITS]])
    return _side(rows, "y").join(heads, "word").where(_earlier() & _near(percent)).select(F.col("id_x").alias("x"), F.col("id_y").alias("y")).distinct()


def _open_pairs(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(x, y): sets that share a prefix word where the bounds allow a match and the later one is not found yet; within a document in either order."""
    marked = sets.select("id", "doc", "n", *_BITS, "prefix").join(found.select("id", F.lit(0).alias("closed")), "id", "left")
    rows = marked.select("id", "doc", "n", *_BITS, F.coalesce("closed", F.lit(1)).alias("open"), F.posexplode("prefix").alias("pos", "word"))
    # bit 0 of the number says whether the set is open: both sides have the same rows, so they read one exchange
    rows = rows.select("word", F.shiftleft("id", 1).bitwiseOR(F.col("open")).alias("id"), "doc", _place(F.col("pos")), *_BITS)
    is_open = lambda of: of.bitwiseAND(1) == 1
    inside = (F.col("doc_x") == F.col("doc_y")) & (F.col("id_x") < F.col("id_y")) & is_open(F.col("id_x").bitwiseOR(F.col("id_y")))
    later = ((F.col("doc_x") < F.col("doc_y")) & is_open(F.col("id_y"))) | inside
    pairs = _side(rows, "x").join(_side(rows, "y"), "word").where(later & _near(percent))
    return pairs.select(F.shiftright("id_x", 1).alias("x"), F.shiftright("id_y", 1).alias("y")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, ranks: Column, percent: int) -> DataFrame:
    """(id): the later sets of those pairs (x, y) that are similar by their words."""
    numbers = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    # one row for each document, with its own lines
    wanted = sets.select("id", "set_id", "doc", "line").join(numbers, "id").groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("line", "set_id", "id")).alias("wanted"))
    wanted = cut_lineage(wanted, "wanted-lines")
    texts = docs.select(_doc(), "text").join(wanted, F.col("doc") == F.col("_doc")).select("doc", _lines().alias("lines"), F.explode("wanted").alias("w"))
    lines = texts.select("doc", "w.*", _keys(F.get("lines", F.col("w.line")), ranks).alias("words"))
    # a line of another text with the same id doesn't have the set's id
    words = cut_lineage(lines.where(F.xxhash64("words") == F.col("set_id")).select("id", "doc", "line", "words").dropDuplicates(["id"]), "line-words")
    side = lambda x: words.select(*[F.col(c).alias(f"{c}_{x}") for c in words.columns])
    both = pairs.join(side("x"), F.col("x") == F.col("id_x")).join(side("y"), F.col("y") == F.col("id_y"))
    similar = both.where((100 + percent) * F.size(F.array_intersect("words_x", "words_y")) >= percent * (F.size("words_x") + F.size("words_y")))
    later = F.when(_earlier(), F.col("y")).when((F.col("doc_x") != F.col("doc_y")) | (F.col("line_x") != F.col("line_y")), F.col("x"))
    return cut_lineage(similar.select(later.alias("id")).where("id is not null").distinct(), "line-matches")


def similar_sets(docs: DataFrame, sets: DataFrame, ranks: Column, percent: int = PERCENT) -> DataFrame:
    """(id): sets for which the corpus has an earlier similar set. `sets`: id, set_id, n, prefix, parity bits, doc, line (first occurrence)."""
    found = _verified(cut_lineage(_star_pairs(sets, percent), "star-lines"), sets, docs, ranks, percent)
    rest = _verified(cut_lineage(_open_pairs(sets, found, percent), "open-lines"), sets, docs, ranks, percent)
    return found.union(rest).distinct()


def line_verdicts(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per line with words: doc_id, line_no, removed."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    ranks = slot_ranks(docs)
    lines = cut_lineage(keyed_lines(docs, ranks, percent), "keyed-lines")
    sets = lines.groupBy("set_id").agg(F.min(F.struct(_doc(), "line_no", "n", *_BITS, "prefix")).alias("m"))
    sets = cut_lineage(sets.select(F.monotonically_increasing_id().alias("id"), "set_id", "m.n", "m.prefix", *[f"m.{c}" for c in _BITS], "m.doc", F.col("m.line_no").alias("line")), "line-sets")
    gone = similar_sets(docs, sets, ranks, percent).withColumn("gone", F.lit(True))
    marks = sets.select("id", "set_id", "doc", "line").join(gone, "id", "left").select("set_id", F.col("doc").alias("first_doc"), "line", F.coalesce("gone", F.lit(False)).alias("gone"))
    again = (F.col("doc") != F.col("first_doc")) | (F.col("line_no") != F.col("line"))
    return lines.select("doc_id", _doc(), "line_no", "set_id").join(marks, "set_id").select("doc_id", "line_no", (F.col("gone") | again).alias("removed"))


def document_report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_lines (with words), n_removed, removed (line numbers from 0, ascending)."""
    verdicts = line_verdicts(docs, percent).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("removed").alias("n_removed"), F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("line_no")))).alias("removed"))
    return docs.select("doc_id").join(verdicts, "doc_id", "left").select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def remove_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with the removed lines cut out of their texts; all columns stay."""
    report = document_report(docs, percent).where("n_removed > 0").select(F.col("doc_id").alias("_doc"), F.col("removed").alias("_removed")).dropDuplicates(["_doc"])
    joined = docs.join(report, docs["doc_id"] == report["_doc"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_removed", i)), "\n")
    return joined.withColumn("text", F.when(F.col("_removed").isNull(), F.col("text")).otherwise(kept)).select(docs.columns)
