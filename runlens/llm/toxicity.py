"""Toxicity by maximum-scoring segments.

Every word gets a score: the log-odds of toxic against other labelled texts, with an informative Dirichlet prior (prior counts in
proportion to the pooled counts), for words and for word beginnings, which stand in for words not seen in training. Only
log-odds that are significant (z) count; all other words share one small negative score. A linear scan then finds all maximal
scoring segments of a text (Ruzzo and Tompa). Segment scores are put on the scale of the extreme-value distribution of such
maxima (Karlin and Altschul: E = K n exp(-lambda S)), fitted to the non-toxic texts; a logistic curve over the best and the
summed normalised scores turns them into a probability.

Training is bounded: at most about `MAX_ROWS` labelled texts (a hashed sample) and `MAX_FEATURES` features. Equal texts count once;
log-odds are learned on one half of the sample and the curve on the other.

Defined cases: null and empty texts have no segment and get the curve's value for none; without labelled rows of both kinds
all scores are the share of toxic labels (0 without labels); repeated label rows of a document count as toxic if any is;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common

MAX_ROWS = 20_000
MAX_FEATURES = 1 << 18
MIN_COUNT = 5
MIN_Z = 4.0
PRIOR = 500.0
#: Prior count of a rare word in either kind; keeps the variance of words unseen in one kind finite.
LEAST_PRIOR = 0.5
#: Share of toxic words within a toxic passage; fixes the score of other words.
PASSAGE_RATE = 0.1
PREFIXES = (5, 6, 7, 8)
SIGNIFICANT_E = 0.05
THRESHOLD = 0.3


@dataclass
class Model:
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    neutral: float = float(np.log(1 - PASSAGE_RATE))
    lam: float = 1.0
    log_k: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0, 0, 0]))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words x features hashes, starts, ends, text): column 0 the whole word, then its beginnings (0 where it is no longer)."""
    low = common.lower(data)
    starts, ends, doc = common.words(low, offs, common.WORD)
    hashes = common.Hashes(low)
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = hashes.of(starts, ends)
    for k, n in enumerate(PREFIXES):
        at = np.flatnonzero(ends - starts > n)
        out[at, k + 1] = common.mix(hashes.of(starts[at], starts[at] + n) + np.uint64(k + 1))
    return out, starts, ends, doc


def lookup(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of `keys` in sorted `hashes`, -1 where absent. A table of seen low bits leaves few keys to search."""
    out = np.full(keys.shape, -1, np.int64)
    if len(hashes):
        seen = np.zeros(1 << 22, bool)
        seen[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        maybe = np.nonzero(seen[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)])
        found = keys[maybe]
        at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        out[maybe] = np.where(hashes[at] == found, at, -1)
    return out


def maximal_segments(left: list[float], right: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last, score) over positive tokens, given the running sum before and after each."""
    segs: list[list] = []  # first, last, sum before, sum after, previous candidate with a smaller sum before
    for i, (lo, hi) in enumerate(zip(left, right, strict=True)):
        seg = [i, i, lo, hi, -1]
        j = len(segs) - 1
        while True:
            while j >= 0 and segs[j][2] >= seg[2]:
                j = segs[j][4]
            if j < 0 or segs[j][3] >= seg[3]:
                seg[4] = j
                segs.append(seg)
                break
            seg[0], seg[2] = segs[j][0], segs[j][2]
            del segs[j:]
            j -= 1
    return [(a, b, hi - lo) for a, b, lo, hi, _ in segs]


def _scores(m: Model, feats: np.ndarray) -> np.ndarray:
    """A word that training knows has its own score; else the largest score of its beginnings counts."""
    at = lookup(m.hashes, feats)
    known = np.where(at >= 0, np.append(m.scores, 0.0)[at], -np.inf)
    return np.where(at[:, 0] >= 0, known[:, 0], np.maximum(known[:, 1:].max(1), m.neutral) if feats.shape[1] > 1 else m.neutral)


def _segments(m: Model, data: np.ndarray, offs: np.ndarray):
    """For each text with positive words: (text, words, [(first word, last word, score)]); plus word bounds."""
    feats, starts, ends, doc = features(data, offs)
    s = _scores(m, feats)
    total = np.concatenate([[0.0], np.cumsum(s)])
    pos = np.flatnonzero(s > 0)
    n = np.bincount(doc, minlength=len(offs) - 1)
    out = []
    cut = np.flatnonzero(np.concatenate([[True], doc[pos][1:] != doc[pos][:-1]])).tolist() + [len(pos)] if len(pos) else [0]
    for a, b in zip(cut, cut[1:], strict=False):
        p = pos[a:b]
        found = maximal_segments(total[p].tolist(), total[p + 1].tolist())
        d = int(doc[p[0]])
        out.append((d, int(n[d]), [(int(p[x]), int(p[y]), z) for x, y, z in found]))
    return out, starts, ends, doc, n


def _normalised(m: Model, n: int, segs: list) -> tuple[float, float, int]:
    """Best and summed normalised score, and the number of significant segments."""
    e = [m.lam * z - m.log_k - np.log(max(n, 1)) for _, _, z in segs]
    return max(e), sum(max(0.0, x + 3.0) for x in e), sum(x > -np.log(SIGNIFICANT_E) for x in e)


def _curve(m: Model, best: np.ndarray, total: np.ndarray, some: np.ndarray) -> np.ndarray:
    x = np.stack([np.ones(len(best)), some, np.clip(best, -20, 20) * some, np.log1p(total)], 1)
    return 1 / (1 + np.exp(-np.clip(x @ m.weights, -50, 50)))


def _fit_curve(best, total, some, y) -> np.ndarray:
    """Ridge-damped Newton steps for the four weights."""
    x = np.stack([np.ones(len(best)), some, np.clip(best, -20, 20) * some, np.log1p(total)], 1)
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + 1e-2 * np.eye(4), x.T @ (y - p) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _presence_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each feature once for each text that has it, summed over the batch."""
    for _, data, offs in common.chunks(batches):
        feats, _, _, doc = features(data, offs)
        pairs = np.unique(np.stack([np.repeat(doc, feats.shape[1]).astype(np.uint64), feats.ravel()], 1), axis=0)
        h, n = np.unique(pairs[pairs[:, 1] != 0, 1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])


def _context_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each feature with each pair of neighbouring words once a chunk."""
    for _, data, offs in common.chunks(batches):
        feats, _, _, doc = features(data, offs)
        same = np.append(doc[1:] == doc[:-1], False)
        after = np.where(same, np.append(feats[1:, 0], np.uint64(0)), np.uint64(0))
        before = np.concatenate([np.zeros(1, np.uint64), np.where(same[:-1], feats[:-1, 0], np.uint64(0))]) if len(feats) else after
        context = np.repeat(common.mix(before + after * np.uint64(3)), feats.shape[1])
        h = feats.ravel()
        pairs = np.unique(np.stack([h, context], 1)[h != 0], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], names=["h", "context"])


def _count_known_task(hashes):
    """Counts of the known features (texts that have them) and of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hashes.value
        counts, every = np.zeros(len(known), np.int64), 0
        for _, data, offs in common.chunks(batches):
            feats, _, _, doc = features(data, offs)
            at = lookup(known, feats)
            hit = np.nonzero(at >= 0)
            pairs = np.unique(doc[hit[0]] * len(known) + at[hit])
            counts += np.bincount(pairs % len(known), minlength=len(known))
            every += len(doc)
        yield pa.RecordBatch.from_arrays([common.binary([counts.tobytes()]), pa.array([every])], names=["counts", "every"])

    return run


def _measure_task(model):
    """Per text: words, best and summed scores; per task also the histogram of word scores (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for rows, data, offs in common.chunks(batches):
            found, *_, n = _segments(m, data, offs)
            top = [[] for _ in range(rows.num_rows)]
            for d, _, segs in found:
                top[d] = [z for _, _, z in segs]
            yield pa.RecordBatch.from_arrays([rows.column("toxic"), pa.array(n, pa.int64()), pa.array(top, pa.list_(pa.float64()))], names=["toxic", "words", "segments"])

    return run


def _decay(m: Model, values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p exp(lambda s)) = 1."""
    p = weights / weights.sum()
    lo, hi = 1e-6, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * values, 500))).sum()) - 1
    if (p * values).sum() >= 0 or values.max() <= 0:
        return 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, tasks: int = 8) -> Model:
    """Fits the model to the labels (doc_id, toxic) of `docs`. The driver holds counts of at most MAX_FEATURES features."""
    known = common.bound_batches(labels).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = known.count()
    if not total:
        return Model()
    picked = common.sampled(known, "doc_id", min(1.0, max_rows / total))
    # at most about max_rows pairs of numbers, whatever the size of the labels
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").dropDuplicates(["text"]).repartition(tasks, "doc_id").persist()
    try:
        half = lambda k: F.pmod(F.xxhash64("text"), F.lit(2)) == k
        context = docs.sparkSession.sparkContext
        toxic = texts.where(half(0) & (F.col("toxic") == 1)).select("text")
        present = toxic.mapInArrow(_presence_task, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
        # copies of a passage repeat its words with the same neighbours: no word counts more often than it has neighbourhoods
        contexts = toxic.mapInArrow(_context_task, "h long, context long").distinct().groupBy("h").agg(F.count("*").alias("contexts"))
        seen = present.join(contexts, "h").orderBy(F.desc("n"), "h").limit(MAX_FEATURES).toPandas()
        m = Model()
        if len(seen):
            order = np.argsort(seen["h"].to_numpy().view(np.uint64), kind="stable")
            hashes, contexts = seen["h"].to_numpy().view(np.uint64)[order], seen["contexts"].to_numpy()[order]
            shared = context.broadcast(hashes)
            sums = lambda df: [(np.frombuffer(r["counts"], np.int64), r["every"]) for r in df.select("text").mapInArrow(_count_known_task(shared), "counts binary, every long").collect()]
            yt, nt = (sum(x) for x in zip(*sums(texts.where(half(0) & (F.col("toxic") == 1))), strict=True))
            yn, nn = (sum(x) for x in zip(*sums(texts.where(half(0) & (F.col("toxic") == 0))), strict=True))
            yt = np.minimum(yt, contexts)
            alpha = np.maximum(PRIOR * (yt + yn) / max(nt + nn, 1), LEAST_PRIOR)
            odds = lambda y, n: np.log(y + alpha) - np.log(np.maximum(n + PRIOR - y - alpha, 1.0))
            delta = odds(yt, nt) - odds(yn, nn)
            z = delta / np.sqrt(1 / np.maximum(yt + alpha, 1e-9) + 1 / np.maximum(yn + alpha, 1e-9))
            m.hashes, m.scores = hashes, np.where((z >= MIN_Z) & (delta > 0), delta, m.neutral)
        shared = context.broadcast(m)
        rows = texts.select("text", "toxic").where(half(1)).mapInArrow(_measure_task(shared), "toxic int, words long, segments array<double>").collect()
        null = [r for r in rows if r["toxic"] == 0]
        words = max(1, sum(r["words"] for r in null))
        segs = np.array([z for r in null for z in r["segments"]] or [1.0])
        m.lam = _decay(m, np.append(segs, m.neutral), np.append(np.ones(len(segs)), max(1, words - len(segs))))
        # maximal segments of at least the median score appear with density K exp(-lambda s) a word
        mid = float(np.median(segs))
        m.log_k = float(np.log(max((segs >= mid).sum(), 1) / words) + m.lam * mid)
        value = [_normalised(m, r["words"], [(0, 0, z) for z in r["segments"]]) if r["segments"] else (0.0, 0.0, 0) for r in rows]
        y = np.array([r["toxic"] for r in rows], float)
        if len(rows) and 0 < y.sum() < len(y):
            m.weights = _fit_curve(np.array([v[0] for v in value]), np.array([v[1] for v in value]), np.array([float(bool(r["segments"])) for r in rows]), y)
        elif len(rows):
            m.weights = np.array([np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)), 0, 0, 0])
        return m
    finally:
        texts.unpersist()


def _score_task(model):
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for rows, data, offs in common.chunks(batches):
            k = rows.num_rows
            best, total, some = np.zeros(k), np.zeros(k), np.zeros(k)
            found, starts, ends, _, n = _segments(m, data, offs)
            passages: list[list] = [[] for _ in range(k)]
            for d, size, segs in found:
                best[d], total[d], _ = _normalised(m, size, segs)
                some[d] = 1
                for a, b, z in segs:
                    e = float(np.exp(min(50.0, m.log_k + np.log(max(size, 1)) - m.lam * z)))
                    if e <= SIGNIFICANT_E:
                        before = lambda x, d=d: int(((data[offs[d] : x] & 0xC0) != 0x80).sum())
                        passages[d].append({"start": before(starts[a]), "end": before(ends[b]), "score": z, "e_value": e})
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(_curve(m, best, total, some)), pa.array(passages, passage)], names=["doc_id", "score", "passages"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages array<struct<start, end, score, e_value>>): every significant passage, in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES numbers
    return docs.select("doc_id", "text").mapInArrow(_score_task(shared), "doc_id long, score double, passages array<struct<start: long, end: long, score: double, e_value: double>>")


def detect(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Learns from the labels outside the held-out fold and scores every document."""
    model = train(docs, labels.where(~common.held_out(F.col("doc_id"))))
    out = score(docs, model)
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
