"""Language identification by scripts and a word-level Viterbi decoding.

A naive Bayes model over byte trigrams of lower-cased words scores every word for every learned language. The script of a word
(its first letter's range) narrows the candidates to languages that training saw in that script. The best sequence of
languages, with a fixed penalty for each switch, labels the words; runs of one label are the spans of a mixed text. The language
of a text is the one whose spans hold most letter bytes; its score is that share.

Training is bounded: at most about `PER_LANG` texts of each language (a hashed sample; a smaller language is taken whole).

Defined cases: a null text and one without any letter get `und` with score 0 and no spans; equal shares go to the
language first in name order; without any training rows all texts get `und`; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common
from runlens.session import cut_lineage

PER_LANG = 4000
SWITCH_PENALTY = 12.0
#: A language is a candidate in a script that holds at least this share of its training words.
SCRIPT_SHARE = 0.01
#: Letters of a text that is not rejected belong to one language at least to this share; mixed texts of two languages stay.
MIN_SCORE = 0.4
SLOTS = 1 << 16
#: Scripts by the first code point of their range.
SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other")]
NAMES = sorted({name for _, name in SCRIPTS})


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # SLOTS x languages, log probabilities
    allowed: np.ndarray  # scripts x languages


def _scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script number of the letter that begins at each start."""
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    b0, b1, b2, b3 = (pad[starts + k].astype(np.int64) for k in range(4))
    code = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1 & 0x3F, np.where(b0 < 0xF0, (b0 & 0xF) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F, (b0 & 7) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F)))
    first = np.array([a for a, _ in SCRIPTS])
    number = np.array([NAMES.index(n) for _, n in SCRIPTS])
    return number[np.searchsorted(first, code, "right") - 1]


def _grams(data: np.ndarray, offs: np.ndarray):
    """Words (starts, ends, text), the trigram slot of every byte and the bytes at which a word's trigrams end."""
    starts, ends, doc = common.words(data, offs, common.LETTER)
    low = common.lower(data)
    low[~common.LETTER[low]] = 0x20
    a = low.astype(np.uint32)
    slot = np.zeros(len(a), np.uint32)
    slot[2:] = (((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint32)
    slot[1:2] = (((a[:1] << 8 | a[1:2] | np.uint32(0x20 << 16)) * np.uint32(2654435761)) >> np.uint32(16)) if len(a) > 1 else 0
    return starts, ends, doc, slot


def _count_task(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), SLOTS), np.int64)
        scripts = np.zeros((len(langs), len(NAMES)), np.int64)
        number = {n: i for i, n in enumerate(langs)}
        for rows, data, offs in common.chunks(batches):
            lang = np.array([number[x] for x in rows.column("lang").to_pylist()])
            starts, ends, doc, slot = _grams(data, offs)
            inside = common.LETTER[data]
            inside[ends[ends < len(data)]] = True  # the trigram that holds the blank after a word
            at = np.flatnonzero(inside)
            of = lang[np.searchsorted(offs, at, "right") - 1]
            grams += np.bincount(of * SLOTS + slot[at], minlength=grams.size).reshape(grams.shape)
            scripts += np.bincount(lang[doc] * len(NAMES) + _scripts(data, starts), minlength=scripts.size).reshape(scripts.shape)
        yield pa.RecordBatch.from_arrays([pa.array(langs), common.binary([g.tobytes() for g in grams]), common.binary([s.tobytes() for s in scripts])], names=["lang", "grams", "scripts"])

    return run


def _sum_task(table: pa.Table) -> pa.Table:
    add = lambda name: sum(np.frombuffer(x.as_py(), np.int64) for x in table.column(name)).tobytes()
    return pa.table({"lang": table.column("lang").slice(0, 1).combine_chunks(), "grams": common.binary([add("grams")]), "scripts": common.binary([add("scripts")])})


def train(labelled: DataFrame, per_lang: int = PER_LANG, tasks: int = 8) -> Model:
    """Fits the model on rows (doc_id, text, lang). The driver holds one table of SLOTS counts for each language."""
    known = common.bound_batches(labelled).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(rate)
    sample = common.sampled(known, "doc_id", rate).repartition(tasks, "doc_id")
    parts = sample.mapInArrow(_count_task(langs), "lang string, grams binary, scripts binary").groupBy("lang").applyInArrow(_sum_task, "lang string, grams binary, scripts binary").collect()
    by = {r["lang"]: r for r in parts}
    grams = np.stack([np.frombuffer(by[n]["grams"], np.int64) for n in langs], 1)
    scripts = np.stack([np.frombuffer(by[n]["scripts"], np.int64) for n in langs], 1)
    table = np.log((grams + 0.1) / (grams.sum(0) + 0.1 * SLOTS)).astype(np.float32)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return Model(langs, table, allowed)


def viterbi(scores: np.ndarray, first: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row of `scores` (words x labels); text i has rows first[i] to first[i] + counts[i].

    All texts step together, longest first, so each step is one array operation over the texts that still have words.
    """
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    n, k = scores.shape
    stay = np.ones((n, k), bool)
    best = np.zeros(n, np.int16)
    label = np.zeros(n, np.int16)
    live = np.searchsorted(-counts, -np.arange(1, (counts[0] if len(counts) else 0) + 1), "right")
    v = np.zeros((len(counts), k), np.float64)
    for t, m in enumerate(live):
        at = first[:m] + t
        if t:
            top = v[:m].argmax(1)
            jump = v[np.arange(m), top] - penalty
            keep = v[:m] >= jump[:, None]
            stay[at], best[at] = keep, top
            v[:m] = np.where(keep, v[:m], jump[:, None])
        v[:m] += scores[at]
    end = v.argmax(1)
    cur = end.astype(np.int16)
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = first[:m] + t
        label[at] = cur[:m]
        if t:
            cur[:m] = np.where(stay[at, cur[:m]], cur[:m], best[at])
    return label


def _label_task(model, penalty: float, spans: bool):
    langs_schema = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.langs, "und"], object)
        for rows, data, offs in common.chunks(batches):
            n, k = rows.num_rows, len(m.langs)
            pred, score = np.full(n, k), np.zeros(n)
            found = pa.array([[] for _ in range(n)], langs_schema) if spans else None
            starts, ends, doc, slot = _grams(data, offs)
            # bytes from 0x80 may be signs: a text without ASCII letters is looked at once more
            ascii_only = np.add.reduceat(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A), offs[:-1])
            doubt = np.flatnonzero(ascii_only == 0)
            none = [i for i in doubt if not any(map(str.isalpha, data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))]
            ok = np.ones(n, bool)
            ok[none] = False
            if k and len(starts):
                flat = np.zeros((len(starts), k), np.float32)
                last = ends < len(data)
                inside = common.LETTER[data]
                inside[ends[last]] = True
                at = np.flatnonzero(inside)
                begin = np.searchsorted(at, starts)
                flat = np.add.reduceat(m.table[slot[at]], begin, axis=0)
                flat[~m.allowed[_scripts(data, starts)]] -= 1e4
                first = np.searchsorted(doc, np.arange(n))
                count = np.bincount(doc, minlength=n)
                some = np.flatnonzero(count)
                label = viterbi(flat, first[some], count[some], penalty)
                size = ends - starts
                held = np.bincount(doc * k + label, weights=size, minlength=n * k).reshape(n, k)
                pred = np.where(ok & (count > 0), held.argmax(1), k)
                score = np.where(pred < k, held.max(1) / np.maximum(held.sum(1), 1), 0.0)
                if spans:
                    new = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]))
                    new = new[ok[doc[new]]]
                    stop = np.concatenate([new[1:], [len(label)]]) - 1 if len(new) else new
                    # a run ends with the last word before the next run of the same text, or with its text
                    stop = np.minimum(stop, first[doc[new]] + count[doc[new]] - 1) if len(new) else stop
                    a, b = common.char_positions(data, offs, starts[new], doc[new]), common.char_positions(data, offs, ends[stop], doc[new])
                    items = pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(names[label[new]], pa.string())], names=["start", "end", "lang"])
                    found = common.lists(items, np.bincount(doc[new], minlength=n))
            cols = {"doc_id": rows.column("doc_id"), "lang_pred": pa.array(names[pred], pa.string()), "score": pa.array(score)}
            if spans:
                cols["spans"] = found
            yield pa.RecordBatch.from_pydict(cols)

    return run


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, spans array<struct<start, end, lang>> in code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages numbers, whatever the input
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * spans
    return docs.select("doc_id", "text").mapInArrow(_label_task(shared, penalty, spans), schema)


def detect(docs: DataFrame, per_lang: int = PER_LANG, spans: bool = False) -> DataFrame:
    """Trains on the rows outside the held-out fold and labels every document."""
    model = train(docs.where(~common.held_out(F.col("doc_id"))), per_lang)
    return identify(docs, model, spans=spans).withColumn("held_out", common.held_out(F.col("doc_id")))


def keep_known(docs: DataFrame, per_lang: int = PER_LANG, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents whose language is known and holds at least `min_score` of their letters; all columns stay."""
    # written, so that Spark knows its size: few ids are broadcast and the texts stay where they are
    gone = cut_lineage(detect(docs, per_lang).where((F.col("lang_pred") == "und") | (F.col("score") < min_score)).select("doc_id"), "rejected")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
