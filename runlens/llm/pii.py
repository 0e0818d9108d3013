"""Personal data: fixed patterns for four kinds, and a linear-chain conditional random field that adds what they miss.

The field labels blank-separated words with O or B/I of a kind, from features of word shape (letters, digits and signs of the
word and its neighbours, cue words before it). It is trained from a small labelled table by gradient ascent on the
regularised likelihood, and decoded by Viterbi over numpy batches of windows. A label other than O is allowed only on words
with a digit or an at sign and on their direct neighbours, and around a written-out at ((at), [at], or "at" with a "dot" or a word
with an inner dot among the next `REACH` words) on all words of it and two on either side. The windows (such words with
two words of context on either side) decode exactly as the whole text would. Added spans must pass the check of their kind and never touch a span of the fixed patterns.

Defined cases: null is empty; a text without findings has zero counts, the digest of the empty string and empty spans; equal
words give equal labels; further columns are ignored; texts of any length are read whole, windows are decoded in bounded batches.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from runlens.llm.common import bound_batches

#: Kinds in the order of the output.
KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]++(?:\.[0-9]++){3})|[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PHONE_TAIL = re.compile(r"[\x20().0-9-]+")
SEPARATORS = str.maketrans("", "", " -")
WORD = re.compile(r"\S+")
TRIGGER = re.compile("[0-9@]")
#: A written-out at: in brackets, or as a word that a "dot" or a word with an inner dot follows among `REACH` words.
REACH = 4
AT = re.compile(r"[aA][tT](?:(?<=\([aA][tT])\)|(?<=\[[aA][tT])\]|(?<!\S[aA][tT])(?!\S))")
DOT = re.compile(r"[(\[]?[dD][oO][tT][)\]]?")
DOTTED = re.compile(r"\S*+(?:\s++\S++){0,%d}?\s++(?:[(\[]?[dD][oO][tT][)\]]?(?!\S)|\S*?[^\s.]\.[^\s.]\S*+)" % (REACH - 1))
EDGE = "\"'`.,;:!?#*$%&|<>[]{}…«»„“”"
#: Windows of at most so many words, padding included, are decoded at once.
BATCH_WORDS = 20_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind that pass their check, by kind and start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[1].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].translate(SEPARATORS)
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", at, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return out


def shape(word: str) -> str:
    """Runs of capitals, letters and digits as A, a and 9 with their length up to 4; signs stay."""
    out, last, run = [], "", 0
    for c in word[:40]:
        k = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        run = run + 1 if k == last else 1
        if run <= 4:
            out.append(k)
        last = k
    return "".join(out)


def word_features(words: list[str]) -> list[list[str]]:
    core = [w.strip(EDGE) or w for w in words]
    shapes = [shape(w) for w in core]
    flat = [re.sub(r"(.)\1+", r"\1", s) for s in shapes]
    cue = [re.sub(r"[^a-z@]", "", w.lower())[:12] for w in core]
    out = []
    for i, w in enumerate(core):
        digits = sum(c.isdigit() for c in w)
        f = ["bias", "s=" + shapes[i], "f=" + flat[i], f"d={min(digits, 20)}", "at" if "@" in w else "no-at", "dots=" + str(min(w.count("."), 4)), "c=" + cue[i] if not digits else "c#"]
        for k in (-2, -1, 1, 2):
            j = i + k
            f.append(f"f{k}=" + (flat[j] if 0 <= j < len(core) else "-"))
            if k < 0:
                f.append(f"c{k}=" + (cue[j] if 0 <= j < len(core) else "-"))
        out.append(f)
    return out


@dataclass
class Model:
    index: dict[str, int]
    emit: np.ndarray  # features x labels
    move: np.ndarray  # labels x labels; forbidden moves are -1e9


def _moves() -> np.ndarray:
    """I of a kind follows B or I of the same kind only."""
    bad = np.zeros((len(LABELS), len(LABELS)))
    for j, b in enumerate(LABELS):
        for i, a in enumerate(LABELS):
            if b[0] == "I" and a[1:] != b[1:]:
                bad[i, j] = -1e9
    return bad


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(rows: list[tuple[list[str], list[str]]], steps: int = 120, decay: float = 0.02, rate: float = 0.15) -> Model:
    """Fits the field to (words, labels) rows by Adam on the log-likelihood with a quadratic penalty."""
    seqs = [(word_features(w), [LABELS.index(x) for x in y]) for w, y in rows]
    index: dict[str, int] = {}
    for fs, _ in seqs:
        for f in fs:
            for x in f:
                index.setdefault(x, len(index))
    data = [(np.array([[index[x] for x in f] for f in fs]), np.array(y)) for fs, y in seqs]
    bad = _moves()
    start_bad = np.where([x[0] == "I" for x in LABELS], -1e9, 0.0)
    emit, move = np.zeros((len(index), len(LABELS))), np.zeros(bad.shape)
    state = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    for step in range(1, steps + 1):
        ge, gm = -decay * emit, -decay * move
        for ids, y in data:
            e = emit[ids].sum(1)
            e[0] += start_bad
            m = move + bad
            n = len(y)
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[0] = e[0]
            for t in range(1, n):
                a[t] = e[t] + _logsum(a[t - 1][:, None] + m, 0)
            for t in range(n - 2, -1, -1):
                b[t] = _logsum(m + (e[t + 1] + b[t + 1])[None], 1)
            z = _logsum(a[-1], 0)
            p = np.exp(a + b - z)
            p[np.arange(n), y] -= 1
            np.add.at(ge, ids.ravel(), -np.repeat(p, ids.shape[1], 0))
            for t in range(1, n):
                gm -= np.exp(a[t - 1][:, None] + m + (e[t] + b[t])[None] - z)
                gm[y[t - 1], y[t]] += 1
        for w, g, k in ((emit, ge, 0), (move, gm, 2)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * g * g
            w += rate * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.99**step)) + 1e-8)
    return Model(index, emit, move + bad)


def decode(m: Model, windows: list[tuple[list[list[str]], list[bool]]]) -> list[list[int]]:
    """The best labels of each window (features of its words, whether a word may be other than O)."""
    out: list[list[int]] = [[] for _ in windows]
    order = sorted(range(len(windows)), key=lambda i: len(windows[i][0]))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * len(windows[order[j]][0]) <= BATCH_WORDS:
            j += 1
        part = order[i:j]
        steps, k = len(windows[part[-1]][0]), len(LABELS)
        e = np.zeros((len(part), steps, k))
        e[:, :, 1:] = -1e9
        for r, w in enumerate(part):
            for t, (fs, free) in enumerate(zip(*windows[w], strict=True)):
                if free:
                    ids = [x for f in fs if (x := m.index.get(f)) is not None]
                    e[r, t] = m.emit[ids].sum(0)
                # a word that must be O needs no score: it is the same on all paths
        v = e[:, 0] + np.where([x[0] == "I" for x in LABELS], -1e9, 0.0)
        back = np.zeros((len(part), steps, k), np.int8)
        for t in range(1, steps):
            s = v[:, :, None] + m.move[None]
            back[:, t] = s.argmax(1)
            v = s.max(1) + e[:, t]
        cur = v.argmax(1)
        path = np.zeros((len(part), steps), np.int8)
        for t in range(steps - 1, -1, -1):
            path[:, t] = cur
            cur = back[np.arange(len(part)), t, cur]
        for r, w in enumerate(part):
            out[w] = path[r, : len(windows[w][0])].tolist()
        i = j
    return out


def near_triggers(text: str) -> list[list[tuple[int, int]]]:
    """Word bounds of the windows of a text without a written-out at: words with a digit or an at sign and two words on either side; near ones are one window."""
    out: list[list[tuple[int, int]]] = []
    done = 0  # end of the last word taken
    m = TRIGGER.search(text)
    while m:
        first = m.start()
        while first > done and not text[first - 1].isspace():
            first -= 1
        left: list[tuple[int, int]] = []
        at = first
        while len(left) < 2:  # two words before it that no window holds yet
            while at > done and text[at - 1].isspace():
                at -= 1
            if at <= done:
                break
            end = at
            while at > done and not text[at - 1].isspace():
                at -= 1
            left.append((at, end))
        joined = bool(out) and len(left) < 2
        window = out[-1] if joined else []
        if not joined:
            out.append(window)
        done = WORD.match(text, first).end()
        window += [*reversed(left), (first, done)]
        right = 0
        while right < 2 and (w := WORD.search(text, done)):
            window.append(w.span())
            done = w.end()
            right = 0 if TRIGGER.search(w[0]) else right + 1
        m = TRIGGER.search(text, done)
    return out


def written_ats(text: str) -> list[tuple[int, int]]:
    """Places of the written-out ats, each up to the end of the dot or dotted word that follows it."""
    out = []
    for m in AT.finditer(text):
        far = DOTTED.match(text, m.end())
        if far or m[0][-1] in ")]":
            out.append((m.start(), far.end() if far else m.end()))
    return out


def free_windows(text: str) -> list[tuple[list[tuple[int, int]], list[bool]]]:
    """The windows, and which of their words may be other than O."""
    ats = written_ats(text)
    if not ats:
        windows = near_triggers(text)
        hot = [[TRIGGER.search(text, a, b) is not None for a, b in w] for w in windows]
        return [(w, [any(h[max(0, t - 1) : t + 2]) for t in range(len(h))]) for w, h in zip(windows, hot, strict=True)]
    words = [m.span() for m in WORD.finditer(text)]
    starts, n = [a for a, _ in words], len(words)
    free, inside = bytearray(n), bytearray(n)
    dot = lambda i: 0 <= i < n and DOT.fullmatch(text[slice(*words[i])].strip(EDGE)) is not None
    for a, b in ats:
        i, j = bisect_right(starts, a) - 1, bisect_left(starts, b)
        while i > 1 and (dot(i - 1) or dot(i - 2)):  # jo dot lee at
            i -= 1 if dot(i - 1) else 2
        while dot(j) or dot(j + 1):  # at mail dot example dot com
            j += 1 if dot(j) else 2
        for mark, k in ((free, 2), (inside, 4)):
            lo, hi = max(0, i - k), min(n, j + k)
            mark[lo:hi] = b"\1" * (hi - lo)
    for t, (a, b) in enumerate(words):
        if TRIGGER.search(text, a, b):
            for mark, k in ((free, 1), (inside, 2)):
                lo, hi = max(0, t - k), min(n, t + k + 1)
                mark[lo:hi] = b"\1" * (hi - lo)
    out = []
    at = inside.find(1)
    while at >= 0:
        end = inside.find(0, at)
        end = n if end < 0 else end
        out.append((words[at:end], [x == 1 for x in free[at:end]]))
        at = inside.find(1, end)
    return out


def text_windows(text: str) -> list[list[tuple[int, int]]]:
    """Word bounds of the windows."""
    return [bounds for bounds, _ in free_windows(text)]


def added_spans(m: Model, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    windows, places = [], []
    for i, text in enumerate(texts):
        for bounds, free in free_windows(text):
            windows.append((word_features([text[a:b] for a, b in bounds]), free))
            places.append((i, bounds))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, bounds), path in zip(places, decode(m, windows), strict=True):
        t = 0
        while t < len(path):
            label = LABELS[path[t]]
            stop = t + 1
            if label[0] == "B":
                while stop < len(path) and LABELS[path[stop]] == "I" + label[1:]:
                    stop += 1
                a, b = bounds[t][0], bounds[stop - 1][1]
                while a < b and texts[i][a] in EDGE:
                    a += 1
                while b > a and texts[i][b - 1] in EDGE:
                    b -= 1
                if plausible(label[2:], texts[i][a:b]) and all(b <= x or y <= a for _, x, y in base[i]):
                    out[i].append((label[2:], a, b))
            t = stop
    return out


def plausible(kind: str, found: str) -> bool:
    digits = "".join(c for c in found if "0" <= c <= "9")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "ip":
        parts = re.findall(r"[0-9]+", found)
        return len(parts) >= 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts[:4])
    return "@" in found or " at " in found.lower() or "(at)" in found.lower() or "[at]" in found.lower()


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def _find_task(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(m, texts, base)
                count = lambda k, base=base: pa.array([sum(s[0] == k for s in b) for b in base], pa.int64())
                cols = {"doc_id": part.column("doc_id")} | {f"n_{k}": count(k) for k in KINDS}
                cols["base_sha256"] = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
                cols["spans"] = pa.array([joined([*b, *x]) for b, x in zip(base, more, strict=True)])
                cols["n_added"] = pa.array([len(x) for x in more], pa.int64())
                yield pa.RecordBatch.from_pydict(cols)

    return run


def find(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts and digest of the fixed patterns, all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size follows the labelled table
    return bound_batches(docs).select("doc_id", "text").mapInArrow(_find_task(shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


MARK = re.compile(r"<(email|ip|card|phone)>(.*?)</\1>")


def labelled_rows(marked: list[str]) -> list[tuple[list[str], list[str]]]:
    """Words and labels of texts in which personal data stands between tags of its kind."""
    out = []
    for text in marked:
        words: list[str] = []
        labels: list[str] = []
        at = 0
        for m in [*MARK.finditer(text), None]:
            plain = text[at : m.start() if m else len(text)].split()
            words += plain
            labels += ["O"] * len(plain)
            if m:
                inside = m[2].split()
                words += inside
                labels += [f"B-{m[1]}"] + [f"I-{m[1]}"] * (len(inside) - 1)
                at = m.end()
        out.append((words, labels))
    return out


def training_table(spark: SparkSession) -> DataFrame:
    """The labelled table that ships with the operator: one column `marked`."""
    return spark.createDataFrame([(t,) for t in LABELLED], "marked string")


def train_from(table: DataFrame) -> Model:
    """Trains from a small labelled table with the column `marked` (at most a few thousand short rows)."""
    return train(labelled_rows([r["marked"] for r in table.select("marked").collect() if r["marked"]]))


#: The labelled table.
LABELLED = [
    "please call <phone>(212) 555-0173</phone> before noon",
    "phone <phone>212-555-0199</phone> or write",
    "tel. <phone>030 5550 1234</phone> und fragen",
    "her number is <phone>+44 20 7946 0958</phone> at work",
    "<phone>(415) 555-2671</phone>",
    "the office line <phone>(303) 555-0148</phone> is open",
    "fax <phone>617.555.0134</phone> was busy",
    "reach us at <phone>+1 (646) 555-0111</phone> any day",
    "mobile <phone>0171 5550123</phone> nur abends",
    "appelez le <phone>01 55 50 12 34</phone> demain",
    "llame al <phone>(91) 555-0147</phone> por favor",
    "there were 212 people and 555 chairs in 2019",
    "in 1998 and 2004 the price rose by 12 percent",
    "see page 1234567 of the index",
    "order 4111-22 was late by 14 days",
    "the code 0171 is not a number to call",
    "chapter 3 of 12 has 450 lines",
    "on 12.05.2019 we met at 10.30",
    "version 2.10.3 came after 2.9",
    "between 10 and 20 of the 300 samples",
    "write to <email>ann.lee@example.org</email> today",
    "mail <email>bob (at) example.com</email> for more",
    "mail <email>info [at] example.net</email> instead",
    "<email>c.diaz7@mail.example.es</email> answered",
    "kontakt <email>max@firma.example</email> bitte",
    "contact <email>jo at example dot 1and1.com</email> soon",
    "she looked at 3 pictures at 10 o'clock",
    "the price @ 20 each was fair",
    "meet @noon or later with 2 friends",
    "host <ip>10.20.30.40</ip> is down",
    "from <ip>192.0.2.17</ip> to <ip>198.51.100.23</ip> again",
    "server at <ip>203.0.113.9</ip> replied",
    "ping <ip>172.16.254.1</ip> twice",
    "the ratio 10.5 and 20.25 differ",
    "section 4.2.1 and 4.2.2 agree",
    "card <card>4111 1111 1111 1111</card> expired",
    "paid with <card>5500-0000-0000-0004</card> yesterday",
    "number <card>4012888888881881</card> was refused",
    "amex <card>3782 822463 10005</card> on file",
    "the id 9807915762804491 is internal",
    "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff was found",
    "sum of 1000000 and 2500000 units",
    "sha 9b0b3c6a43eb78aa99cbd7049c572391 of the file",
    "room 101, floor 12, gate 7",
    "population 8,336,817 in 2021",
    "call extension 4417 inside",
    "dial <phone>555-0102</phone> for help",
    "<phone>(499) 555-6503</phone> thion erly",
    "nderre <phone>(017) 555-7713</phone> rethsh on",
    "the and 555 of 499 thion",
]
