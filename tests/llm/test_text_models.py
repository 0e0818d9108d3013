"""Language ID, toxicity and personal data: brute force, held-out accuracy and odd tables."""

import itertools
import random
import re

import numpy as np
import pytest

from runlens.llm import lang_id, pii, toxicity

SYLLABLES = {"aa": ["ta", "lo", "mi", "ren"], "bb": ["sch", "ung", "ver", "ach"], "ru": ["при", "вет", "да", "но"]}


def text(lang, n, r):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    return [(i, text(lang, r.randint(3, 60), r), lang) for i, lang in enumerate(r.choices(list(SYLLABLES), k=240))]


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([1, 5, 3, 6])
    scores = rng.normal(size=(counts.sum(), 3)) * 3
    first = np.cumsum(counts) - counts
    got = lang_id.viterbi(scores, first, counts, 2.5)
    value = lambda s, p: sum(s[i, k] for i, k in enumerate(p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))
    for f, n in zip(first, counts, strict=True):
        s = scores[f : f + n]
        best = max(value(s, p) for p in itertools.product(range(3), repeat=int(n)))
        assert value(s, got[f : f + n].tolist()) == pytest.approx(best)


def test_languages_and_spans(make, corpus):
    schema = "doc_id long, text string, lang string"
    model = lang_id.train(make(corpus, schema))
    out = {r["doc_id"]: r for r in lang_id.identify(make(corpus, schema), model).collect()}
    assert np.mean([out[i]["lang_pred"] == lang for i, _, lang in corpus]) > 0.97
    r = random.Random(8)
    one, two = text("aa", 40, r), text("bb", 30, r)
    mixed = lang_id.identify(make([(1, one + ". " + two), (2, None), (3, "123 -- !"), (4, "“”…"), (5, ""), (6, "Привет, ДА"), (7, one * 3000)]), model)
    got = {x["doc_id"]: x for x in mixed.collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [(0, len(one), "aa"), (len(one) + 2, len(one) + 2 + len(two), "bb")]
    assert got[1]["lang_pred"] == ("aa" if len(re.findall(r"\w", one)) >= len(re.findall(r"\w", two)) else "bb") and 0.5 <= got[1]["score"] < 1
    assert all((got[k]["lang_pred"], got[k]["score"], got[k]["spans"]) == ("und", 0.0, []) for k in (2, 3, 4, 5))
    assert got[6]["lang_pred"] == "ru" and got[7]["lang_pred"] == "aa"


def test_language_stage(make, corpus):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(*c, "x") for c in corpus] + [(900, None, None, None), (901, "12", "aa", None), (902, "talo", None, None)]
    kept = lang_id.keep_known(make(rows, schema))
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    assert {r["doc_id"] for r in kept.collect()} == {c[0] for c in corpus} | {902}
    assert lang_id.detect(make([], schema)).count() == 0
    assert [r["lang_pred"] for r in lang_id.detect(make([(1, "abc", None, None)], schema)).collect()] == ["und"]


def brute_segments(scores):
    """Ruzzo and Tompa by definition: take the best segment (shortest on ties), then treat what is left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i, j = -best[2], -best[2] - best[1]
    shift = [(a + j, b + j, v) for a, b, v in brute_segments(scores[j:])]
    return brute_segments(scores[:i]) + [(i, j - 1, best[0])] + shift


@pytest.mark.parametrize("seed", range(40))
def test_segments_equal_definition(seed):
    r = random.Random(seed)
    s = [r.choice([-3, -2, -1, 1, 2, 3, 4]) + r.random() / 100 for _ in range(r.randint(1, 25))]
    total = np.concatenate([[0.0], np.cumsum(s)])
    pos = [i for i, x in enumerate(s) if x > 0]
    got = [(pos[a], pos[b], v) for a, b, v in toxicity.maximal_segments([total[i] for i in pos], [total[i + 1] for i in pos])]
    want = brute_segments(s)
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_toxicity_held_out(make):
    r = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        ws = r.choices(words, k=r.randint(5, 120))
        bad = r.random() < 0.3
        if bad:
            for _ in range(r.randint(2, 5)):
                ws.insert(r.randrange(len(ws)), r.choice(["grunk", "blarg", "snee"]))
        rows.append((i, " ".join(ws), "x"))
        labels.append((i, int(bad)))
    rows += [(2000, None, None), (2001, "", None), (2002, "grunk blarg snee " * 20_000, None)]
    docs, marks = make(rows, "doc_id long, text string, score string"), make([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    out = {x["doc_id"]: x for x in toxicity.detect(docs, marks).collect()}
    held = [(out[i]["predicted"], y) for i, y in labels if out[i]["held_out"]]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.95
    assert out[2000]["predicted"] == out[2001]["predicted"] == 0 and out[2002]["predicted"] == 1
    p = out[2002]["passages"][0]
    assert p["start"] == 0 and p["end"] == len("grunk blarg snee " * 20_000) - 1
    assert toxicity.detect(make([], "doc_id long, text string"), marks).count() == 0
    assert all(x["score"] < 1e-6 for x in toxicity.detect(docs, make([], "doc_id long, toxic int")).collect())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(t):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
            return 16 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if ok(k, m[0])]


@pytest.mark.parametrize("seed", range(60))
def test_base_spans_equal_plain_patterns(seed):
    r = random.Random(seed)
    bits = ["a", "b.c", "@", "x@y.z", "1", "255", "256", ".", " ", "-", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "10.0.0.1", "+1 (212) 555-0100", "é", "_", "%", "\n", "007", "@@", ".com"]
    t = "".join(r.choices(bits, k=r.randint(1, 60)))
    assert pii.base_spans(t) == plain_base(t), t


def test_pii_adds_and_never_touches(make, spark):
    model = pii.train_from(pii.training_table(spark))
    rows = [(1, "please ring (212) 555-0177 after lunch"), (2, None), (3, ""), (4, "word " * 50_000 + "mail bob.k@mail.example.com now"), (5, "+1 (212) 555-0100 and 4111 1111 1111 1111"), (6, "in 1999 we had 12 apples"), (6, "in 1999 we had 12 apples")]
    out = [r for r in pii.find(make(rows), model).collect()]
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 7 and by[1]["spans"] == "phone:12:26" and by[1]["n_phone"] == 0 and by[1]["n_added"] == 1
    assert by[4]["spans"] == f"email:{250_005}:{250_005 + 22}" and by[4]["n_email"] == 1
    assert (by[2]["spans"], by[3]["spans"], by[6]["spans"]) == ("", "", "")
    assert (by[5]["n_phone"], by[5]["n_card"]) == (1, 1) and by[5]["spans"].count(":") == 4
    assert pii.find(make([]), model).count() == 0


def test_crf_decoding_equals_enumeration():
    rng = np.random.default_rng(3)
    k = len(pii.LABELS)
    m = pii.Model({f"f{i}": i for i in range(6)}, rng.normal(size=(6, k)) * 2, rng.normal(size=(k, k)) + pii._moves())
    windows = [([[f"f{rng.integers(6)}"] for _ in range(n)], [bool(rng.integers(2)) for _ in range(n)]) for n in (1, 2, 4, 3)]

    def value(w, path):
        e = 0.0 if pii.LABELS[path[0]][0] != "I" else -1e9
        for t, (f, free) in enumerate(zip(*w, strict=True)):
            e += m.emit[m.index[f[0]], path[t]] if free else (0.0 if path[t] == 0 else -1e9)
            e += m.move[path[t - 1], path[t]] if t else 0.0
        return e

    for w, path in zip(windows, pii.decode(m, windows), strict=True):
        assert value(w, path) == pytest.approx(max(value(w, p) for p in itertools.product(range(k), repeat=len(path))))


def test_windows_hold_all_words_near_triggers():
    r = random.Random(6)
    for _ in range(200):
        t = "".join(r.choices(["a ", "bb ", "1 ", "c@d ", "\n", "x2", "  ", "e"], k=r.randint(0, 40)))
        words = [m.span() for m in re.finditer(r"\S+", t)]
        hot = [any(c == "@" or c.isdigit() for c in t[a:b]) for a, b in words]
        got = [b for w in pii.text_windows(t) for b in w]
        assert got == sorted(set(got)) and set(got) <= set(words)
        assert {w for i, w in enumerate(words) if any(hot[max(0, i - 2) : i + 3])} <= set(got), t


def test_marked_rows_of_the_labelled_table_are_decoded(spark):
    """Every marked value that passes its kind's check, written-out addresses among them, is found in its own row."""
    model = pii.train_from(pii.training_table(spark))
    texts = [re.sub("</?(email|ip|card|phone)>", "", t) for t in pii.LABELLED]
    base = [pii.base_spans(t) for t in texts]
    for marked, text, fixed, more in zip(pii.LABELLED, texts, base, pii.added_spans(model, texts, base), strict=True):
        found = {(k, text[a:b]) for k, a, b in [*fixed, *more]}
        assert {(m[1], m[2]) for m in pii.MARK.finditer(marked) if pii.plausible(m[1], m[2])} <= found, marked
    assert "jo at example dot 1and1.com" in {t[a:b] for t, x in zip(texts, pii.added_spans(model, texts, base), strict=True) for _, a, b in x}


@pytest.mark.parametrize("address", ["bob (at) example.com", "info [at] example.net", "jo at example dot com", "bob at example.com"])
def test_written_out_addresses_get_free_windows(address):
    text = "word " * 30 + f"mail {address} for more" + " word" * 30
    a = text.index(address)
    free = {w for bounds, may in pii.free_windows(text) for w, f in zip(bounds, may, strict=True) if f}
    assert {(a + m.start(), a + m.end()) for m in re.finditer(r"\S+", address)} <= free
    assert not pii.free_windows("we met at the station that day and it was late. so")
