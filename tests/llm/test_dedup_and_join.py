"""Exact dedup, the shingle join and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from runlens.llm import common, exact_dedup, ngram_join
from runlens.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def shingles(text, width=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)) if len(ws) >= width else frozenset([tuple(ws)])


def brute_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            n = len(x & y)
            if n and 100 * n >= 80 * (len(x) + len(y) - n):
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n=120):
    """Families of edited copies of many sizes, with shared passages, repeated lines and odd texts."""
    r = random.Random(seed)
    passage = " ".join(r.choices(WORDS, k=30))
    rows = []
    while len(rows) < n:
        base = r.choices(WORDS, k=r.choice([1, 3, 5, 6, 8, 12, 20, 40, 90, 200, 700]))
        if r.random() < 0.3:
            base[r.randrange(len(base)) :] = passage.split()
        for _ in range(r.choice([1, 1, 2, 5, 14])):
            edited = list(base)
            for _ in range(r.randrange(0, 1 + max(1, len(base) // 25))):
                at = r.randrange(len(edited))
                edited[at : at + 1] = r.choice([[], [r.choice(WORDS)], [edited[at], r.choice(WORDS)]])
            text = r.choice([" ", "\n", "  \t"]).join(edited)
            rows.append((len(rows) * 3 + 1, text.upper() if r.random() < 0.1 else text))
    return rows + [(10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "w1"), (10_005, "W1 ")]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(make, seed):
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(make(rows).repartition(3), range_rows=5000).collect()}
    assert out == brute_components(rows)


def test_join_with_crowded_chunks_and_chains(make):
    """A family where neighbours are similar but the ends aren't, and many copies in one chunk."""
    r = random.Random(9)
    base = r.choices(WORDS, k=120)
    rows = []
    for i in range(60):
        base[(i * 2) % 120] = f"x{i}"
        rows.append((500 - i, " ".join(base)))
    rows += [(1000 + i, "same words again and again in this text") for i in range(30)]
    out = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.similar_components(make(rows).coalesce(1)).collect()}
    assert out == brute_components(rows)


def test_pigeonhole_never_loses_a_pair():
    """Every similar pair shares an index and a probe signature, in each size region."""
    rng = np.random.default_rng(5)
    s = ngram_join.Schemes(4000)
    for n in [1, 2, 3, 4, 5, 7, 9, 13, 21, 34, 63, 64, 65, 80, 130, 400, 1500]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = a
            for _ in range(200):
                k = rng.integers(0, 3)
                c = np.delete(b, rng.integers(0, len(b))) if k and len(b) > 1 else b
                c = np.union1d(c, rng.integers(0, 2**64, 1, dtype=np.uint64)) if k != 1 else c
                if 100 * len(np.intersect1d(a, c)) < 80 * len(np.union1d(a, c)):
                    break
                b = c
            both, counts = np.concatenate([a, b]), np.array([len(a), len(b)])
            parts = [ngram_join.signatures(s, both, counts, low) for low in (False, True)]
            sig, own, role = (np.concatenate(x) for x in zip(*parts, strict=True))
            index = [set(sig[(own == i) & (role & 1 > 0)].tolist()) for i in (0, 1)]
            probe = [set(sig[(own == i) & (role & 2 > 0)].tolist()) for i in (0, 1)]
            assert index[0] & probe[1] or index[1] & probe[0], (n, len(a), len(b))


def test_join_empty_and_clashing_columns(make):
    assert ngram_join.similar_components(make([])).count() == 0
    rows = [(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 8, "y"), (None, "q r s", 1, None)]
    out = ngram_join.similar_components(make(rows, "doc_id long, text string, a int, component string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in out) == [(0, 0), (1, 1), (2, 1)]


def test_keep_one_keeps_columns(make):
    rows = [(3, "a b c d e f", "x"), (2, "a b c d e f", "y"), (5, None, "z")]
    assert sorted(map(tuple, ngram_join.keep_one(make(rows, "doc_id long, text string, component string")).collect())) == [(2, "a b c d e f", "y"), (5, None, "z")]


def test_components(make, spark):
    links = [(5, 4), (4, 9), (20, 21), (21, 22), (22, 23), (23, 24), (7, 7)]
    assert dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect())) == {4: 4, 5: 4, 9: 4, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}


def brute_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    return sorted((d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)


@pytest.mark.parametrize("block_rows", [1, 16, 1 << 18])
def test_exact_dedup_equals_brute_force(make, block_rows):
    r = random.Random(3)
    rows = [(i, r.choice([None, "", "a", "a ", "A", "é", "long " * 5000, f"t{i}", f"t{i // 3}"])) for i in range(300)]
    out = exact_dedup.exact_groups(make(rows).repartition(5), block_rows)
    assert sorted(map(tuple, out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == brute_exact(rows)


def test_exact_dedup_odd_tables(make):
    assert exact_dedup.exact_groups(make([])).count() == 0
    kept = exact_dedup.keep_one(make([(1, "a", 5), (1, "a", 5), (0, "a", 6), (4, "b", 7)], "doc_id long, text string, fp int"))
    assert sorted(map(tuple, kept.collect())) == [(1, "a", 5), (4, "b", 7)]


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 500).repeat(rng.integers(1, 4, 500))
    rng.shuffle(fp)
    parts = [x for cut in np.array_split(fp, 7) for x in exact_dedup.build_filters(3, flush=20)(iter([pa.RecordBatch.from_arrays([pa.array(cut)], names=["fp"])]))]
    table = pa.Table.from_batches(parts)
    found = {}
    for q in set(table.column("quotient").to_pylist()):
        out = exact_dedup.merge_filters(3)(table.filter(pa.compute.equal(table.column("quotient"), q)))
        found |= dict(zip(out.column("fp").to_pylist(), out.column("n").to_pylist(), strict=True))
    values, counts = np.unique(fp, return_counts=True)
    assert found == {int(v): int(c) for v, c in zip(values, counts, strict=True) if c > 1}


def test_word_hashes_do_not_depend_on_place():
    texts = ["alpha beta", "beta", "xx alpha", ""]
    for _, data, offs in common.chunks(iter([pa.RecordBatch.from_pydict({"text": texts})])):
        a, b, doc = common.words(data, offs, ~common.BLANK)
        h = common.Hashes(data).of(a, b).tolist()
        assert doc.tolist() == [0, 0, 1, 2, 2] and h[0] == h[4] and h[1] == h[2] and len(set(h)) == 3


def test_similar_components_give_one_row_for_each_row(make):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, long), (3, "other words that stand alone here now"), (None, long), (None, "nothing like any other text in here"), (4, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(make(rows)).collect()), key=repr)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 36, 3), (3, 3, 3), (None, 36, 3), (None, 3, None), (4, 0, 4)], key=repr)


def test_crowds_around_a_passage_are_not_paired(make, monkeypatch):
    """Long texts that share a passage and nothing else, and edited copies of one text: the pairs tried grow with the rows."""
    r = random.Random(4)
    passage = [f"p{i}" for i in range(500)]
    rows = [(i, " ".join(passage + [f"u{i}x{k}" for k in range(200)])) for i in range(60)]
    base = passage[:150] + [f"b{i}" for i in range(550)]
    for i in range(60, 75):
        edited = list(base)
        for at in r.sample(range(700), r.choice([0, 3, 8, 14, 25])):
            edited[at] = f"e{i}x{at}"
        rows.append((i, " ".join(edited)))
    r.shuffle(rows)
    tried = []
    plain = ngram_join.cut_lineage

    def counted(df, name):
        out = plain(df, name)
        if name in ("head-pairs", "open-pairs"):
            tried.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "cut_lineage", counted)
    out = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.similar_components(make(rows).repartition(3)).collect()}
    assert out == brute_components(rows)
    assert sum(tried) < 5 * len(rows)
