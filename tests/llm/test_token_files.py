"""Token files: exact round trips of the coder, damaged blocks, and whole files against the tokenizer itself."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runlens.llm import token_files as t
from runlens.llm.queries import op12_token_files, tokenizer_path

SCHEMA = "doc_id long, text string"


def model_of(ids):
    values, counts = np.unique(ids, return_counts=True)
    return t.Model(*t.scaled(dict(zip(values.tolist(), counts.tolist(), strict=True))))


@pytest.mark.parametrize("n", [1, 127, 128, 129, t.CHECKPOINT_ROWS * t.LANES, t.BLOCK_TOKENS - 1, t.BLOCK_TOKENS, 3 * t.BLOCK_TOKENS + 70, 11 * t.BLOCK_TOKENS + 5])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.2, n) % 60_000).astype(np.uint32)
    model = model_of(ids)
    blocks = model.encode(ids)
    assert len(blocks) == -(-n // t.BLOCK_TOKENS)
    assert np.array_equal(np.concatenate(model.decode(blocks)), ids)
    one = blocks[-1]
    tail = ids[(len(blocks) - 1) * t.BLOCK_TOKENS :]
    for first, last in ((0, 1), (len(tail) // 3, len(tail) // 2 + 1), (len(tail) - 1, len(tail)), (0, 10**9), (5, 5)):
        assert np.array_equal(model.decode_range(one, first, last), tail[first:last])


def test_single_id_costs_nothing_but_states():
    ids = np.full(t.BLOCK_TOKENS, 70_000, np.uint32)
    model = model_of(ids)
    (block,) = model.encode(ids)
    assert np.array_equal(model.decode([block])[0], ids) and len(block) < 5_000


def test_size_is_near_the_entropy():
    rng = np.random.default_rng(3)
    ids = rng.choice(200, p=np.arange(1, 201) / 20_100, size=4 * t.BLOCK_TOKENS).astype(np.uint32)
    p = np.bincount(ids) / len(ids)
    bits = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids)
    assert sum(map(len, model_of(ids).encode(ids))) * 8 < 1.08 * bits


def test_rare_ids_keep_a_slot():
    counts = {0: 10**12} | {i: 1 for i in range(1, 40_000)}
    ids, freq = t.scaled(counts)
    assert sum(freq) == 1 << t.SCALE_BITS and min(freq) == 1 and ids == sorted(counts)
    with pytest.raises(ValueError):
        t.scaled({i: 1 for i in range(600_000)})


def test_damage_is_seen():
    ids = np.random.default_rng(0).integers(0, 50, t.BLOCK_TOKENS).astype(np.uint32)
    model = model_of(ids)
    (block,) = model.encode(ids)
    for at in (0, 6, t.HEADER.size + 2, t.HEADER.size + 40, len(block) - 3):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            model.decode([bytes(bad)])
    for cut in (block[:10], block[:-4], b""):
        with pytest.raises(ValueError):
            model.decode([cut])
    other = model_of(np.arange(50, dtype=np.uint32))
    with pytest.raises(ValueError):
        other.decode([block])


def test_checksums_of_pieces_add_up():
    data = np.random.default_rng(2).bytes(10_007)
    for cuts in ([0, 10_007], [0, 1, 4_000, 10_006, 10_007]):
        got = 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            got ^= t.moved(zlib.crc32(data[a:b]), len(data) - b)
        assert got == zlib.crc32(data)


def plain(rows):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def run(spark, tmp_path, rows, extra=None):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    (df.withColumns(extra) if extra else df).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted(map(tuple, op12_token_files(spark, str(tmp_path)).collect()), key=lambda r: r[1])


def test_files_against_the_tokenizer(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = ["alpha", "Bravo's", "été", "12.5", "naïve", "x" * 40, "\t", "日本語", "<|endoftext|>", "don't", "áb"]
    rows = [(int(i), " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(0, 300, 200))]
    rows.append((77_000, "cut over several blocks " * 60_000))
    rows.append((-5, ""))
    assert run(spark, tmp_path, rows) == plain(rows)


def test_defined_cases(spark, tmp_path):
    rows = [(None, "no id"), (2, None), (2, "same id, another text"), (3, "twice"), (3, "twice"), (1, "")]
    got = run(spark, tmp_path, rows, {c: F.lit(1) for c in ("ids", "part", "k", "hash_", "salt_", "start", "n_tokens")})
    want = plain([(None, "no id"), (1, ""), (2, None), (2, "same id, another text"), (3, "twice"), (3, "twice")])
    assert [(r[0], r[2], r[3]) for r in got if r[0] != 2] == [(r[0], r[2], r[3]) for r in want if r[0] != 2]
    assert {r[2:] for r in got if r[0] == 2} == {r[2:] for r in want if r[0] == 2}
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_ids_come_back_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(9, "b c"), (4, "long text " * 40_000), (6, None)], SCHEMA)
    path = str(tmp_path / "files")
    t.write(docs, path, tokenizer_path())
    got = t.documents_ids(spark, path).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert [r.doc_id for r in got] == [4, 6, 9]
    assert [list(r.ids) for r in got] == [[*tokenizer.encode(x, add_special_tokens=False).ids, 1] for x in ("long text " * 40_000, "", "b c")]


def test_ids_beyond_two_bytes():
    for ids in ([1, 65_535], [1, 65_536, 2**31]):
        a = np.array(ids, np.uint32)
        raw = a.astype("<u2").tobytes() if a.max() < 1 << 16 else b"\x01" + a.astype("<u4").tobytes()
        assert t._ids(raw).tolist() == ids
