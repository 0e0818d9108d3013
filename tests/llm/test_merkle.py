"""Merkle manifest against a plain recursive version, over trees that span blocks, and its defined cases."""

import hashlib
import zlib

from pyspark.sql import functions as F

from runlens.llm import merkle
from runlens.llm.queries import op11_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, pos):
    """(side, sibling) of each level."""
    return [(pos >> k & 1, nodes[(pos >> k) ^ 1] if (pos >> k) ^ 1 < len(nodes) else "") for k, nodes in enumerate(tree[:-1])]


def plain(rows):
    """Sorted result rows of the contract."""
    rows = [(r, leaf((r[0], r[1], r[2], r[3], r[4]))) for r in rows]
    langs = sorted({r[2] for r, _ in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {x: sorted([y for y in rows if y[0][2] == x], key=lambda y: (y[0][0] is not None, y[0][0] or 0, y[1])) for x in langs}
    trees = {x: levels([y[1] for y in members[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for t, x in enumerate(langs):
        for p, (r, own) in enumerate(members[x]):
            steps = path(trees[x], p) + path(top, t)
            odd = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((r[0], r[1], r[2], r[3] + 1, r[4])) if odd else own
            for side, s in steps:
                now = h(s, now) if side else h(now, s)
            out.append((r[0], own, trees[x][-1][0], top[-1][0], h(*[s for _, s in steps]), now, now == top[-1][0]))
    return sorted(out, key=repr)


def run(spark, tmp_path, rows, extra=None):
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumns(extra) if extra else df
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return sorted([tuple(r) for r in op11_merkle_manifest(spark, str(tmp_path)).collect()], key=repr)


def test_trees_over_several_blocks(spark, tmp_path):
    n = merkle.BLOCK
    rows = [(i * 7 % 99991, f"s{i % 3}", "en" if i < 2 * n + 5 else f"l{i % 2}", i, "text " * (i % 9)) for i in range(2 * n + 40)]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_full_block_and_one_more(spark, tmp_path):
    n = merkle.BLOCK
    rows = [(i, None, "a" if i < n else "b", None if i % 5 else i, f"é{i}") for i in range(2 * n + 1)]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_defined_cases(spark, tmp_path):
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (3, "s", None, 5, ""), (1, "s", "é", 9223372036854775807, "long " * 50_000), (1, "s", "é", 4, "other text of the id"),
        (1, "s", "é", 4, "other text of the id"), (15, "s", "z", None, "x"), (-4, "", "", 0, "zero"), *[(k, "s", "only", 1, "t") for k in range(40, 43)]]
    got = run(spark, tmp_path, rows, {c: F.lit("x") for c in ("tree", "pos", "hash", "part", "k", "siblings", "level", "key", "leaf", "root", "up")})
    assert got == plain(rows)


def test_one_row_and_no_row(spark, tmp_path):
    rows = [(5, "s", "en", 1, "t")]
    (tmp_path / "a").mkdir()
    assert run(spark, tmp_path / "a", rows) == plain(rows)
    (tmp_path / "b").mkdir()
    assert run(spark, tmp_path / "b", []) == []


def test_every_proof_leads_to_the_root_and_no_forged_one_does(spark, tmp_path):
    rows = [(i, "s", f"l{i % 3}", i, f"text {i}") for i in range(200)]
    got = run(spark, tmp_path, rows)
    assert {r[0] for r in got if not r[6]} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 0}


def test_other_fields_and_groups(spark):
    df = spark.createDataFrame([("b", 1.5, 2), ("a", 2.5, 2), ("c", None, 3)], "name string, x double, kind int")
    proofs = merkle.manifest(df, key="name", group="kind", fields=("name", "x"))
    got = {r.name: r.leaf for r in merkle.verify(proofs, "name").collect()}
    assert got == {"a": leaf(("a", 2.5)), "b": leaf(("b", 1.5)), "c": leaf(("c", None))}
    assert all(r.verified for r in merkle.verify(proofs, "name").collect())
