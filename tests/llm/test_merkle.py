"""The manifest against a plain tree, for blocks of any depth and odd tables."""
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from meshloom.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, idx long, node string, part int, height string"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, change=False):
    doc_id, source, lang, n, text = row[:5]
    if change and text is not None:
        text = text.replace("\n", "")
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])


def plain_tree(leaves):
    """The root, and of each leaf its steps (siblings left, siblings right)."""
    steps, now, under = [[] for _ in leaves], leaves, [[i] for i in range(len(leaves))]
    while len(now) > 1:
        runs = [list(range(a, min(a + 3, len(now)))) for a in range(0, len(now), 3)]
        for run in runs:
            for i in run:
                for x in under[i]:
                    steps[x].append(("".join(now[j] for j in run if j < i), "".join(now[j] for j in run if j > i)))
        now, under = [H(*[now[i] for i in run]) for run in runs], [[x for i in run for x in under[i]] for run in runs]
    return now[0], steps


def plain_manifest(rows):
    """Sorted result rows: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    by = {}
    for r in rows:
        by.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    sources = sorted(by)
    trees, out = {}, []
    for s in sources:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(plain_leaf(r))))
        trees[s] = own, *plain_tree([plain_leaf(r) for r in own])
    if not trees:
        return []
    root, upper = plain_tree([trees[s][1] for s in sources])
    for s, more in zip(sources, upper):
        own, subroot, steps = trees[s]
        for r, lower in zip(own, steps):
            at = plain_leaf(r, change=r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0)
            for a, b in lower + more:
                at = H(a, at, b)
            out.append((r[0], plain_leaf(r), subroot, root, H("".join(a + b for a, b in lower + more)), at, at == root))
    return sorted(out, key=str)


def odd_rows():
    rows = [(i, "hot", "en", i, f"line {i}\nand more\n") for i in range(300)]
    rows += [(1000 + i, f"s{i % 7}", None, None, None if i % 3 else "") for i in range(40)]
    rows += [(5, None, "x", 0, "a\nb"), (None, None, None, None, None), (2000, "one", "l", 3, "a-b"), (2001, "", "é", -4, "\n" * 50), (2002, "Ж", "l", 1, "-"), (2003, "z" * 90, "l", 1, "x" * 400_000 + "\n")]
    rows += [rows[4], rows[4], (4, "hot", "en", 4, "another text"), (None, None, None, None, None), (None, "hot", "q", 1, "w\nw")]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_query_equals_a_plain_tree(spark, tmp_path, monkeypatch, levels):
    rows = odd_rows()
    spark.createDataFrame([(*r, 1, 2, "n", 3, "h") for r in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(merkle.manifest, "__defaults__", (levels,))
    monkeypatch.setattr(merkle, "TASK_ROWS", 50)
    got = queries.op11_merkle(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 27, 28])
def test_trees_of_any_size(spark, n):
    leaves = spark.range(n).select(F.lit("s").alias("tree"), F.col("id"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("node"))
    got = merkle.manifest(leaves, ["id"], [], levels=2).orderBy("idx").collect()
    if not n:
        assert got == []
        return
    root, steps = plain_tree([H(str(i)) for i in range(n)])
    assert [r.subroot.hex() for r in got] == [root] * n == [r.root.hex() for r in got]
    assert [r.proof.hex() for r in got] == ["".join(a + b for a, b in s) for s in steps]


def test_a_changed_row_or_proof_is_seen(spark):
    leaves = spark.range(40).select(F.lit("s").alias("tree"), F.col("id"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("node"))
    rows = merkle.manifest(leaves, ["id"], [])
    text = lambda c: F.lower(F.hex(c))
    ok = rows.select((merkle.folded(text("node"), F.col("shape"), F.col("proof")) == text("root")).alias("same"), (merkle.folded(F.sha2(text("node").cast("binary"), 256), F.col("shape"), F.col("proof")) == text("root")).alias("leaf"),
                     (merkle.folded(text("node"), F.col("shape"), F.concat(F.expr("substring(proof, 33)"), F.expr("substring(proof, 1, 32)"))) == text("root")).alias("order")).collect()
    assert all(r.same and not r.leaf and not r.order for r in ok)
