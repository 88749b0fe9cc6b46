"""Fill-in-the-middle against a plain version, text by text."""
import hashlib
import re

import pytest

from meshloom.llm import fill_middle, queries

SCHEMA = "doc_id long, text string, n int, key string, first long, a int, output string"


def plain(doc_id, text, seed=7, unit=r"[^\n]*\n|[^\n]+", share=100, spm=50, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(unit, text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in marks) or h[2] % 100 >= share:
        return doc_id, n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc_id, n, form, len(pre), len(mid), p + pre + s + suf + m + mid if form == "psm" else s + suf + p + pre + m + mid


def odd_rows():
    texts = [None, "", "\n", "\n\n\n", "one line", "one line\n", "a\n\nb", "é\n€uro 😀\nzz", "with <P> mark\n\n", "<S>", "x<M", "<P\n>\nS>\n<", "\r\n\x0b\n \n", "w" * 300_000, "line of some length\n" * 60_000, "a\n" * 7 + "b"]
    rows = [(i, t) for i, t in enumerate(texts * 12)]
    return [*rows, rows[7], rows[7], rows[14], rows[1], (None, "a\nb\nc\n"), (None, None), (7, "other\ntext\nof 7"), (7, "more\n")]


def test_cuts_equal_the_plain_version(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, 1, "k", 2, 3, "o") for i, t in rows], SCHEMA).repartition(4)
    got = fill_middle.transform(docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((plain(*r) for r in rows), key=str)
    back = got.select("doc_id", fill_middle.restored(got["output"], got["form"])).collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


@pytest.mark.parametrize("spm", [0, 100])
def test_other_units_marks_and_shares(spark, spm):
    rows = [(i, t) for i, t in enumerate(["a b  c", "", "word", "one two three four five six", "x " * 500] * 20)]
    how = {"unit": r"\s*\S+\s*", "seed": 3, "share": 60, "spm": spm, "marks": ("[[", "]]", "||")}
    got = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"), **how)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((plain(*r, **how) for r in rows), key=str)
    assert {r.form for r in got.collect()} == {"plain", "spm" if spm else "psm"}
    back = got.select(fill_middle.restored(got["output"], got["form"], how["marks"])).collect()
    assert sorted(r[0] for r in back) == sorted(t for _, t in rows)


def test_empty_table_and_one_shuffle_of_texts(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_fill_middle(spark, str(tmp_path))
    assert out.collect() == []
    texts = [line for line in fill_middle.transform(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert len(texts) == 3  # units, requests, texts
