"""The pipeline against brute-force versions of its stages, on the smallest table."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from meshloom.llm.common import table  # noqa: E402

from .test_llm import brute_classes, brute_passages, brute_statistics  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_do_what_brute_force_does(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, last = docs.columns, docs.collect()
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        now = docs.collect()
        if name != "tokens":
            assert docs.columns == columns
        before = {r.doc_id: r for r in last}
        if name == "quality":
            assert {r.doc_id for r in now} <= {r.doc_id for r in last if not brute_statistics(r.text)[-1]} and len(now) > 0.5 * len(last)
        if name == "near_copies":
            assert sorted(r.doc_id for r in now) == sorted({c for (_, c, _) in brute_classes([(r.doc_id, r.text) for r in last])})
        if name == "passages":
            removed = {i: (n, m) for (i, n, m, _) in brute_passages([(r.doc_id, r.text) for r in last])}
            assert {r.doc_id for r in now} == {i for i, (n, m) in removed.items() if m < n or not n}
            assert all(len(r.text.split()) == removed[r.doc_id][0] - removed[r.doc_id][1] and r.n_chars == len(r.text) for r in now if removed[r.doc_id][1])
            assert all(r.text == before[r.doc_id].text for r in now if not removed[r.doc_id][1])
        if name == "benchmark_free":
            items = [r.text for r in table(spark, SF, "benchmark").collect()]
            assert {r.doc_id for r in now} == {r.doc_id for r in last if not any(t in r.text for t in items)}
        kept[name], last = len(now), now
    assert kept["tokens"] == kept["benchmark_free"] == len({r.doc_id for r in last})


def test_run_ends_with_tokens(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def prose(k: int, n: int) -> str:
    return " ".join(f"w{(k * 7919 + i * i) % 9973}" for i in range(n))


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, repeated rows, one id with two texts, and clashing columns."""
    folder = str(tmp_path_factory.mktemp("odd"))
    shared = prose(1, 70)
    texts = {1: prose(2, 90), 2: f"{prose(3, 60)} {shared}", 3: f"{shared} {prose(4, 60)}", 4: None, 5: "", 6: prose(5, 90), 7: prose(6, 90) + " end", 8: shared, 9: " ".join(f"long{i}" for i in range(40_000)), 10: "short"}
    rows = [(i, t) for i, t in texts.items()] + [(6, prose(7, 90)), (6, prose(7, 90)), (1, texts[1]), (None, prose(8, 90))]
    out = spark.createDataFrame([(i, t, "en", "web", len(t or ""), 1, 2, "r", "h", True, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, n_removed int, n_words int, rest string, own_id string, kept boolean, class_id int")
    out.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(2, None, 0), (3, 1, None), (99, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, texts[7][:200]), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_take_odd_rows_and_clashing_columns(spark, odd_folder, tmp_path):
    docs = table(spark, odd_folder, "documents")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, odd_folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "tokens":
            assert docs.columns == columns
            seen.append(sorted(r.doc_id for r in docs.collect()))
        if name == "passages":
            by = {}
            for r in docs.collect():
                by.setdefault(r.doc_id, []).append(r)
            assert by[3][0].text == prose(4, 60) and by[3][0].n_chars == len(prose(4, 60)) and by[3][0].rest == "r"
            assert sorted(r.text for r in by[6]) == sorted([prose(5, 90), prose(7, 90), prose(7, 90)])
    assert seen == [[1, 1, 2, 3, 6, 6, 6, 7, 8, 9], [1, 1, 2, 3, 6, 6, 6, 7, 8, 9], [1, 1, 2, 3, 6, 6, 6, 7, 9], [1, 1, 2, 3, 6, 6, 6, 9]]
    assert docs.count() == 8


def test_stages_take_empty_tables(spark, odd_folder, tmp_path):
    folder = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        table(spark, odd_folder, name).limit(0).write.parquet(f"{folder}/{name}.parquet")
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0
    kept = corpus_pipeline.STAGES[0][1](spark, table(spark, odd_folder, "documents"), folder)
    assert kept.count() == 10  # without labels the base filter alone decides


def test_passages_keep_a_table_in_which_none_repeats(spark, tmp_path):
    rows = [(i, prose(i + 1, 60 + i), "en", "web", 1) for i in range(4)]
    spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert sorted(tuple(r) for r in dict(corpus_pipeline.STAGES)["passages"](spark, docs, SF).collect()) == rows
