"""Every core query against its SQL in DuckDB."""
import duckdb
import pandas as pd
import pytest

from meshloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame) -> list[str]:
    cols = sorted(frame.columns)
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(str([plain(x.item() if hasattr(x, "item") else x) for x in r]) for r in frame[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["convergence_first_iteration", "stratified_sample", "epoch_permutation", "knn_tokens"])
def test_results_do_not_depend_on_partitions(spark, name):
    want = rows(QUERIES[name](spark, SF).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows(QUERIES[name](spark, SF).toPandas()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
