"""Canonical views of the test tables: points, series, pool and log lines, as DataFrames and as SQL for the checks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIMS = [("x", 0), ("y", 1), ("z", 2), ("nx", 4), ("ny", 5), ("nz", 6), ("ux", 7), ("uy", 8), ("uz", 9), ("cp", 10), ("p_ux", 13), ("p_uy", 14), ("p_uz", 15), ("p_cp", 16)]
_ABS = [("wall_dist", 3, "*5"), ("k", 11, "*0.01"), ("eps", 12, "*0.01"), ("p_k", 17, "*0.01"), ("p_eps", 18, "*0.01"), ("cell_size", 19, "+0.001")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _point_columns(base: int) -> str:
    at = lambda i: f"cast(embedding[{i + base}] as double)"
    return ", ".join(["label as case_id", "vec_id as point_id", *[f"{at(i)} as {n}" for n, i in _DIMS], *[f"abs({at(i)}){s} as {n}" for n, i, s in _ABS]])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per mesh point of ten cases."""
    return table(spark, sf_dir, "embeddings").selectExpr(*_point_columns(0).split(", "))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, name, it, value: per run and quantity the iterations 1, 2, ..."""
    return table(spark, sf_dir, "events").selectExpr("user_id as run_id", "event_type as name", "cast(row_number() over (partition by user_id, event_type order by ts, event_id) as double) as it", "value", "event_id")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.substring(F.md5(F.concat(F.lit("split|"), F.col("o_orderkey").cast("string"))), 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("tier"), F.col("o_custkey").alias("family"),
        F.when(split < "c", "train").when(split < "e", "val").otherwise("test").alias("split"),
        F.concat(F.lit("/shards/"), F.col("o_orderkey").cast("string"), F.lit(".npz")).alias("shard"), F.col("o_totalprice").alias("n_points"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as case_id", "l_orderkey", "l_linenumber", "l_quantity / 50 as x", "l_discount * 10 as y", "l_tax * 10 as z", "l_extendedprice as truth", "l_extendedprice * (1 - l_discount) as pred", "l_quantity as w")


_LINE = ("case when event_type = 'signup' then concat('Time = ', cast(event_id as {s})) else concat('smoothSolver:  Solving for ', event_type, "
         "', Initial residual = ', cast(cast(round(value * 1000) as bigint) as {s}), 'e-6, Final residual = 1e-9, No Iterations 2') end")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id as run_id", "event_id as line_no", _LINE.format(s="string") + " as line")


SQL = {
    "points": f"points as (select {_point_columns(1)} from embeddings)",
    "series": "series as (select user_id as run_id, event_type as name, cast(row_number() over (partition by user_id, event_type order by ts, event_id) as double) as it, value, event_id from events)",
    "pool": "pool as (select o_orderkey as case_id, o_orderpriority as source, o_orderstatus as tier, o_custkey as family, case when substr(md5('split|' || cast(o_orderkey as varchar)), 1, 1) < 'c' then 'train' when substr(md5('split|' || cast(o_orderkey as varchar)), 1, 1) < 'e' then 'val' else 'test' end as split, '/shards/' || cast(o_orderkey as varchar) || '.npz' as shard, o_totalprice as n_points from orders)",
    "wide": "wide as (select l_suppkey as case_id, l_orderkey, l_linenumber, l_quantity / 50 as x, l_discount * 10 as y, l_tax * 10 as z, l_extendedprice as truth, l_extendedprice * (1 - l_discount) as pred, l_quantity as w from lineitem)",
    "lines": f"lines as (select user_id as run_id, event_id as line_no, {_LINE.format(s='varchar')} as line from events)",
}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """body behind the named views; body may begin with further common tables after a comma."""
    return f"with {'recursive ' if recursive else ''}{', '.join(SQL[v] for v in views)} {body}"


def over(df: DataFrame, name: str, text: str) -> DataFrame:
    """SQL text in which `from name` means df; no view stays in the session."""
    return df.sparkSession.sql(text.replace("{", "{{").replace("}", "}}").replace(f"from {name}", f"from {{{name}}}"), **{name: df})
