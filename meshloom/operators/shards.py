"""Building shards as a job that can be broken off and run again: a manifest decides what is still to do."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import cut
from .sampling import stratified

MANIFEST = "case_id string, split string, digest string, n_points long, n_kept long, error string, batch long"


def job_digest(params: dict[str, object], *columns: str) -> F.Column:
    """What a case's shard depends on: its own columns (such as the digest of its file) and the job's parameters."""
    fixed = ";".join(f"{k}={params[k]!r}" for k in sorted(params))
    return F.sha2(F.concat_ws("|", F.lit(fixed), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), 256)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """Of each case the row of its last batch; no row before the first run."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)
    last = rows.groupBy("case_id").agg(F.max_by(F.struct("split", "digest", "n_points", "n_kept", "error", "batch"), "batch").alias("x"))
    return last.select("case_id", "x.*")


def pending(jobs: DataFrame, out: str) -> DataFrame:
    """The jobs (case_id, split, digest) without a row of the same digest and without an error in the manifest."""
    done = manifest(jobs.sparkSession, out).where("error is null").select("case_id", "digest")
    return jobs.join(done, ["case_id", "digest"], "left_anti")


def thinned(points: DataFrame, jobs: DataFrame, n_keep: int, seed: int, indicator: F.Column) -> DataFrame:
    """Points of the training cases by strata (sampling.stratified), of all other cases whole, with their stratum."""
    split = points.join(jobs.select("case_id", "split"), "case_id")
    train = stratified(split.where("split = 'train'"), ["case_id"], n_keep, seed, indicator)
    rest = split.where("split <> 'train'")
    whole = rest.withColumn("stratum", F.when(F.col("wall_dist") < 0.25, 1).otherwise(0))
    return train.unionByName(whole)


def build(jobs: DataFrame, read: Callable[[DataFrame], tuple[DataFrame, DataFrame]], out: str, n_keep: int, seed: int, indicator: F.Column, batch_cases: int = 10_000) -> DataFrame:
    """Write the shards of all pending jobs (case_id, split, digest) below `out`, and return the manifest.

    read(jobs) gives the points of some jobs (case_id, point_id, wall_dist, ...) and the errors (case_id, error) of those that cannot be
    read. Cases go in batches: a batch's points replace the partitions of its cases (points/case_id=...), and then its rows are
    added to the manifest, with the numbers of points that were read back. A run that is killed leaves the batches before, and
    its half-written batch is written again; a second run with nothing to do writes nothing. A case without points, or with an
    error, is a row with an error and is tried again by the next run.
    """
    spark = jobs.sparkSession
    todo = cut(pending(jobs, out).withColumn("number", F.monotonically_increasing_id()), "jobs")
    n = todo.count()
    first = (manifest(spark, out).agg(F.max("batch")).first()[0] or 0) + 1
    pieces = -(-n // batch_cases)
    for k in range(pieces):
        own = todo.where(F.pmod(F.xxhash64("case_id"), F.lit(pieces)) == k).select("case_id", "split", "digest")
        points, errors = read(own)
        bad = cut(errors.groupBy("case_id").agg(F.min("error").alias("error")), "errors")
        good = points.join(bad.select("case_id"), "case_id", "left_anti")
        counts = cut(good.groupBy("case_id").agg(F.count("*").alias("n_points")), "counts")
        kept = thinned(good, own, n_keep, seed, indicator)
        # A case is dealt over several files only if it is large: rows of a case stay together.
        kept.repartition("case_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(f"{out}/points")
        written = _written(spark, out, own)
        rows = own.join(counts, "case_id", "left").join(written, "case_id", "left").join(bad, "case_id", "left")
        error = F.coalesce("error", F.when(F.coalesce("n_points", F.lit(0)) == 0, "no points").when(F.coalesce("n_kept", F.lit(0)) == 0, "nothing was written"))
        rows.select("case_id", "split", "digest", F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points"), F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_kept"), error.alias("error"), F.lit(first + k).cast("long").alias("batch")).write.mode("append").parquet(f"{out}/manifest")
    return manifest(spark, out)


def _written(spark: SparkSession, out: str, own: DataFrame) -> DataFrame:
    """Rows that stand on the disk for the batch's cases: counted from the files' footers, as no column is read."""
    try:
        there = spark.read.parquet(f"{out}/points").select(F.col("case_id").cast("string").alias("case_id"))
    except Exception as e:  # noqa: BLE001
        if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "PATH_NOT_FOUND" not in str(e):
            raise
        return own.select("case_id", F.lit(0).cast("long").alias("n_kept")).limit(0)
    return there.join(own.select("case_id"), "case_id", "left_semi").groupBy("case_id").agg(F.count("*").alias("n_kept"))


def points(spark: SparkSession, out: str) -> DataFrame:
    """The shards' points; only cases that the manifest has without an error count."""
    good = manifest(spark, out).where("error is null").select("case_id")
    return spark.read.parquet(f"{out}/points").withColumn("case_id", F.col("case_id").cast("string")).join(good, "case_id", "left_semi")
