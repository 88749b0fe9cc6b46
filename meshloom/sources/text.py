"""Solver logs and monitor files as line tables, numbered within their file; and checksummed backups."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, line_no (from 1), line of every text file below path. A file is read whole, so numbers are exact."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).select("path", (F.col("n") + 1).cast("long").alias("line_no"), "line")


def read_monitors(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines of <case>/postProcessing/<monitor>/<start time>/<name>, with case_id, monitor and numeric start."""
    d = read_lines(spark, path, name)
    part = lambda i: F.regexp_extract("path", r"([^/]+)/postProcessing/([^/]+)/([^/]+)/[^/]+$", i)
    return d.withColumns({"case_id": part(1), "monitor": part(2), "raw": part(3)}).withColumn("start", F.expr("try_cast(raw as double)")).where(F.col("start").isNotNull()).drop("raw", "path")


_MONITOR = r"([^/]+)/postProcessing/([^/]+)/([^/]+)/([^/]+)$"


def monitor_files(paths: DataFrame, name: str) -> DataFrame:
    """case_id, monitor, nth, start, next_start, path of the files <case>/postProcessing/<monitor>/<start time>/<name> among `path`s, in the
    order in which a run and its restarts began; folders whose name is no number are none of them. The first file is nth = 1."""
    part = lambda i: F.regexp_extract("path", _MONITOR, i)
    d = paths.select("path").distinct().where(part(4) == name).select(part(1).alias("case_id"), part(2).alias("monitor"), part(3).try_cast("double").alias("start"), "path").where(F.col("start").isNotNull())
    order = Window.partitionBy("case_id", "monitor").orderBy("start", "path")
    return d.select("case_id", "monitor", F.row_number().over(order).alias("nth"), "start", F.lead("start").over(order).alias("next_start"), "path")


def resolved(files: DataFrame, records: DataFrame) -> DataFrame:
    """case_id, monitor, it, value, start: one record an iteration of a run with restarts. Where files overlap the one that starts later
    has the word, then the later line. records: path, line, it, value; iterations are told apart to nine places."""
    rows = records.join(files.select("path", "case_id", "monitor", "start"), "path")
    last = F.max_by(F.struct("value", "start"), F.struct("start", "path", "line"))
    return rows.groupBy("case_id", "monitor", F.round("it", 9).alias("it")).agg(last.alias("x")).select("case_id", "monitor", "it", "x.value", "x.start")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, length of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


def backup_faults(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files of a manifest that are missing or differ: empty for a sound backup."""
    now = files.select("path", F.col("sha256").alias("now"))
    return manifest.join(now, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("path", F.when(F.col("now").isNull(), "missing").otherwise("differs").alias("fault"))


#: Geometry that a solver's tools write beside the fields, which it computes again.
DERIVED = ("C", "Ccx", "Ccy", "Ccz", "Vc", "phi", "Phi")


def case_files(spark: SparkSession, path: str) -> DataFrame:
    """split_paths of the files in solver cases below path. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return split_paths(files, path)


def split_paths(files: DataFrame, root: str) -> DataFrame:
    """case_id, part (processor folder or null), folder, file, path, length of files (path, length) in solver cases below root;
    time is the folder's number, or null."""
    at = F.regexp_replace("path", r"^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
    d = files.select("path", "length", F.split(at, "/").alias("p"))
    parallel = F.get("p", F.lit(1)).startswith("processor")
    d = d.select("path", "length", F.get("p", F.lit(0)).alias("case_id"), F.when(parallel, F.get("p", F.lit(1))).alias("part"), F.when(parallel, F.slice("p", 3, 100)).otherwise(F.slice("p", 2, 100)).alias("p"))
    d = d.where(F.size("p") > 1).select("case_id", "part", F.get("p", F.lit(0)).alias("folder"), F.array_join(F.slice("p", 2, 100), "/").alias("file"), "path", "length")
    return d.withColumn("time", F.expr("try_cast(folder as double)"))


def time_folders(files: DataFrame, start: float = 0.0) -> DataFrame:
    """case_id, part, folder of the times other than the start."""
    return files.where(F.col("time").isNotNull() & (F.col("time") != start)).select("case_id", "part", "folder").distinct()


def latest_time(files: DataFrame) -> DataFrame:
    """case_id, folder, time of each case's largest time, of the undivided case."""
    return files.where(F.col("time").isNotNull() & F.col("part").isNull()).groupBy("case_id").agg(F.max_by("folder", "time").alias("folder"), F.max("time").alias("time"))


def case_entries(files: DataFrame, time: str = "0") -> DataFrame:
    """The files of a case that a solver needs to start from `time`: constant, system, and the fields of that folder."""
    field = (F.col("folder") == time) & ~F.col("file").contains("/") & ~F.col("file").isin(*DERIVED)
    return files.where(F.col("part").isNull() & (F.col("folder").isin("constant", "system") | field)).select("case_id", F.concat_ws("/", "folder", "file").alias("entry"), "path", "length")
