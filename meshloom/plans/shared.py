"""The folder that driver and executors share, for what a job writes and reads again."""
from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the session's checkpoint folder. Where neither is set, a temporary folder on a local master
    (in tests); on a cluster, whose machines do not share one, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="meshloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder, deleted when the driver ends."""
    path = f"{base_folder(spark)}/meshloom-{what}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path, schema = new_folder(df.sparkSession, what), df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    _paths[id(out)] = out, path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for t in tables:
        out, path = _paths.pop(id(t), (None, None))
        if out is not None:
            _delete(t.sparkSession, path)
            _made[:] = [m for m in _made if m[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Folders written so far, and the tables that read them (held, so that their numbers stay theirs).
_made: list[tuple[SparkSession, str]] = []
_paths: dict[int, tuple[DataFrame, str]] = {}


def forget() -> None:
    """Delete what was written so far; tables that read it are gone then. Runs by itself when the driver ends."""
    _paths.clear()
    while _made:
        try:
            _delete(*_made.pop())
        except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clear
            return


atexit.register(forget)
