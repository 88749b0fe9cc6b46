"""What the operators of this subpackage share: shared storage, table access, hashing of labelled splits."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import cut, new_folder, release

__all__ = ["WORD", "cut", "fold", "new_path", "partitions", "release", "table", "text_of"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, what: str) -> str:
    return new_folder(spark, what)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, null taken as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; remainder 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(3)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
