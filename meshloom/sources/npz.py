"""Point shards in NumPy archives as a Spark data source, and shards as Parquet."""
from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHANNELS

#: Arrays that a shard may leave out, and the columns each becomes.
OPTIONAL = {"fields": list(CHANNELS), "prior": [f"p_{c}" for c in CHANNELS], "cell_size": ["cell_size"], "stratum": ["stratum"]}
SCHEMA = "case_id string, point_id long, x float, y float, z float, wall_dist float, nx float, ny float, nz float, " + ", ".join(f"{c} float" for c in [*CHANNELS, *OPTIONAL["prior"], "cell_size"]) + ", stratum int, header string"


def read_shards(spark: SparkSession, path: str, glob: str = "*.npz") -> DataFrame:
    """One row per point of every shard below path; arrays that a shard lacks are null. Files are opened by
    Spark, so any store that Spark reads will do, and a shard is one task's work."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as z:
                    header = json.loads(str(z["header"])) if "header" in z.files else {}
                    p = z["points"].astype(np.float32)
                    out = {"case_id": header.get("case_id", ""), "point_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "wall_dist": z["wall_dist"].astype(np.float32)}
                    out |= {f"n{c}": z["normal"][:, i].astype(np.float32) for i, c in enumerate("xyz")}
                    for name, columns in OPTIONAL.items():
                        if name in z.files:
                            a = z[name].reshape(len(p), -1)
                            out |= {c: a[:, i].astype(np.int32 if name == "stratum" else np.float32) for i, c in enumerate(columns)}
                        else:
                            out |= {c: None for c in columns}
                    yield pd.DataFrame(out | {"header": json.dumps(header)})[[f.split()[0] for f in SCHEMA.split(", ")]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(parse, SCHEMA)


def write_parquet(points: DataFrame, path: str, by: tuple[str, ...] = ("source", "split")) -> None:
    """Shards as Parquet, by source and split; Spark's commit makes the write atomic."""
    points.write.partitionBy(*[c for c in by if c in points.columns]).mode("overwrite").parquet(path)


def read_manifest(spark: SparkSession, path: str, split: str | None = None, tiers: list[str] | None = None, source: str | None = None) -> DataFrame:
    """A manifest's shards in order; filters reach the Parquet scan."""
    m = spark.read.parquet(path)
    if split is not None:
        m = m.where(F.col("split") == split)
    if tiers:
        m = m.where(F.col("tier").isin(tiers))
    if source is not None:
        m = m.where(F.col("source") == source)
    return m.orderBy("shard")


VOXELS = "case_id string, ix int, iy int, iz int, fluid boolean, " + ", ".join(f"{n}{i} float" for n in ("t", "i") for i in range(6)) + ", turbulence float, info string"


def read_voxels(spark: SparkSession, path: str, glob: str = "*.npz") -> DataFrame:
    """One row per voxel of every voxel archive below path: its place, whether it is fluid, the six cached target and input
    channels (see batches.voxel_channels), the input turbulence and the archive's info (JSON). Layers go out one by one."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in VOXELS.split(", ")]
        for b in batches:
            for content in b["content"]:
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as z:
                    fluid, target, given, info = z["mask"][0].astype(bool), z["tgt"], z["inp"], str(z["info"])
                case = str(json.loads(info).get("case", ""))
                y, x = (g.ravel() for g in np.meshgrid(np.arange(fluid.shape[1]), np.arange(fluid.shape[0])))
                for k in range(fluid.shape[2]):
                    out = {"case_id": case, "ix": x.astype(np.int32), "iy": y.astype(np.int32), "iz": np.full(len(x), k, np.int32), "fluid": fluid[x, y, k]}
                    out |= {f"{n}{i}": a[i][x, y, k].astype(np.float32) for n, a in (("t", target), ("i", given)) for i in range(6)}
                    yield pd.DataFrame(out | {"turbulence": given[10][x, y, k].astype(np.float32) if len(given) > 10 else np.float32("nan"), "info": info})[names]

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(parse, VOXELS)
