"""STL surfaces, binary or ASCII: one row per triangle; centroids, areas and unit normals as column expressions."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORNERS = [f"{axis}{k}" for k in range(3) for axis in "xyz"]
_RECORD = np.dtype([("normal", "<f4", 3), ("corners", "<f4", 9), ("attribute", "<u2")])
_VERTEX = re.compile(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)")


class SurfaceError(ValueError):
    """A file that is not an STL surface."""


def triangles(data: bytes) -> np.ndarray:
    """The corners of a file's triangles, nine numbers each. A file is binary if its length is the one that
    its count of triangles gives, whatever its first word is."""
    if len(data) >= 84 and len(data) == 84 + _RECORD.itemsize * int.from_bytes(data[80:84], "little"):
        return np.frombuffer(data, _RECORD, offset=84)["corners"].astype(float)
    if not data.lstrip().startswith(b"solid"):
        raise SurfaceError("neither the length of a binary STL nor the first word of an ASCII one")
    numbers = _VERTEX.findall(data)
    if len(numbers) % 3:
        raise SurfaceError(f"{len(numbers)} vertices are no whole number of triangles")
    return np.array(numbers, dtype="S").astype(float).reshape(-1, 9)


def read(spark: SparkSession, path: str, glob: str = "*.stl") -> DataFrame:
    """file, face_id and the corners x0, y0, z0 .. z2 of every triangle below path; one task reads a whole file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                out = pd.DataFrame(triangles(bytes(content)), columns=CORNERS).rename_axis("face_id").reset_index()
                out.insert(0, "file", name)
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, face_id long, " + ", ".join(f"{c} double" for c in CORNERS))


def surface_samples(faces: DataFrame) -> DataFrame:
    """cx, cy, cz, area and nx, ny, nz in place of the corners. Normals follow the order of the corners; a
    triangle without area has null normals."""
    edge = {f"{axis}{k}": F.col(f"{axis}{k}") - F.col(f"{axis}0") for axis in "xyz" for k in (1, 2)}
    cross = [edge[f"{a}1"] * edge[f"{b}2"] - edge[f"{b}1"] * edge[f"{a}2"] for a, b in ("yz", "zx", "xy")]
    size = F.sqrt(sum((c * c for c in cross), F.lit(0.0)))
    centre = [((F.col(f"{axis}0") + F.col(f"{axis}1") + F.col(f"{axis}2")) / 3).alias(f"c{axis}") for axis in "xyz"]
    normal = [F.when(size > 0, c / size).alias(f"n{axis}") for axis, c in zip("xyz", cross)]
    return faces.select(*[c for c in faces.columns if c not in CORNERS], *centre, (size / 2).alias("area"), *normal)
