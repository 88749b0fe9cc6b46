"""Run folders of volume sources, and folders of grids to be predicted, as canonical points: the data sources and operators put together.

A run is a folder below the root with a grid (volume_<i>.vtu) and a body (<name>.stl; the first by name counts). Of the grid only the
arrays that the source's names ask for are decoded.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import graph, runs
from ..operators.checks import CaseError
from . import stl, vtu


def cells(spark: SparkSession, root: str, names: list[str], pattern: str, rows: int = vtu.ROWS) -> DataFrame:
    """case_id, cell_id, x, y, z, volume and the named cell arrays. An array that the first grid lacks is an error; where a later one lacks it,
    its values are null."""
    vtu.register(spark)
    source = lambda: spark.read.format("vtu").option("pattern", pattern).option("rows", rows)
    known = {f.name: f for f in source().load(root).schema}
    if lacking := [n for n in names if n not in known]:
        raise CaseError(f"cell arrays {lacking} are needed")
    return source().schema(StructType([known[n] for n in ("case_id", "cell_id", "x", "y", "z", "volume", *names)])).load(root)


def bodies(spark: SparkSession, root: str, glob: str = "*.stl") -> DataFrame:
    """case_id, face_id and corners of each folder's first surface, turned so that all of it looks outward."""
    faces = stl.read(spark, root, glob).withColumn("case_id", F.element_at(F.split("file", "/"), -2))
    first = faces.groupBy("case_id").agg(F.min("file").alias("file"))
    return graph.oriented(faces.join(first, ["case_id", "file"], "left_semi").select("case_id", "face_id", *stl.CORNERS))


def read_runs(spark: SparkSession, root: str, params: DataFrame, manifest: DataFrame, names: dict[str, str], n_keep: int = 1_500_000, seed: int = 0, pattern: str = "*/volume_*.vtu") -> tuple[DataFrame, DataFrame]:
    """The canonical points of all runs of a source, and its cases (operators.runs.run_points). params: case_id (the folder), u_ref, nu;
    names: the arrays of U and p, and of k, R and ksgs where the source has them."""
    solid = manifest.first().solid_field
    wanted = [*dict.fromkeys([*names.values(), *([solid] if solid and solid != "none" else [])])]
    return runs.run_points(cells(spark, root, wanted, pattern), bodies(spark, root), params, manifest, n_keep, seed, names)


def read_volumes(spark: SparkSession, root: str, params: DataFrame, ground: float | None = None, mesh: str = "mesh.vtu", walls: str = "walls.stl") -> tuple[DataFrame, DataFrame]:
    """The points of grids without fields, and their cases (operators.runs.volume_points). params: case_id, u_ref, l_ref."""
    return runs.volume_points(cells(spark, root, [], f"*/{mesh}"), bodies(spark, root, walls), params, ground)
