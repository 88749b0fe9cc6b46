"""Meshes and voxel grids: face and cell centres, footprints, normals, heights and vorticity."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def face_centres(faces: DataFrame, points: DataFrame) -> DataFrame:
    """case_id, face_id, x, y, z: the mean of the vertices. faces: case_id, face_id, vertices (array of point ids)."""
    v = faces.select("case_id", "face_id", F.explode("vertices").alias("point_id"))
    return v.join(points.select("case_id", "point_id", "x", "y", "z"), ["case_id", "point_id"]).groupBy("case_id", "face_id").agg(*[F.avg(c).alias(c) for c in "xyz"])


def cell_centres(centres: DataFrame, owner: DataFrame, neighbour: DataFrame) -> DataFrame:
    """case_id, cell_id, x, y, z, n_faces: the mean over a cell's faces, of which it is owner or neighbour."""
    sides = owner.select("case_id", "face_id", "cell_id").unionByName(neighbour.select("case_id", "face_id", "cell_id"))
    return sides.join(centres, ["case_id", "face_id"]).groupBy("case_id", "cell_id").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n_faces"))


def footprint(faces: DataFrame, keys: list[str], ground: DataFrame | None = None) -> DataFrame:
    """Area-weighted centroid of the faces that look up, on the ground, and their mean height above it; ground faces
    count only if there are no others, and plain areas weigh where nothing looks up. The ground is that of `ground`
    (keys, ground_z), else the mean of the ground faces, else the lowest of the counted faces. faces: cx, cy, cz, nz, area, is_ground."""
    case = Window.partitionBy(*keys)
    d = faces.withColumns({"body": F.bool_or(~F.col("is_ground")).over(case), "level": F.avg(F.when(F.col("is_ground"), F.col("cz"))).over(case)}).where(~F.col("body") | ~F.col("is_ground")).withColumn("w", F.greatest("nz", F.lit(0.0)) * F.col("area"))
    sums = d.groupBy(*keys).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"w_{c}") for c in ("cx", "cy", "cz")], F.sum("w").alias("w"), *[F.sum(F.col("area") * F.col(c)).alias(f"a_{c}") for c in ("cx", "cy", "cz")], F.sum("area").alias("a"), F.coalesce(F.first("level"), F.min("cz")).alias("level"))
    sums = sums.join(ground.select(*keys, "ground_z"), keys, "left") if ground is not None else sums.withColumn("ground_z", F.lit(None).cast("double"))
    z0 = F.coalesce("ground_z", "level")
    pick = lambda c: F.when(F.col("w") > 0, F.try_divide(F.col(f"w_{c}"), F.col("w"))).otherwise(F.try_divide(F.col(f"a_{c}"), F.col("a")))
    return sums.select(*keys, pick("cx").alias("x"), pick("cy").alias("y"), z0.alias("z"), (pick("cz") - z0).alias("height"))


def orient(faces: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Normals turned to the fluid (towards the owner cell), and per case the share that was turned.
    faces: cx, cy, cz, nx, ny, nz, ox, oy, oz."""
    dot = sum((F.col(f"n{c}") * (F.col(f"o{c}") - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0))
    d = faces.withColumn("flip", dot < 0)
    d = d.withColumns({f"n{c}": F.when(F.col("flip"), -F.col(f"n{c}")).otherwise(F.col(f"n{c}")) for c in "xyz"})
    return d, d.groupBy(*keys).agg(F.avg(F.col("flip").cast("double")).alias("flipped"))


def building_height(voxels: DataFrame, keys: list[str], dx: float, nz: int | None = None) -> DataFrame:
    """Mean height and centroid over the columns that are solid at the ground: the first fluid layer, or all layers of the
    grid (nz, or as many as its highest voxel tells). NaN where no column is solid there. voxels: ix, iy, iz, fluid."""
    columns = voxels.groupBy(*keys, "ix", "iy").agg(F.bool_or((F.col("iz") == 0) & ~F.col("fluid")).alias("solid"), F.min(F.when(F.col("fluid"), F.col("iz"))).alias("top"), F.max("iz").alias("last"))
    solid = lambda x: F.when(F.col("solid"), x)
    # The grid's layers are known after the sums: columns without fluid are counted and get the grid's height.
    sums = columns.groupBy(*keys).agg(
        (F.max("last") + 1 if nz is None else F.first(F.lit(nz))).alias("nz"), F.sum(solid(F.coalesce("top", F.lit(0)))).alias("tops"), F.count_if(F.col("solid") & F.col("top").isNull()).alias("whole"), F.count_if("solid").alias("n_columns"),
        F.avg(solid(F.col("ix") + 0.5)).alias("x"), F.avg(solid(F.col("iy") + 0.5)).alias("y"))
    nan = F.lit(float("nan"))
    height = F.try_divide(F.col("tops") + F.col("whole") * F.col("nz"), F.col("n_columns")) * dx
    return sums.select(*keys, F.coalesce(height, nan).alias("height"), "n_columns", *[F.coalesce(F.col(c) * dx, nan).alias(c) for c in ("x", "y")])


def _slope(value: str, along: str, across: list[str], dx: float) -> F.Column:
    """Central differences, one-sided at the ends, along one direction of a full grid."""
    w = Window.partitionBy(*across).orderBy(along)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    return F.when(a.isNull(), (b - F.col(value)) / dx).when(b.isNull(), (F.col(value) - a) / dx).otherwise((b - a) / (2 * dx))


def vorticity(grid: DataFrame, keys: list[str], dx: float) -> DataFrame:
    """Magnitude of the curl of (ux, uy, uz) on a grid ix, iy, iz; 0 along directions of one layer."""
    at = {"x": "ix", "y": "iy", "z": "iz"}
    d = grid
    for u, by in (("uz", "y"), ("uy", "z"), ("ux", "z"), ("uz", "x"), ("uy", "x"), ("ux", "y")):
        d = d.withColumn(f"d{u}_{by}", F.coalesce(_slope(u, at[by], [*keys, *[v for k, v in at.items() if k != by]], dx), F.lit(0.0)))
    a, b, c = F.col("duz_y") - F.col("duy_z"), F.col("dux_z") - F.col("duz_x"), F.col("duy_x") - F.col("dux_y")
    return d.select(*keys, "ix", "iy", "iz", F.sqrt(a * a + b * b + c * c).alias("vorticity"))
