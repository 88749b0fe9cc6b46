"""Cases put together: mesh, patches and fields as canonical points."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import mesh, spatial


def face_areas(faces: DataFrame, points: DataFrame) -> DataFrame:
    """case_id, face_id, x, y, z (the mean of the vertices) and the area vector ax, ay, az by the right-hand rule: half the sum
    of the cross products of vertices that follow each other."""
    v = faces.select("case_id", "face_id", F.posexplode("vertices").alias("i", "point_id")).join(points.select("case_id", "point_id", "x", "y", "z"), ["case_id", "point_id"])
    face = Window.partitionBy("case_id", "face_id")
    order = face.orderBy("i")
    first = face.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = v.withColumns({f"n{c}": F.coalesce(F.lead(c).over(order), F.first(c).over(first)) for c in "xyz"})
    cross = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    return v.groupBy("case_id", "face_id").agg(*[F.avg(c).alias(c) for c in "xyz"], *[(F.sum(F.col(a) * F.col(f"n{b}") - F.col(b) * F.col(f"n{a}")) / 2).alias(f"a{c}") for c, (a, b) in cross.items()])


def cells(areas: DataFrame, owner: DataFrame, neighbour: DataFrame) -> DataFrame:
    """case_id, cell_id, x, y, z (the mean over its faces) and volume, from the faces' area vectors, which point out of the owner."""
    sides = owner.select("case_id", "face_id", "cell_id", F.lit(1.0).alias("s")).unionByName(neighbour.select("case_id", "face_id", "cell_id", F.lit(-1.0).alias("s")))
    flux = sum((F.col(c) * F.col(f"a{c}") for c in "xyz"), F.lit(0.0)) * F.col("s") / 3
    return sides.join(areas, ["case_id", "face_id"]).groupBy("case_id", "cell_id").agg(*[F.avg(c).alias(c) for c in "xyz"], F.abs(F.sum(flux)).alias("volume"))


def wall_faces(areas: DataFrame, boundary: DataFrame, wall_types: tuple[str, ...] = ("wall",), ground: tuple[str, ...] = ("ground",)) -> DataFrame:
    """case_id, ref_id, x, y, z, fnx, fny, fnz (into the fluid), area and is_ground of the faces of wall patches, of which a case
    has few."""
    b = boundary.where(F.col("type").isin(*wall_types)).select(F.col("case_id").alias("c"), "name", "start_face", "n_faces")
    inside = (F.col("case_id") == F.col("c")) & (F.col("face_id") >= F.col("start_face")) & (F.col("face_id") < F.col("start_face") + F.col("n_faces"))
    size = F.sqrt(sum((F.col(f"a{c}") * F.col(f"a{c}") for c in "xyz"), F.lit(0.0)))
    unit = [F.coalesce(F.try_divide(-F.col(f"a{c}"), size), F.lit(0.0)).alias(f"fn{c}") for c in "xyz"]
    return areas.join(b, inside).select("case_id", F.col("face_id").alias("ref_id"), "x", "y", "z", *unit, size.alias("area"), F.col("name").isin(*ground).alias("is_ground"))


def case_points(tables: dict[str, DataFrame], params: DataFrame, fields: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The canonical points of every case, and its frame (case_id, ox, oy, oz, l_ref, u_ref, has_ground).

    tables: points, faces, owner, neighbour, boundary (sources.polymesh); params: case_id, u_ref, l_ref (null or not
    positive: the mean height of the walls above the ground) and p_ref; fields: case_id, field, time, cell_id (null: every
    cell), value, of which a case's latest time counts; without them, and for fields that a case lacks, channels are null.
    """
    areas = face_areas(tables["faces"], tables["points"])
    body = cells(areas, tables["owner"], tables["neighbour"])
    walls = wall_faces(areas, tables["boundary"])
    feet = mesh.footprint(walls.select("case_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), F.col("fnz").alias("nz"), "area", "is_ground"), ["case_id"])
    frame = params.join(feet.select("case_id", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), "height"), "case_id").join(walls.groupBy("case_id").agg(F.bool_or("is_ground").alias("has_ground")), "case_id")
    frame = frame.withColumn("l_ref", F.when(F.col("l_ref") > 0, F.col("l_ref")).otherwise(F.col("height"))).drop("height")
    at = body.withColumnRenamed("cell_id", "point_id")
    near = spatial.wall_geometry(at.select("case_id", "point_id", "x", "y", "z"), walls)
    d = at.join(near.drop("z", "ref_id"), ["case_id", "point_id"], "left").join(frame, "case_id")
    if fields is not None:
        last = fields.groupBy("case_id").agg(F.max("time").alias("time"))
        now = fields.join(last, ["case_id", "time"])
        pick = lambda n: F.max(F.when(F.col("field") == n, F.col("value")))
        names = ("U", "p", "k", "epsilon")
        own = now.where(F.col("cell_id").isNotNull()).groupBy("case_id", F.col("cell_id").alias("point_id")).agg(*[pick(n).alias(f"f_{n}") for n in names])
        same = now.where(F.col("cell_id").isNull()).groupBy("case_id").agg(*[pick(n).alias(f"g_{n}") for n in names])
        d = d.join(own, ["case_id", "point_id"], "left").join(same, "case_id", "left")
        value = {n: F.coalesce(f"f_{n}", f"g_{n}") for n in names}
    else:
        value = {n: F.lit(None).cast("array<double>") for n in ("U", "p", "k", "epsilon")}
    u, l_ref = F.col("u_ref"), F.col("l_ref")
    out = d.select(
        "case_id", "point_id", *[((F.col(c) - F.col(f"o{c}")) / l_ref).alias(c) for c in "xyz"], (F.col("wall") / l_ref).alias("wall_dist"), *[F.col(f"wn{c}").alias(f"n{c}") for c in "xyz"],
        *[(F.get(value["U"], F.lit(i)) / u).alias(f"u{c}") for i, c in enumerate("xyz")], (2 * (F.get(value["p"], F.lit(0)) - F.coalesce("p_ref", F.lit(0.0))) / (u * u)).alias("cp"),
        (F.get(value["k"], F.lit(0)) / (u * u)).alias("k"), (F.get(value["epsilon"], F.lit(0)) * l_ref / (u * u * u)).alias("eps"), (F.cbrt("volume") / l_ref).alias("cell_size"))
    return out, frame.select("case_id", "ox", "oy", "oz", "l_ref", "u_ref", "has_ground")
