"""Manifest jobs: enrichment that fails closed, and voxel grids as points."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut


class BackfillError(ValueError):
    """Rows that cannot be enriched."""


def backfill_reynolds(manifest: DataFrame, params: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Adds log10_re = log10(U L / nu) and error. manifest: case_id, u_ref, l_ref; params: case_id, u, nu. A case without
    parameters, or with another velocity, has an error instead of a value."""
    j = manifest.join(params, "case_id", "left")
    error = F.when(F.col("nu").isNull(), "no parameters").when(F.abs(F.col("u") - F.col("u_ref")) > tolerance, "velocity differs").when(F.col("nu") <= 0, "bad viscosity")
    return j.withColumn("error", error).withColumn("log10_re", F.when(F.col("error").isNull(), F.log10(F.try_divide(F.col("u_ref") * F.col("l_ref"), F.col("nu"))))).drop("u", "nu")


def require_complete(filled: DataFrame) -> DataFrame:
    """The enriched manifest, or BackfillError with the errors' counts; nothing is written on an error."""
    bad = filled.where(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.min("case_id").alias("first")).collect()  # one row per kind
    if bad:
        raise BackfillError("; ".join(f"{r.error}: {r.n}, first {r.first}" for r in sorted(bad)))
    return filled.drop("error")


def voxels_to_points(voxels: DataFrame, keys: list[str], dx: float, l_ref: float, normals: bool = False) -> DataFrame:
    """Fluid voxels as points at cell centres over l_ref, with the distance to the nearest solid voxel less half a
    cell, not below 0. voxels: ix, iy, iz, fluid. The ground layer (iz = -1) counts as solid. With `normals` also nx, ny, nz,
    the unit vector from that solid voxel (of equally near ones the first by number; the ground last) to the point."""
    from .spatial import nearest_lists

    case = F.struct(*keys).alias("case_id") if len(keys) > 1 else F.col(keys[0]).alias("case_id")
    number, fluid = F.xxhash64(*[F.col(f"i{c}") for c in "xyz"]), F.col("fluid")
    rows = voxels.where("fluid is not null").select(
        case, fluid.cast("int").alias("asks"), F.when(~fluid, number).alias("ref_id"), F.when(fluid, F.struct("ix", "iy", "iz")).alias("point_id"), *[((F.col(f"i{c}") + 0.5) * dx).alias(c) for c in "xyz"])
    rows = cut(rows, "voxels")
    out = nearest_lists(rows, 1).select("case_id", "point_id.*", "x", "y", "z", F.get("near", F.lit(0)).alias("near")).select("*", "near.ref_id", F.sqrt("near.d2").alias("d"))
    if normals:
        solid = rows.where("asks = 0").select("case_id", "ref_id", *[F.col(c).alias(f"s{c}") for c in "xyz"])
        out = out.join(solid, ["case_id", "ref_id"], "left")
    down = F.col("z") + 0.5 * dx
    wall = F.greatest(F.least(F.coalesce("d", F.lit(float("inf"))), down) - 0.5 * dx, F.lit(0.0))
    building = F.coalesce(F.col("d") <= down, F.lit(False))
    unit = [F.when(building, (F.col(c) - F.col(f"s{c}")) / F.col("d")).otherwise(F.lit(1.0 if c == "z" else 0.0)).alias(f"n{c}") for c in "xyz"] if normals else []
    return out.select("case_id", "ix", "iy", "iz", *[(F.col(c) / l_ref).alias(c) for c in "xyz"], (wall / l_ref).alias("wall_dist"), *unit)
