"""Solver runs as canonical points: volume cells, body surface, and the conventions that a source's manifest states."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from . import checks, mesh, spatial
from .sampling import stratified


def surface(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The triangles' centroids, normals and areas (case_id, ref_id, x, y, z, fnx, fny, fnz, area) and each case's bounds. faces: case_id,
    face_id and corners; their order decides the normals (see graph.oriented)."""
    from ..sources.stl import surface_samples

    s = surface_samples(faces)
    rows = s.select("case_id", F.col("face_id").alias("ref_id"), *[F.col(f"c{c}").alias(c) for c in "xyz"], *[F.coalesce(f"n{c}", F.lit(0.0)).alias(f"fn{c}") for c in "xyz"], "area")
    ends = [f(*[F.col(f"{c}{k}") for k in range(3)]) for c in "xyz" for f in (F.least, F.greatest)]
    bounds = faces.groupBy("case_id").agg(*[(F.min if i % 2 == 0 else F.max)(e).alias(f"{'lo' if i % 2 == 0 else 'hi'}{'xyz'[i // 2]}") for i, e in enumerate(ends)])
    return rows, bounds


def run_points(cells: DataFrame, faces: DataFrame, runs: DataFrame, manifest: DataFrame, n_keep: int, seed: int, names: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Canonical points of the runs of one source, and its cases.

    cells: case_id, cell_id, x, y, z and the source's cell arrays (sources.vtu); faces: the body's triangles; runs: case_id, u_ref, nu
    (null: no Reynolds number); manifest: the source's row as checks.manifest_problems takes it, which has to hold; names: the
    columns of U, p, and of k or R (Reynolds stresses) and ksgs where the source has them.

    Cells that the manifest's mask calls solid go. Points are relative to the reference frame, distances go to the nearest
    triangle's centre or the ground, at most n_keep points of a run stay, by strata of wall distance and of the deficit against
    the inflow.
    """
    checks.require(checks.manifest_problems(manifest).where(F.size("problems") > 0).select("source", F.concat_ws("; ", "problems").alias("problems")), ["source", "problems"])
    m = manifest.first()  # one row
    missing = [c for c in (names["U"], names["p"], *([m.solid_field] if m.solid_field != "none" else [])) if c not in cells.columns]
    if missing:
        raise checks.CaseError(f"{m.source}: cell arrays {missing} are needed")
    fluid = cells if m.solid_field == "none" else cells.where(~F.col(m.solid_field).eqNullSafe(F.lit(m.solid_value).cast("double")))
    k, has_k = _energy(cells.columns, names, m.stress_order)
    ground = None if m.ground == "none" else float(m.ground)
    refs, bounds = surface(faces)
    frame = checks.reference_frames(bounds.withColumn("source", F.lit(m.source)), manifest).drop("source").join(runs, "case_id")
    at = fluid.select("case_id", F.col("cell_id").alias("point_id"), "x", "y", "z", *[F.col(names["U"])[i].alias(f"u_{c}") for i, c in enumerate("xyz")], F.col(names["p"]).alias("p_"), k.alias("k_"))
    near = distance(at.select("case_id", "point_id", "x", "y", "z"), refs, ground)
    d = at.join(near, ["case_id", "point_id"]).join(frame, "case_id")
    inflow = F.array(*[F.lit(float(x)) for x in m.inflow_dir])
    size = F.sqrt(F.aggregate(inflow, F.lit(0.0), lambda s, x: s + x * x))
    deficit = F.sqrt(sum(((F.col(f"u_{c}") - F.col("u_ref") * inflow[i] / size) * (F.col(f"u_{c}") - F.col("u_ref") * inflow[i] / size) for i, c in enumerate("xyz")), F.lit(0.0)))
    d = d.withColumn("wall_dist", F.col("wall_dist") / F.col("l_ref"))
    chosen = stratified(d.withColumn("deficit", deficit), ["case_id"], n_keep, seed, F.col("deficit"))
    static = m.pressure == "static"
    p = F.col("p_") - F.lit(float(m.p_ref)) if static else F.col("p_")
    canonical = fields.to_canonical([F.col(f"u_{c}") for c in "xyz"], p, F.col("k_"), F.col("u_ref"), m.pressure, float(m.rho) if static else 1.0)
    points = chosen.select("case_id", "point_id", *[((F.col(c) - F.col(f"o{c}")) / F.col("l_ref")).alias(c) for c in "xyz"], "wall_dist", "nx", "ny", "nz", *[x.alias(n) for x, n in zip([*canonical, F.lit(0.0)], ("ux", "uy", "uz", "cp", "k", "eps"))], "stratum")
    counts = fluid.groupBy("case_id").agg(F.count("*").alias("n_cells"))
    re = F.when(F.col("nu") > 0, F.log10(F.col("u_ref") * F.col("l_ref") / F.col("nu")))
    cases = frame.join(counts, "case_id").select("case_id", F.lit(m.source).alias("source"), "l_ref", "u_ref", "ox", "oy", "oz", re.alias("log10_re"), F.array(*map(F.lit, (True, True, has_k, False))).alias("presence"), F.lit(ground is not None).alias("has_ground"), "n_cells")
    return points, cases


def _energy(columns: list[str], names: dict[str, str], order: str) -> tuple[Column, bool]:
    """The turbulent energy: a source's own, else half the trace of its stresses and what the subgrid model adds, else 0 and absent."""
    if names.get("k") in columns:
        return F.col(names["k"]), True
    if names.get("R") in columns and order != "none":
        own = fields.k_from_stress([F.col(names["R"])[i] for i in range(6)], order)
        return (own + F.col(names["ksgs"]), True) if names.get("ksgs") in columns else (own, True)
    return F.lit(0.0), False


def distance(points: DataFrame, refs: DataFrame, ground: float | None) -> DataFrame:
    """case_id, point_id, wall_dist and nx, ny, nz: the way from the nearest reference, or up from the ground where that is nearer."""
    near = spatial.knn(points, refs, 1).select("case_id", "point_id", "ref_id", F.sqrt("d2").alias("d"))
    j = points.join(near, ["case_id", "point_id"]).join(refs.select("case_id", "ref_id", *[F.col(c).alias(f"f{c}") for c in "xyz"]), ["case_id", "ref_id"])
    low = F.lit(False) if ground is None else (F.col("z") - ground) < F.col("d")
    up = F.col("d") if ground is None else F.when(low, F.col("z") - ground).otherwise(F.col("d"))
    unit = [F.when(low, F.lit(1.0 if c == "z" else 0.0)).otherwise((F.col(c) - F.col(f"f{c}")) / (F.col("d") + 1e-12)).alias(f"n{c}") for c in "xyz"]
    return j.select("case_id", "point_id", up.alias("wall_dist"), *unit)


def volume_points(cells: DataFrame, faces: DataFrame, params: DataFrame, ground: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Points of grids that have no fields yet, to be predicted, and their cases: cells (case_id, cell_id, x, y, z, volume), the walls'
    triangles, and case_id, u_ref, l_ref (null or not positive: the mean height of the walls above the ground or their lowest centre)."""
    refs, _ = surface(faces)
    feet = refs.select("case_id", *[F.col(c).alias(f"c{c}") for c in "xyz"], F.col("fnz").alias("nz"), "area", F.lit(False).alias("is_ground"))
    level = params.select("case_id", F.lit(ground).cast("double").alias("ground_z"))
    foot = mesh.footprint(feet, ["case_id"], level).select("case_id", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), "height")
    frame = params.join(foot, "case_id").withColumn("l_ref", F.when(F.col("l_ref") > 0, F.col("l_ref")).otherwise(F.col("height"))).drop("height")
    at = cells.select("case_id", F.col("cell_id").alias("point_id"), "x", "y", "z", "volume")
    near = spatial.wall_geometry(at.select("case_id", "point_id", "x", "y", "z"), refs)
    if ground is not None:
        near = spatial.with_ground(near, ground)
    d = at.join(near.select("case_id", "point_id", "wall", "wnx", "wny", "wnz"), ["case_id", "point_id"]).join(frame, "case_id")
    l_ref = F.col("l_ref")
    points = d.select("case_id", "point_id", *[((F.col(c) - F.col(f"o{c}")) / l_ref).alias(c) for c in "xyz"], (F.col("wall") / l_ref).alias("wall_dist"), *[F.col(f"wn{c}").alias(f"n{c}") for c in "xyz"], (F.cbrt(F.greatest("volume", F.lit(1e-30))) / l_ref).alias("cell_size"))
    return points, frame.select("case_id", "ox", "oy", "oz", "l_ref", "u_ref", F.lit(ground is not None).alias("has_ground"))
