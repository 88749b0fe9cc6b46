"""Rules that cases, samples and source manifests have to keep, as tables of what breaks them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import finite
from ..schema import GROUPS


class CaseError(ValueError):
    """All rules that cases break, together."""


def _broken(x: Column) -> Column:
    """Not finite where there is a value; a column that a case lacks is null."""
    return x.isNotNull() & ~finite(x)


def case_problems(points: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, rule, n: reference scales that are not finite and positive, geometry that is not finite, and values that
    are not finite (a null too) in present channels of the fields or the prior; absent channels may hold anything, as
    they are replaced, not multiplied. points: case_id, x, y, z, wall_dist, nx, ny, nz, cell_size, channels and p_ channels;
    cases: case_id, l_ref, u_ref, presence and prior_presence (arrays over the groups U, Cp, k, eps; null: none)."""
    geometry = {"points": ("x", "y", "z"), "wall_dist": ("wall_dist",), "normal": ("nx", "ny", "nz"), "cell_size": ("cell_size",)}
    # Null coordinates are no coordinates; a null cell size is a mesh without sizes.
    bad = {n: F.lit(False) for n in (*geometry, "fields", "prior")}
    for name, columns in geometry.items():
        for c in columns:
            bad[name] = bad[name] | (_broken(F.col(c)) if name == "cell_size" else ~finite(F.col(c)))
    for name, prefix, there in (("fields", "", "presence"), ("prior", "p_", "prior_presence")):
        for i, channels in enumerate(GROUPS.values()):
            for c in channels:
                bad[name] = bad[name] | (F.coalesce(F.col(there)[i], F.lit(False)) & ~finite(F.col(prefix + c)))
    # Partial counts meet the cases' flags: points are joined with one small row a case.
    counted = points.join(cases.select("case_id", "presence", "prior_presence"), "case_id").groupBy("case_id").agg(*[F.count_if(x).alias(n) for n, x in bad.items()])
    scales = F.when(finite(F.col("l_ref")) & finite(F.col("u_ref")) & (F.col("l_ref") > 0) & (F.col("u_ref") > 0), 0).otherwise(1)
    rows = cases.select("case_id", scales.cast("long").alias("scales")).join(counted, "case_id", "left")
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).alias("n")) for n in ("scales", *bad)])
    return rows.select("case_id", F.explode(rules).alias("r")).select("case_id", "r.*").where("n > 0")


def query_problems(context: DataFrame, queries: DataFrame, use_prior: Column) -> DataFrame:
    """case_id, problem of cases whose query points do not fit their context: another frame (l_ref, u_ref), or, where the
    context shows a prior, none or one on other groups. Both: case_id, l_ref, u_ref, has_prior, prior_presence (null: none)."""
    q = queries.select("case_id", *[F.col(c).alias(f"q_{c}") for c in ("l_ref", "u_ref", "has_prior", "prior_presence")])
    j = context.join(q, "case_id")
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-8 + 1e-5 * F.abs(F.col(b))
    none = F.array(*[F.lit(False)] * len(GROUPS))
    same = F.coalesce("q_prior_presence", none) == F.coalesce("prior_presence", none)
    shown = use_prior & F.col("has_prior")
    problem = F.when(~(close("l_ref", "q_l_ref") & close("u_ref", "q_u_ref")), "another frame").when(shown & ~F.col("q_has_prior"), "no prior").when(shown & ~same, "other prior groups")
    return j.select("case_id", problem.alias("problem")).where(F.col("problem").isNotNull())


#: The sign of an open question in a manifest, closed vocabularies, and sources that need an explicit length.
OPEN, STRESS, PRESSURE = "VERIFY", ("vtk", "foam", "none"), ("kinematic", "static")


def manifest_problems(manifests: DataFrame, length_needed: tuple[str, ...] = ()) -> DataFrame:
    """source, problems (array; empty if the manifest holds): columns that are missing (null, blank or marked VERIFY), and,
    where none is, values outside their rules. manifests: source, solid_field and solid_value (field 'none' for none),
    stress_order, pressure, rho, p_ref, inflow_dir, l_ref_value or l_ref_rule, origin_rule or origin_point, ground (a
    height as text, or none)."""
    has = lambda c: F.col(c).isNotNull()
    text = lambda c: F.coalesce(F.trim(c) == "", F.lit(True)) | F.contains(F.col(c), F.lit(OPEN))
    missing = [
        F.when(text("source"), "source: missing"), F.when(text("solid_field"), "solid_mask: missing"), F.when(text("stress_order"), "stress_order: missing"), F.when(text("pressure"), "pressure: missing"),
        F.when(F.coalesce(F.size("inflow_dir"), F.lit(0)) <= 0, "inflow_dir: missing"), F.when(~has("l_ref_value") & text("l_ref_rule"), "l_ref: missing"), F.when(~has("origin_point") & text("origin_rule"), "origin: missing"), F.when(text("ground"), "ground_z: missing"),
    ]
    d = F.col("inflow_dir")
    vector = (F.size(d) == 3) & F.forall(d, finite) & (F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x) >= 1e-18)
    wrong = [
        F.when((F.col("solid_field") != "none") & ~has("solid_value"), "solid_mask: no solid value"), F.when(~F.col("stress_order").isin(*STRESS), "stress_order: unknown"),
        F.when(~F.col("pressure").isin(*PRESSURE), "pressure: unknown"), F.when((F.col("pressure") == "static") & ~(has("rho") & has("p_ref")), "pressure: static needs rho and p_ref"),
        F.when(~F.coalesce(vector, F.lit(False)), "inflow_dir: a non-zero 3-vector"),
        F.when(~F.coalesce((F.col("l_ref_value") > 0) | (F.col("l_ref_rule") == "x-extent"), F.lit(False)), "l_ref: a length or x-extent").when(F.col("source").isin(list(length_needed)) & ~has("l_ref_value"), "l_ref: this source needs a length"),
        F.when(~F.coalesce((F.size("origin_point") == 3) | (F.col("origin_rule") == "bbox-centre-ground"), F.lit(False)), "origin: a point or bbox-centre-ground"),
        F.when((F.col("ground") != "none") & F.expr("try_cast(ground as double)").isNull(), "ground_z: a height or none"),
    ]
    told = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return manifests.select("source", F.when(F.size(told(missing)) > 0, told(missing)).otherwise(told(wrong)).alias("problems"))


def reference_frames(bounds: DataFrame, manifests: DataFrame) -> DataFrame:
    """source, case_id, l_ref, ox, oy, oz: the length that a manifest gives or the extent along x, and the point that it gives
    or the centre of the bounds on the ground (their lowest z without one). bounds: source, case_id, lo and hi of x, y, z."""
    j = bounds.join(manifests, "source")
    ground = F.coalesce(F.expr("try_cast(ground as double)"), F.col("loz"))
    given = lambda i, own: F.when(F.size("origin_point") == 3, F.col("origin_point")[i]).otherwise(own)
    centre = lambda c: (F.col(f"lo{c}") + F.col(f"hi{c}")) / 2
    return j.select("source", "case_id", F.coalesce("l_ref_value", F.col("hix") - F.col("lox")).alias("l_ref"), given(0, centre("x")).alias("ox"), given(1, centre("y")).alias("oy"), given(2, ground).alias("oz"))


def require(problems: DataFrame, columns: list[str], most: int = 20) -> None:
    """CaseError with the first of the problems, if there are any; runs now."""
    rows = problems.select(*columns).limit(most).collect()
    if rows:
        raise CaseError("; ".join(", ".join(map(str, r)) for r in rows))
