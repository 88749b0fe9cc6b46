"""Column functions of fields, frames and units. All are plain Spark expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite. Spark takes NaN as larger than any number, so it is asked for first."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def encode(x: Column) -> Column:
    """Turbulence quantities on a logarithmic scale: log1p(max(x, 0) / 0.001)."""
    return F.log1p(F.greatest(x, F.lit(0.0)) / 1e-3)


def decode(x: Column) -> Column:
    return F.expm1(F.greatest(x, F.lit(0.0))) * 1e-3


def masked(present: Column, x: Column) -> Column:
    """x where its group is present, else exactly 0: chosen, not multiplied, so that NaN cannot leak."""
    return F.when(present, x).otherwise(F.lit(0.0))


def norm(*xs: Column) -> Column:
    total = F.lit(0.0)
    for x in xs:
        total = total + x * x
    return F.sqrt(total)


def linear(df: DataFrame, m: list[list[float]], vectors: list[tuple[str, str, str]]) -> DataFrame:
    """The 3 x 3 map m applied to each vector of columns; other columns stay."""
    new = {}
    for v in vectors:
        for row, name in zip(m, v):
            new[name] = sum((F.col(c) * F.lit(float(a)) for a, c in zip(row, v)), F.lit(0.0))
    return df.withColumns(new)


def rotation_z(theta: float) -> list[list[float]]:
    c, s = math.cos(theta), math.sin(theta)
    return [[c, -s, 0.0], [s, c, 0.0], [0.0, 0.0, 1.0]]


MIRROR_Y = [[1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, 1.0]]
VECTORS = [("x", "y", "z"), ("nx", "ny", "nz"), ("ux", "uy", "uz"), ("p_ux", "p_uy", "p_uz")]


def rotate_z(df: DataFrame, theta: float) -> DataFrame:
    return linear(df, rotation_z(theta), VECTORS)


def mirror_y(df: DataFrame) -> DataFrame:
    return linear(df, MIRROR_Y, VECTORS)


def mixing_length_eps(k: Column, wall_dist: Column, l_ref: Column, c_mu: float = 0.09, kappa: float = 0.41, share: float = 0.1) -> Column:
    length = F.least(kappa * F.greatest(wall_dist, F.lit(1e-6)), share * l_ref)
    return c_mu**0.75 * F.pow(F.greatest(k, F.lit(0.0)), F.lit(1.5)) / length


def physical_fields(u_ref: Column, l_ref: Column, p_ref: Column) -> dict[str, Column]:
    """SI values of the normalised fields; without a reference pressure it counts as 0 and gauge_known is false."""
    return {
        **{f"si_{c}": F.col(c) * u_ref for c in ("ux", "uy", "uz")},
        "si_p": 0.5 * F.col("cp") * u_ref * u_ref + F.coalesce(p_ref, F.lit(0.0)),
        "si_k": F.col("k") * u_ref * u_ref,
        "si_eps": F.col("eps") * u_ref * u_ref * u_ref / l_ref,
        "gauge_known": p_ref.isNotNull(),
    }


def to_solver(u_ref: Column, l_ref: Column, closure: Column) -> dict[str, Column]:
    """What a solver is started with: floors on k and eps, eps from the field for k-epsilon closures and from a
    mixing length for others, omega from both."""
    k = F.greatest(F.col("k") * u_ref * u_ref, 1e-6 * u_ref * u_ref)
    own = F.col("eps") * u_ref * u_ref * u_ref / l_ref
    eps = F.greatest(F.when(closure == "k-epsilon", own).otherwise(mixing_length_eps(k, F.col("wall_dist") * l_ref, l_ref)), 1e-8 * u_ref * u_ref * u_ref / l_ref)
    return {**{f"si_{c}": F.col(c) * u_ref for c in ("ux", "uy", "uz")}, "si_k": k, "si_eps": eps, "si_omega": eps / (0.09 * k)}


def k_from_stress(r: list[Column], order: str) -> Column:
    """Half the trace; the diagonal stands at 0, 1, 2 in vtk order and at 0, 3, 5 in foam order."""
    a, b, c = {"vtk": (0, 1, 2), "foam": (0, 3, 5)}[order]
    return 0.5 * (r[a] + r[b] + r[c])


def to_canonical(u: list[Column], p: Column, k: Column, u_ref: Column, pressure: str, rho: float = 1.225) -> list[Column]:
    cp = 2 * p / (u_ref * u_ref) if pressure == "kinematic" else 2 * p / (rho * u_ref * u_ref)
    return [*(x / u_ref for x in u), cp, k / (u_ref * u_ref)]


def from_canonical(f: list[Column], u_ref: Column, pressure: str, rho: float = 1.225) -> list[Column]:
    p = 0.5 * f[3] * u_ref * u_ref * (1.0 if pressure == "kinematic" else rho)
    return [*(x * u_ref for x in f[:3]), p, f[4] * u_ref * u_ref]


#: Centre and scale of the standardised conditioning scalars.
CONDITIONS = (("log10_re", 6.0, 2.0), ("abl_alpha", 0.2, 0.1), ("log10_z0", -3.0, 1.5), ("turb_intensity", 0.1, 0.05))


def conditioning_vector(has_ground: Column, inflow: list[Column]) -> Column:
    """Twelve values: four standardised scalars (0 where not finite), four flags, the inflow's direction, ground."""
    n = norm(*inflow)
    scalars = [F.when(finite(F.col(c)), (F.col(c) - m) / s).otherwise(0.0) for c, m, s in CONDITIONS]
    flags = [F.when(finite(F.col(c)), 1.0).otherwise(0.0) for c, _, _ in CONDITIONS]
    return F.array(*scalars, *flags, *[x / n for x in inflow], F.when(has_ground, 1.0).otherwise(0.0))


def geometry_features(height: Column, streamwise: Column) -> Column:
    """Nine features of a point: distance on two scales, normal, clipped height and station, cell size and its flag."""
    known = F.when(F.col("cell_size").isNotNull(), 1.0).otherwise(0.0)
    clip = lambda x, a, b: F.greatest(F.least(x, F.lit(b)), F.lit(a))
    return F.array(
        F.log(F.greatest(F.col("wall_dist"), F.lit(0.0)) + 0.01), F.least(F.col("wall_dist"), F.lit(5.0)), F.col("nx"), F.col("ny"), F.col("nz"),
        clip(height, -5.0, 20.0) / 5, clip(streamwise / 5, -10.0, 10.0), F.log(F.greatest(F.coalesce("cell_size", F.lit(1.0)), F.lit(1e-4))) * known / 5, known)


def warmup_cosine(step: Column, base: float, warmup: int, total: int, least: float = 0.0) -> Column:
    """Linear warm-up, then a cosine from base to least * base."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / max(1, total - warmup)))
    return F.when(step < warmup, base * (step + 1) / max(1, warmup)).otherwise(base * (least + (1 - least) * 0.5 * (1 + F.cos(math.pi * share))))


def physical_points(l_ref: Column, origin: list[Column]) -> dict[str, Column]:
    """Coordinates in the source's own frame; null without an origin."""
    return {f"si_{c}": F.col(c) * l_ref + o for c, o in zip("xyz", origin)}


def standardise(df: DataFrame, stats: DataFrame, channels: tuple[str, ...], back: bool = False) -> DataFrame:
    """Channels of df less their mean over their standard deviation, or (back) the way back. stats: channel, mean, std, a row a
    channel, which reach every row as one."""
    one = stats.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("mean", "std")))).alias("stats_"))
    at = lambda c: F.col("stats_")[c]
    new = {c: F.col(c) * at(c)["std"] + at(c)["mean"] if back else (F.col(c) - at(c)["mean"]) / at(c)["std"] for c in channels}
    return df.join(F.broadcast(one)).withColumns(new).drop("stats_")


def should_evaluate(step: Column, every: int, last: Column, stopped: Column) -> Column:
    """At a boundary or the last step, but never after a stop."""
    return ~stopped & ((step % every == 0) | last)
