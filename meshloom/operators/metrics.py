"""Grouped error metrics and channel statistics: one pass, combined before the shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import encode, finite
from ..schema import CHANNELS, GROUPS, WEIGHTS


def rel_l2(pairs: list[tuple[Column, Column]], weight: Column | None = None) -> Column:
    """Relative L2 error of (prediction, truth) channels taken as one vector."""
    w = F.lit(1.0) if weight is None else weight
    err = sum((w * (p - t) * (p - t) for p, t in pairs), F.lit(0.0))
    size = sum((w * t * t for _, t in pairs), F.lit(0.0))
    return F.sqrt(F.sum(err)) / (F.sqrt(F.sum(size)) + 1e-12)


def rel_l2_by_group(df: DataFrame, keys: list[str], predicted: str = "p_", presence: dict[str, Column] | None = None) -> DataFrame:
    """One column per channel group; a group that is absent is null."""
    out = []
    for g, channels in GROUPS.items():
        x = rel_l2([(F.col(predicted + c), F.col(c)) for c in channels])
        out.append((F.when(F.bool_and(presence[g]), x) if presence and g in presence else x).alias(f"rel_l2_{g.lower()}"))
    return df.groupBy(*keys).agg(*out)


def near_wall_ratio(df: DataFrame, keys: list[str], predicted: str = "p_", near: float = 0.25, far: float = 1.0) -> DataFrame:
    """Root mean square velocity error near walls and far from them, and their ratio; NaN where a band is empty."""
    e2 = sum(((F.col(predicted + c) - F.col(c)) * (F.col(predicted + c) - F.col(c)) for c in GROUPS["U"]), F.lit(0.0))
    nan = F.lit(float("nan"))
    out = df.groupBy(*keys).agg(F.sqrt(F.avg(F.when(F.col("wall_dist") < near, e2))).alias("near"), F.sqrt(F.avg(F.when(F.col("wall_dist") > far, e2))).alias("far"))
    return out.select(*keys, F.coalesce("near", nan).alias("near"), F.coalesce("far", nan).alias("far"), F.when(F.col("far") > 0, F.col("near") / F.col("far")).otherwise(nan).alias("ratio"))


def baselines() -> dict[str, dict[str, Column]]:
    """The prior as it is, a uniform inflow, and the mean of both."""
    uniform = {c: F.lit(1.0 if c == "ux" else 0.0) for c in CHANNELS}
    return {"prior-alone": {c: F.col(f"p_{c}") for c in CHANNELS}, "uniform-inflow": uniform, "blend": {c: 0.5 * (F.col(f"p_{c}") + uniform[c]) for c in CHANNELS}}


def by_method(df: DataFrame, keys: list[str], methods: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    """Long table (keys, method) of the errors of each method, given as the columns that it predicts by channel (by default the
    baselines), in one scan."""
    given = baselines() if methods is None else methods
    rows = F.array(*[F.struct(F.lit(name).alias("method"), *[made[c].cast("double").alias(f"m_{c}") for c in CHANNELS]) for name, made in given.items()])
    long = df.withColumn("m", F.explode(rows)).select(*keys, "wall_dist", *CHANNELS, "m.*")
    return rel_l2_by_group(long, [*keys, "method"], "m_")


def nan_median(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Medians that leave NaN and null out; NaN where nothing is left."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.percentile(F.when(~F.isnan(c), F.col(c)), 0.5), F.lit(float("nan"))).alias(c) for c in columns])


def channel_stats(df: DataFrame, rotation_invariant: bool = True, common: bool = False) -> DataFrame:
    """channel, mean, std (population, + 1e-6) in encoded space, present values only; 0 and 1 for a channel without any.
    rotation_invariant: mean 0 and the horizontal root mean square for ux and uy, and with `common` for uz too. `common`
    alone: mean 0 and the root mean square of all three. Statistics that are not finite and positive raise an error."""
    coded = [F.col(c) if c not in ("k", "eps") else F.when(F.col(c).isNotNull(), encode(F.col(c))) for c in CHANNELS]
    row = df.agg(*[F.avg(x).alias(f"m_{c}") for c, x in zip(CHANNELS, coded)], *[F.stddev_pop(x).alias(f"s_{c}") for c, x in zip(CHANNELS, coded)],
                 *[F.sum(x * x).alias(f"q_{c}") for c, x in zip(CHANNELS, coded)], *[F.count(x).alias(f"n_{c}") for c, x in zip(CHANNELS, coded)])
    mean = {c: F.coalesce(F.col(f"m_{c}"), F.lit(0.0)) for c in CHANNELS}
    std = {c: F.coalesce(F.col(f"s_{c}") + 1e-6, F.lit(1.0)) for c in CHANNELS}
    if rotation_invariant or common:
        measured = ("ux", "uy") if rotation_invariant else ("ux", "uy", "uz")
        there = F.least(*[F.col(f"n_{c}") for c in measured]) > 0
        if rotation_invariant:  # each component counts alike; without the turn all values do
            scale = F.sqrt(sum((F.try_divide(F.col(f"q_{c}"), F.col(f"n_{c}")) for c in measured), F.lit(0.0)) / len(measured))
        else:
            scale = F.sqrt(F.try_divide(sum((F.col(f"q_{c}") for c in measured), F.lit(0.0)), sum((F.col(f"n_{c}") for c in measured), F.lit(0))))
        for c in ("ux", "uy", "uz") if common else ("ux", "uy"):
            mean[c], std[c] = F.when(there, 0.0).otherwise(mean[c]), F.when(there, scale).otherwise(std[c])
    good = lambda c: finite(mean[c]) & finite(std[c]) & (std[c] > 0)
    checked = {c: F.when(good(c), std[c]).otherwise(F.raise_error(F.lit(f"statistics of {c} are not finite and positive")).cast("double")) for c in CHANNELS}
    stats = [F.struct(F.lit(c).alias("channel"), mean[c].alias("mean"), checked[c].alias("std")) for c in CHANNELS]
    return row.select(F.explode(F.array(*stats)).alias("s")).select("s.*")


def clipped(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of turbulence values below 0 (which encoding clips) and the number of values that are not finite."""
    share = lambda c: (F.count_if(F.col(c) < 0) / F.count(F.lit(1))).alias(f"clipped_{c}")
    return df.groupBy(*keys).agg(share("k"), share("eps"), sum((F.count_if(~finite(F.col(c))) for c in CHANNELS), F.lit(0)).alias("not_finite"))


def masked_loss(df: DataFrame, keys: list[str], predicted: str = "p_", presence: dict[str, Column] | None = None) -> DataFrame:
    """Weighted mean squared error over present channels: sum(w e^2) / max(sum w, 1)."""
    err, size = F.lit(0.0), F.lit(0.0)
    for g, channels in GROUPS.items():
        for c in channels:
            w = F.when((presence or {}).get(g, F.lit(True)), F.lit(WEIGHTS[c])).otherwise(0.0)
            d = F.col(predicted + c) - F.col(c)
            err, size = err + F.when(w > 0, w * d * d).otherwise(0.0), size + w
    return df.groupBy(*keys).agg((F.sum(err) / F.greatest(F.sum(size), F.lit(1.0))).alias("loss"))


def coverage(draws: DataFrame) -> DataFrame:
    """Cases, distinct drawn cases, draws and share drawn: overall, by source and by tier, by grouping sets."""
    out = draws.groupingSets([[], ["source"], ["tier"]], "source", "tier").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_draws") > 0).alias("drawn"), F.sum("n_draws").alias("draws"))
    return out.select(F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "source").otherwise("tier").alias("by"), F.coalesce("source", "tier", F.lit("all")).alias("name"), "n", "drawn", "draws", (F.col("drawn") / F.col("n")).alias("share"))


def case_targets(df: DataFrame, keys: list[str]) -> DataFrame:
    nan = F.lit(float("nan"))
    speed = F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz"))
    street = (F.col("z") > 0.05) & (F.col("z") < 0.3) & (F.col("wall_dist") >= 0.9 * F.col("z"))
    return df.groupBy(*keys).agg(F.coalesce(F.avg(F.when(street, speed)), nan).alias("street_speed"), F.coalesce(F.avg(F.when(F.col("wall_dist") < 0.1, F.col("cp"))), nan).alias("wall_cp"), F.coalesce(F.avg("k"), nan).alias("mean_k"))


def case_features(df: DataFrame, keys: list[str]) -> DataFrame:
    near = F.col("wall_dist") < 0.1
    body = F.when(near & (F.col("z") > 0.05), F.col("z"))
    return df.groupBy(*keys).agg(
        F.avg(near.cast("double")).alias("near_share"), F.coalesce(F.avg(body), F.lit(0.0)).alias("mean_z"), F.coalesce(F.stddev_pop(body), F.lit(0.0)).alias("std_z"), F.coalesce(F.percentile(body, 0.9), F.lit(0.0)).alias("q90_z"),
        (F.max("x") - F.min("x")).alias("extent_x"), (F.max("y") - F.min("y")).alias("extent_y"), F.log(F.count(F.lit(1)).cast("double")).alias("log_n"))
