"""Training samples as a chain of relations: context, prior coin, tokens, mask and queries of each case's draw."""
from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import VECTORS
from .sampling import context, first_by_key, key, point_mask, unit
from .tokens import token_groups


@dataclass(frozen=True)
class SampleSpec:
    n_context: int = 64
    n_tokens: tuple[int, int] = (8, 4)
    k: int = 8
    radii: tuple[float, float] = (0.5, 2.0)
    n_query: int = 32
    ratios: tuple[float, ...] = (0.6, 0.9, 1.0)
    probabilities: tuple[float, ...] = (0.5, 0.25, 0.25)
    prior_probability: float = 0.5
    modes: tuple[str, ...] = ("random",)
    mode_probabilities: tuple[float, ...] = (1.0,)


def augment(points: DataFrame, cases: DataFrame, seed: int, epoch: int, draw: int, mirror: bool = True) -> DataFrame:
    """Every case turned about z by an angle of its own, where rotation_ok, and every other one mirrored in y: one map for all
    of a case's positions, normals, velocities and prior velocities. cases: case_id, rotation_ok."""
    number = lambda what: unit(seed, epoch, draw, what, F.col("case_id"))
    turn = F.when(F.coalesce("rotation_ok", F.lit(False)), number("turn") * 2 * math.pi).otherwise(0.0)
    side = F.when(number("mirror") < 0.5, -1.0).otherwise(1.0) if mirror else F.lit(1.0)
    d = points.join(cases.select("case_id", turn.alias("turn_"), side.alias("side_")), "case_id")
    new = {}
    for x, y, _ in VECTORS:
        if x in points.columns:
            new[x] = F.col(x) * F.cos("turn_") - F.col(y) * F.sin("turn_")
            new[y] = F.col("side_") * (F.col(x) * F.sin("turn_") + F.col(y) * F.cos("turn_"))
    return d.withColumns(new).drop("turn_", "side_")


def draws(cases: DataFrame, spec: SampleSpec, seed: int, epoch: int, draw: int) -> DataFrame:
    """case_id, ratio, mode, use_prior: the categorical draws of each case, by key."""
    u = unit(seed, epoch, draw, "ratio", F.col("case_id"))
    ratio, below = F.lit(spec.ratios[-1]), sum(spec.probabilities[:-1])
    for r, p in zip(reversed(spec.ratios[:-1]), reversed(spec.probabilities[:-1])):
        ratio = F.when(u >= below, ratio).otherwise(F.lit(r))
        below -= p
    v, mode, below = unit(seed, epoch, draw, "mode", F.col("case_id")), F.lit(spec.modes[-1]), sum(spec.mode_probabilities[:-1])
    for m, p in zip(reversed(spec.modes[:-1]), reversed(spec.mode_probabilities[:-1])):
        mode = F.when(v >= below, mode).otherwise(F.lit(m))
        below -= p
    return cases.select("case_id", ratio.alias("ratio"), mode.alias("mode"), (unit(seed, epoch, draw, "prior", F.col("case_id")) < spec.prior_probability).alias("use_prior"))


def sample(points: DataFrame, spec: SampleSpec, seed: int = 0, epoch: int = 0, draw: int = 0, wake: DataFrame | None = None) -> dict[str, DataFrame]:
    """context (case_id, point_id, masked, use_prior), tokens, and queries (case_id, slot, point_id): the keyed choice of
    hidden context points and of the wake points (case_id, point_id; never part of the context) if there are any, with
    repetition only where there are fewer than n_query. The case's mode says what is hidden: random points, those near
    walls, those downstream (all jittered)."""
    number = seed * 1_000_003 + epoch * 1_009 + draw
    if wake is not None:
        points = points.join(wake.select("case_id", "point_id"), ["case_id", "point_id"], "left_anti")
    ctx = context(points, ["case_id"], spec.n_context, number)
    d = draws(points.select("case_id").distinct(), spec, seed, epoch, draw)
    jitter = unit(number, "mask", F.col("point_id"))
    score = F.when(F.col("mode") == "near_wall", -F.col("wall_dist") + 0.1 * jitter).when(F.col("mode") == "wake", F.col("x") + 0.1 * jitter).otherwise(jitter)
    # One mask for each ratio, each on the cases that drew it.
    drawn = ctx.join(d, "case_id")
    parts = [point_mask(drawn.where(F.col("ratio") == r), ["case_id"], score, r) for r in spec.ratios]
    masked = reduce(DataFrame.unionByName, parts)
    hidden = masked.where("masked").select("case_id", "point_id")
    hidden = hidden if wake is None else hidden.unionByName(wake.select("case_id", "point_id"))
    size = hidden.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_hidden"))
    rounds = hidden.join(size, "case_id").withColumn("round", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(spec.n_query) / F.col("n_hidden")).cast("int") - 1)))
    queries = first_by_key(rounds, ["case_id"], [F.col("round"), key(number, "query", F.col("round"), F.col("point_id")), F.col("point_id")], spec.n_query, "slot")
    return {
        "context": masked.select("case_id", "point_id", "masked", "use_prior", "ratio"),
        "tokens": token_groups(ctx, *spec.n_tokens, spec.k, *spec.radii),
        "queries": queries.select("case_id", "slot", "point_id"),
    }


def interpolate(points: DataFrame, known: DataFrame, fields: list[str], k: int = 3) -> DataFrame:
    """case_id, point_id and the fields as inverse-distance means over the k nearest known points: the baseline
    that a trained decoder has to beat."""
    from .spatial import knn

    near = knn(points, known.withColumnRenamed("point_id", "ref_id"), k).withColumn("w", 1 / (F.sqrt("d2") + 1e-9))
    values = known.select("case_id", F.col("point_id").alias("ref_id"), *fields)
    return near.join(values, ["case_id", "ref_id"]).groupBy("case_id", "point_id").agg(*[(F.sum(F.col("w") * F.col(f)) / F.sum("w")).alias(f) for f in fields])


def ensemble(members: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Mean and population spread of the members' predictions."""
    return members.groupBy(*keys).agg(*[F.avg(f).alias(f"{f}_mean") for f in fields], *[F.stddev_pop(f).alias(f"{f}_std") for f in fields])
