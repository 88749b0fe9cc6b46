"""Farthest-point sampling and two-scale token groups.

The choice is sequential within a case. A case of up to LARGE points is one Arrow task, which holds five numbers a point (40 MB for a
million points). A larger one is cut into chunks and chosen in rounds, with the same result: scores only fall while points
are chosen, so the best points of each chunk, and the score of the next one, tell the choice exactly until it falls to that score.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut, release
from .spatial import knn


#: Points of a case that one task takes, points of a chunk of a larger case, and of these the best that a round looks at.
LARGE, CHUNK, BEST = 2_000_000, 200_000, 512


def _square(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    d = x - at
    return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]


def greedy(x: np.ndarray, w: np.ndarray, n: int, start: int = 0) -> list[int]:
    """Places of at most n points: the one at start (modulo their number), then always that of the largest weight x squared
    distance to those chosen, the first on ties."""
    chosen, least = [start % len(x)], np.full(len(x), np.inf)
    for _ in range(min(n, len(x)) - 1):
        least = np.minimum(least, _square(x, x[chosen[-1]]))
        least[chosen] = -1
        chosen.append(int(np.argmax(least * w)))
    return chosen


def _sorted(points: DataFrame, weight: str) -> DataFrame:
    return points.select("case_id", "point_id", "x", "y", "z", F.expr(weight).cast("double").alias("w"))


def _case_type(points: DataFrame) -> str:
    return points.schema["case_id"].dataType.simpleString()


def farthest_points(points: DataFrame, n: int, weight: str = "1.0", start: int = 0) -> DataFrame:
    """case_id, step (from 0), point_id: greedy farthest points of each case in point order; at most the case's points."""

    def far(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("point_id")
        chosen = greedy(p[["x", "y", "z"]].to_numpy(), p["w"].to_numpy(), n, start)
        return pd.DataFrame({"case_id": p["case_id"].iloc[0], "step": range(len(chosen)), "point_id": p["point_id"].to_numpy()[chosen]})

    rows, schema = _sorted(points, weight), f"case_id {_case_type(points)}, step int, point_id long"
    large = large_cases(points)
    if not large:
        return rows.groupBy("case_id").applyInPandas(far, schema)
    small = rows.where(~F.col("case_id").isin(list(large))).groupBy("case_id").applyInPandas(far, schema)
    return small.unionByName(points.sparkSession.createDataFrame(_in_rounds(rows.where(F.col("case_id").isin(list(large))), large, n, start), schema))


def large_cases(points: DataFrame) -> dict:
    """Cases of more than LARGE points and their numbers of points."""
    return {r.case_id: r.n for r in points.groupBy("case_id").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).collect()}


def _in_rounds(rows: DataFrame, sizes: dict, n: int, start: int) -> list[tuple]:
    """(case_id, step, point_id) of large cases. A round updates each point's distance to what was chosen in the round before, writes it, and
    looks at the BEST points of each chunk; only these reach the driver, a number of rows that is that of the chunks, not of the points."""
    chunks = F.pmod(F.xxhash64("point_id"), F.element_at(F.create_map(*[F.lit(v) for c, m in sizes.items() for v in (c, -(-m // CHUNK))]), F.col("case_id")))
    now = cut(rows.withColumns({"chunk": chunks.cast("int"), "least": F.lit(float("inf"))}), "far")
    columns = ["case_id", "point_id", "x", "y", "z", "w", "chunk", "least"]
    chosen: dict = {}
    new: dict = {}
    for case, m in sizes.items():
        at = start % m
        first = rows.where(F.col("case_id") == case).orderBy("point_id").limit(at + 1).orderBy(F.desc("point_id")).first()
        chosen[case], new[case] = [first.point_id], [(first.point_id, first.x, first.y, first.z)]
    while new:
        now, before = cut(_nearer(now.select(columns), dict(new)), "far"), now
        release(before)
        order = Window.partitionBy("case_id", "chunk").orderBy(F.desc("score"), "point_id")
        top = now.where(F.col("case_id").isin(list(new))).withColumn("score", F.col("least") * F.col("w")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST + 1)
        got = top.select("case_id", "chunk", "rank", "point_id", "x", "y", "z", "w", "least").toPandas()
        new = {}
        for case, p in got.groupby("case_id"):
            picked = _choose(p, n - len(chosen[case]))
            chosen[case] += [i for i, *_ in picked]
            if picked and len(chosen[case]) < min(n, sizes[case]):
                new[case] = picked
    release(now)
    return [(case, k, int(i)) for case, ids in chosen.items() for k, i in enumerate(ids[: min(n, sizes[case])])]


def _nearer(rows: DataFrame, new: dict) -> DataFrame:
    """rows with the squared distance to the nearest chosen point; -1 for chosen ones."""

    def run(batches):
        for b in batches:
            p = b.to_pandas()
            for case, centres in new.items():
                own = np.flatnonzero((p["case_id"] == case).to_numpy())
                if not len(own):
                    continue
                x, ids, least = p[["x", "y", "z"]].to_numpy()[own], p["point_id"].to_numpy()[own], p["least"].to_numpy()[own]
                for i, *at in centres:
                    least = np.where(least < 0, least, np.minimum(least, _square(x, np.array(at))))
                    least[ids == i] = -1
                p.loc[p.index[own], "least"] = least
            yield pa.RecordBatch.from_pandas(p, schema=b.schema, preserve_index=False)

    return rows.mapInArrow(run, rows.schema)


def _choose(p: pd.DataFrame, most: int) -> list[tuple]:
    """The next greedy choices among a case's best points, as long as they come before every point that is not among them."""
    rest = p[p["rank"] > BEST]
    bound = max(zip((rest["least"] * rest["w"]).tolist(), (-rest["point_id"]).tolist()), default=(-np.inf, 0))
    p = p[p["rank"] <= BEST].sort_values("point_id")
    x, w, least, ids, out = p[["x", "y", "z"]].to_numpy(), p["w"].to_numpy(), p["least"].to_numpy().copy(), p["point_id"].to_numpy(), []
    while len(out) < most:
        score = least * w
        k = int(np.argmax(score))
        if least[k] < 0 or (score[k], -ids[k]) <= bound:
            break
        out.append((int(ids[k]), *x[k].tolist()))
        least = np.where(least < 0, least, np.minimum(least, _square(x, x[k])))
        least[k] = -1
    return out


def wall_weight(r1: float) -> str:
    return f"pow(1 / (1 + greatest(wall_dist, 0) / {r1}), 2)"


def token_groups(points: DataFrame, n1: int, n2: int, k: int, r1: float, r2: float) -> DataFrame:
    """case_id, scale, token, centre_id, rank, ref_id, dist, r_eff, radius: wall-weighted and uniform farthest centres with
    their k nearest points (the centre among them; ties by id), all from one pass over a case."""

    def group(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("point_id")
        x, ids, out = p[["x", "y", "z"]].to_numpy(), p["point_id"].to_numpy(), []
        uniform = np.ones(len(x))
        for scale, (w, n, start) in enumerate(((p["w"].to_numpy(), n1, 0), (uniform, n2, 1))):
            for token, c in enumerate(greedy(x, w, n, start)):
                d2 = _square(x, x[c])
                # All points up to the k-th distance, then by distance and id.
                near = np.flatnonzero(d2 <= np.partition(d2, k - 1)[k - 1]) if k < len(x) else np.arange(len(x))
                near = near[np.lexsort((ids[near], d2[near]))][:k]
                dist = np.sqrt(d2[near])
                out.append(pd.DataFrame({"scale": scale, "token": token, "centre_id": ids[c], "rank": np.arange(1, len(near) + 1), "ref_id": ids[near], "dist": dist, "r_eff": dist.max(), "radius": r1 if scale == 0 else r2}))
        return pd.concat(out).assign(case_id=p["case_id"].iloc[0])[["case_id", *out[0].columns]]

    schema = f"case_id {_case_type(points)}, scale int, token int, centre_id long, rank int, ref_id long, dist double, r_eff double, radius double"
    large = large_cases(points)
    if not large:
        return _sorted(points, wall_weight(r1)).groupBy("case_id").applyInPandas(group, schema)
    is_large = F.col("case_id").isin(list(large))
    small = _sorted(points.where(~is_large), wall_weight(r1)).groupBy("case_id").applyInPandas(group, schema)
    return small.unionByName(_large_groups(points.where(is_large), n1, n2, k, r1, r2))


def _large_groups(points: DataFrame, n1: int, n2: int, k: int, r1: float, r2: float) -> DataFrame:
    """The groups of large cases: centres in rounds, their neighbours by the grid join."""
    scales = [farthest_points(points, n, w, start).withColumn("scale", F.lit(scale)) for scale, (w, n, start) in enumerate(((wall_weight(r1), n1, 0), ("1.0", n2, 1)))]
    centres = cut(scales[0].unionByName(scales[1]).withColumn("number", F.monotonically_increasing_id()), "centres")
    at = points.select("case_id", "point_id", "x", "y", "z")
    asks = centres.join(at, ["case_id", "point_id"]).select("case_id", F.col("number").alias("point_id"), "x", "y", "z")
    near = knn(asks, at.withColumnRenamed("point_id", "ref_id"), k).withColumnRenamed("point_id", "number")
    reach = near.groupBy("case_id", "number").agg(F.sqrt(F.max("d2")).alias("r_eff"))
    out = near.join(centres, ["case_id", "number"]).join(reach, ["case_id", "number"])
    return out.select("case_id", "scale", F.col("step").alias("token"), F.col("point_id").alias("centre_id"), F.col("rank").cast("int").alias("rank"), "ref_id", F.sqrt("d2").alias("dist"), "r_eff", F.when(F.col("scale") == 0, r1).otherwise(r2).alias("radius"))


def token_coverage(points: DataFrame, groups: DataFrame, near: float = 0.25) -> DataFrame:
    """Per case the share of points in at least one group: all, near walls and elsewhere."""
    seen = groups.select("case_id", F.col("ref_id").alias("point_id")).distinct().withColumn("seen", F.lit(1.0))
    d = points.select("case_id", "point_id", "wall_dist").join(seen, ["case_id", "point_id"], "left").withColumn("seen", F.coalesce("seen", F.lit(0.0)))
    return d.groupBy("case_id").agg(F.avg("seen").alias("covered"), F.avg(F.when(F.col("wall_dist") < near, F.col("seen"))).alias("covered_near"), F.avg(F.when(F.col("wall_dist") >= near, F.col("seen"))).alias("covered_far"))


def tokeniser_stats(groups: DataFrame) -> DataFrame:
    """Per scale: the median over cases of the .1, .5 and .9 quantiles of the tokens' reach."""
    tokens = groups.select("case_id", "scale", "token", "r_eff").distinct()
    q = tokens.groupBy("case_id", "scale").agg(F.percentile("r_eff", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return q.groupBy("scale").agg(*[F.percentile(F.col("q")[i], 0.5).alias(n) for i, n in enumerate(("r_q10", "r_q50", "r_q90"))])


def assemble(groups: DataFrame, points: DataFrame, features: dict[str, Column]) -> DataFrame:
    """case_id, scale, token, rank, rx, ry, rz, and the features of every neighbour of every token: the neighbour's place
    relative to the token's centre over the token's radius, and column expressions over its point. groups: as token_groups gives them."""
    at = points.select("case_id", F.col("point_id").alias("ref_id"), *[F.col(c).alias(f"at_{c}") for c in "xyz"], *[x.alias(n) for n, x in features.items()])
    own = points.select("case_id", F.col("point_id").alias("centre_id"), *[F.col(c).alias(f"c_{c}") for c in "xyz"])
    centres = groups.select("case_id", "scale", "token", "centre_id", "radius").distinct().join(own, ["case_id", "centre_id"])
    rows = groups.select("case_id", "scale", "token", "rank", "ref_id").join(at, ["case_id", "ref_id"]).join(centres, ["case_id", "scale", "token"])
    return rows.select("case_id", "scale", "token", "rank", *[((F.col(f"at_{c}") - F.col(f"c_{c}")) / F.col("radius")).alias(f"r{c}") for c in "xyz"], *features)


def pooled(assembled: DataFrame, groups: DataFrame, columns: list[str], valid: Column | None = None) -> DataFrame:
    """case_id, scale, token, the largest value of each column over the token's valid neighbours (0 where none is valid), n_valid, and
    what describes the token's reach: log_radius and log_reach (of at least 1e-4)."""
    flag = valid if valid is not None else F.lit(True)
    best = assembled.groupBy("case_id", "scale", "token").agg(*[F.coalesce(F.max(F.when(flag, F.col(c))), F.lit(0.0)).alias(c) for c in columns], F.count_if(flag).alias("n_valid"))
    reach = groups.groupBy("case_id", "scale", "token").agg(F.log(F.first("radius")).alias("log_radius"), F.log(F.greatest(F.first("r_eff"), F.lit(1e-4))).alias("log_reach"))
    return best.join(reach, ["case_id", "scale", "token"])


def token_blocks(assembled: DataFrame, columns: list[str], n_tokens: int, k: int) -> DataFrame:
    """case_id, data, mask, one row a case: float32 values of shape (n_tokens, k, columns) and bytes of shape (n_tokens, k), tokens by scale
    and number, missing ones and missing neighbours 0. A case is n_tokens * k rows at most; more are an error."""

    def block(p: pd.DataFrame) -> pd.DataFrame:
        order = p[["scale", "token"]].drop_duplicates().sort_values(["scale", "token"]).reset_index(drop=True)
        if len(order) > n_tokens or p["rank"].max() > k:
            raise ValueError(f"{len(order)} tokens of up to {p['rank'].max()} neighbours for {n_tokens} of {k}")
        row = p.merge(order.assign(row=range(len(order))), on=["scale", "token"])
        data, mask = np.zeros((n_tokens, k, len(columns)), np.float32), np.zeros((n_tokens, k), np.uint8)
        data[row["row"], row["rank"] - 1] = row[columns].to_numpy(np.float32)
        mask[row["row"], row["rank"] - 1] = 1
        return pd.DataFrame({"case_id": [p["case_id"].iloc[0]], "data": [data.tobytes()], "mask": [mask.tobytes()]})

    return assembled.groupBy("case_id").applyInPandas(block, f"case_id {_case_type(assembled)}, data binary, mask binary")
