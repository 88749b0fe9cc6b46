"""Embedding retrieval and linear probes."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import finite
from ..plans.shared import cut

#: Vectors of a packed block, and bytes of queries that are sent to all parts of the index.
BLOCK, SENT_BYTES = 4096, 32 << 20
#: Scores that a task holds at once.
SCORES = 1 << 20


def standardise(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id, label, v: z-scores by dimension (population, + 1e-6), then unit length (+ 1e-12). The moments are one
    aggregation of whole vectors, which runs at once."""
    given = vectors.where(F.size("embedding") == dims)
    s = given.select(Summarizer.metrics("mean", "std", "count").summary(array_to_vector(F.col("embedding").cast("array<double>"))).alias("s"))
    s = s.select("s.count", vector_to_array("s.mean").alias("mean"), vector_to_array("s.std").alias("std")).first()
    # One row of 2 x dims numbers, which are constants of what follows; the sample's deviation becomes the population's.
    scale = math.sqrt((s["count"] - 1) / s["count"]) if s["count"] else 1.0
    m, d = F.lit([float(x) for x in s["mean"]]), F.lit([float(x) * scale + 1e-6 for x in s["std"]])
    z = given.withColumn("z", F.zip_with(F.zip_with(F.col("embedding").cast("array<double>"), m, lambda x, y: x - y), d, lambda x, y: x / y))
    z = z.withColumn("n", F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)) + 1e-12)
    return z.select("vec_id", "label", F.expr("transform(z, x -> x / n)").alias("v"))


def _packed(vectors: DataFrame, name: str) -> DataFrame:
    """Rows of up to BLOCK vectors of a partition: their ids and values."""
    schema = f"{name}_ids binary, {name}_values binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                ids, v = np.asarray(part.column(0)), part.column(1).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([v.astype("<f8").tobytes()], pa.binary())], [f"{name}_ids", f"{name}_values"])

    return vectors.select(F.col("vec_id").cast("long"), "v").mapInArrow(run, schema)


def best(qi: np.ndarray, q: np.ndarray, xi: np.ndarray, x: np.ndarray, k: int, held: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of queries and of their k most similar vectors, and the scores, for so many queries at a time that `held` scores are
    enough (one query's at least)."""
    step = max(1, held // max(1, len(xi)))
    for a in range(0, len(qi), step):
        ids = qi[a : a + step]
        scores = (q[a : a + step] @ x.T).round(12)  # equal vectors have equal scores, wherever they stand in a product
        # All that reach the k-th best are in it, so that ties are decided by id.
        least = np.partition(scores, -k, axis=1)[:, -k] if k < len(xi) else np.full(len(ids), -np.inf)
        i, j = np.nonzero(scores >= least[:, None])
        order = np.lexsort((xi[j], -scores[i, j], i))
        i, j = i[order], j[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[nth < k], j[nth < k]
        yield ids[i], xi[j], scores[i, j]


def top_k(index: DataFrame, queries: DataFrame, k: int, dims: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k most similar vectors (of `dims` numbers) of each stated query, ties by vec_id.

    Queries and index go as packed blocks; a block of queries meets a block of vectors in one matrix product, which
    leaves k rows a query. The queries' blocks are sent to all parts of the index while they are SENT_BYTES or less,
    which is counted; beyond that both sides are cut into pieces that meet pairwise, a query block's with every part's.
    """
    q, x = _packed(queries, "q"), _packed(index, "x")
    few = queries.count() * 8 * dims <= SENT_BYTES
    pairs = x.join(F.broadcast(q)) if few else cut(x, "index").hint("shuffle_replicate_nl").join(cut(q, "queries"))

    held = SCORES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                xi, xv, qi, qv = (np.frombuffer(b.column(c)[row].as_buffer(), t) for c, t in (("x_ids", "<i8"), ("x_values", "<f8"), ("q_ids", "<i8"), ("q_values", "<f8")))
                for part in best(qi, qv.reshape(len(qi), -1), xi, xv.reshape(len(xi), -1), k, held):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], ["query_id", "vec_id", "score"])

    scored = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gram(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """i, j, value of X'X (i <= j) and, at j = -1, of X'y: one aggregation, whatever the number of rows."""
    cells = [(i, j, F.sum(F.col(a) * F.col(b))) for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    cells += [(i, -1, F.sum(F.col(a) * F.col(target))) for i, a in enumerate(features)]
    row = df.agg(*[x.alias(f"c{n}") for n, (_, _, x) in enumerate(cells)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{n}").alias("value")) for n, (i, j, _) in enumerate(cells)])).alias("s")).select("s.*")


def ridge_loo(df: DataFrame, group: list[str], features: list[str], target: str, alphas: tuple[float, ...]) -> DataFrame:
    """Per group: n, the leave-one-out R2 of a ridge with intercept on standardised features, the best penalty (the first
    of equal ones), and whether it lies at an end of the grid. Rows whose target is not finite do not count.

    A group is never gathered: its moments and its Gram matrix are sums, each penalty's small system is solved once a
    group, and errors and leverages are expressions over the rows that are summed again. The least error over the
    penalties is also what is reported, so R2 is too high by what the choice gains; see ridge_nested.
    """
    d = len(features)
    rows = df.where(finite(F.col(target))).select(*group, F.col(target).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    moments = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("my"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)], *[(F.stddev_pop(f"x{i}") + 1e-12).alias(f"s{i}") for i in range(d)])
    z = rows.join(moments, group).select(*group, "n", (F.col("y") - F.col("my")).alias("y"), F.array(*[(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(d)]).alias("z"))
    at = lambda i: F.col("z")[i]
    sums = z.groupBy(*group).agg(F.first("n").alias("n"), F.sum(F.col("y") * F.col("y")).alias("total"), F.array(*[F.sum(at(i) * at(j)) for i in range(d) for j in range(d)]).alias("gram"), F.array(*[F.sum(at(i) * F.col("y")) for i in range(d)]).alias("xy"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            inverse = [[np.linalg.inv(np.array(g).reshape(d, d) + a * np.eye(d)) for a in alphas] for g in b["gram"]]
            b["weights"] = [[(m @ np.array(xy)).tolist() for m in ms] for ms, xy in zip(inverse, b["xy"])]
            b["inverses"] = [[m.ravel().tolist() for m in ms] for ms in inverse]
            yield b[[*group, "total", "weights", "inverses"]]

    keys = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in group)
    solved = sums.mapInPandas(solve, f"{keys}, total double, weights array<array<double>>, inverses array<array<double>>")
    e = z.join(solved, group)

    def left_out(a: int) -> Column:
        residual = F.col("y") - sum((F.col("weights")[a][i] * at(i) for i in range(d)), F.lit(0.0))
        leverage = sum((F.col("inverses")[a][i * d + j] * at(i) * at(j) for i in range(d) for j in range(d)), F.lit(0.0))
        return residual / F.greatest(1 - leverage - 1 / F.col("n"), F.lit(1e-6))

    errors = e.groupBy(*group).agg(F.first("n").alias("n"), F.first("total").alias("total"), F.array(*[F.sum(left_out(a) * left_out(a)) for a in range(len(alphas))]).alias("sse"))
    best = F.array_position("sse", F.array_min("sse")).cast("int")
    chosen = errors.withColumn("alpha", F.element_at(F.lit(list(alphas)), best))
    return chosen.select(*group, "n", (1 - F.try_divide(F.array_min("sse"), F.col("total"))).alias("r2"), "alpha", F.col("alpha").isin(min(alphas), max(alphas)).alias("at_edge"))


def ridge_nested(df: DataFrame, group: list[str], case: str, features: list[str], target: str, alphas: tuple[float, ...], resamples: int = 2000, seed: int = 0) -> DataFrame:
    """Per group: n, the R2 of nested leave-one-out predictions, its 95 % interval over resampled cases, the median penalty
    and the share of held-out cases whose penalty lies at an end of the grid.

    For each held-out case the others' statistics standardise the features, the others' own leave-one-out errors choose
    the penalty, and a fit on the others predicts it. A group is an evaluation set (one feature set and target, some
    hundreds of cases): each held-out case of it is a task of its own, which is given the group's rows.
    """
    d = len(features)
    rows = df.where(finite(F.col(target))).select(*group, F.col(case).alias("case_"), F.struct(F.col(case).alias("id"), F.col(target).cast("double").alias("y"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")).alias("r"))
    whole = rows.groupBy(*group).agg(F.sort_array(F.collect_list("r")).alias("rs"))
    folds = whole.select(*group, "rs", F.posexplode("rs").alias("held", "r")).drop("r").repartition(*group, "held")

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rs, held in zip(b["rs"], b["held"]):
                x, y = np.array([r["x"] for r in rs]).reshape(len(rs), d), np.array([r["y"] for r in rs])
                out.append((float(y[held]), *nested_prediction(x, y, int(held), alphas)))
            yield b[group].assign(**{c: [o[i] for o in out] for i, c in enumerate(("y", "predicted", "alpha"))}, held=b["held"])

    keys = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in group)
    told = folds.mapInPandas(predict, f"{keys}, y double, predicted double, alpha double, held int")
    per = told.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("held", "y", "predicted", "alpha"))).alias("ps"))

    def interval(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ps in b["ps"]:
                y, p, a = (np.array([r[c] for r in ps]) for c in ("y", "predicted", "alpha"))
                error, rng = (y - p) ** 2, np.random.default_rng(seed)
                picks = rng.integers(0, len(y), (resamples, len(y)))
                spread = ((y[picks] - y[picks].mean(1, keepdims=True)) ** 2).sum(1)
                r2 = 1 - error[picks].sum(1)[spread > 0] / spread[spread > 0]
                lo, hi = np.quantile(r2, [0.025, 0.975]) if len(r2) else (np.nan, np.nan)
                total = ((y - y.mean()) ** 2).sum()
                out.append((len(y), 1 - error.sum() / total if total > 0 else np.nan, lo, hi, np.median(a), np.isin(a, (min(alphas), max(alphas))).mean()))
            yield b[group].assign(**{c: [o[i] for o in out] for i, c in enumerate(("n", "r2", "r2_lo", "r2_hi", "alpha_median", "at_edge_share"))})

    return per.mapInPandas(interval, f"{keys}, n long, r2 double, r2_lo double, r2_hi double, alpha_median double, at_edge_share double")


def nested_prediction(x: np.ndarray, y: np.ndarray, held: int, alphas: tuple[float, ...]) -> tuple[float, float]:
    """The prediction of one held-out row and the penalty that the others chose for it. A ridge with a free intercept that
    leaves a row out errs by residual / (1 - leverage), so no inner fold is fitted again."""
    rest = np.arange(len(y)) != held
    mean, scale = x[rest].mean(0), x[rest].std(0) + 1e-12
    z, t, level = (x[rest] - mean) / scale, y[rest] - y[rest].mean(), y[rest].mean()
    u, s, v = np.linalg.svd(z, full_matrices=False)
    best, n = (np.inf, alphas[0]), len(t)
    for a in alphas:
        shrink = s * s / (s * s + a)
        left_out = (t - u @ (shrink * (u.T @ t))) / (1 - (u * u * shrink).sum(1) - 1 / n)
        sse = float((left_out**2).sum())
        if sse < best[0]:
            best = sse, a
    weights = v.T @ (s / (s * s + best[1]) * (u.T @ t))
    return float(level + ((x[held] - mean) / scale) @ weights), float(best[1])


def readout(embeddings: dict[str, tuple[DataFrame, list[str]]], targets: DataFrame, case: str, names: list[str], alphas: tuple[float, ...], resamples: int = 2000) -> DataFrame:
    """features, target and the nested and single-level leave-one-out R2 of each feature set for each case-level target.
    embeddings: name -> (table of case and features, feature columns); targets: case and the named columns."""
    long = targets.select(case, F.explode(F.array(*[F.struct(F.lit(n).alias("target"), F.col(n).cast("double").alias("y")) for n in names])).alias("t")).select(case, "t.*")
    out = None
    for name, (table, columns) in embeddings.items():
        rows = long.join(table.select(case, *columns), case).withColumn("features", F.lit(name))
        keys = ["features", "target"]
        one = ridge_nested(rows, keys, case, columns, "y", alphas, resamples).join(ridge_loo(rows, keys, columns, "y", alphas).select(*keys, F.col("r2").alias("r2_selection_biased")), keys)
        out = one if out is None else out.unionByName(one)
    return out
