"""Nearest-neighbour joins within cases, by tiles with a certificate, and what builds on them."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut

#: Reference points of a case up to which it is one tile, and those of a tile of a larger case, about.
DIRECT, TILE = 512, 256
#: Of a large case's references one in so many places the tiles, a million at most; fewer than FEWEST of them make no tile.
SAMPLED, MOST, FEWEST = 16, 1_000_000, 8
#: Rows of a task, distances that are held at once, and k up to which a row of distances is searched k times.
ROWS, HELD, SMALL_K = 500_000, 1 << 16, 16


def _plant(x: np.ndarray, least: int) -> list[tuple]:
    """The nodes (axis or -1, value, left, right, tile) of a tree that halves the sample at the median of its widest axis."""
    nodes, todo, tiles = [None], [(0, x)], 0
    while todo:
        at, part = todo.pop()
        lo, hi = (part.min(0), part.max(0)) if len(part) else (np.zeros(3), np.zeros(3))
        axis = int(np.argmax(hi - lo))
        if len(part) < 2 * least or not hi[axis] > lo[axis]:
            nodes[at] = (-1, 0.0, at, at, tiles)
            tiles += 1
            continue
        value = np.median(part[:, axis])
        if not value > lo[axis]:
            value = part[:, axis][part[:, axis] > lo[axis]].min()
        left = part[:, axis] < value
        nodes[at] = (axis, float(value), len(nodes), len(nodes) + 1, -1)
        todo += [(len(nodes), part[left]), (len(nodes) + 1, part[~left])]
        nodes += [None, None]
    return nodes


def _trees(big: DataFrame, refs: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first node of each large case by its number, and the nodes of all trees: about five numbers for TILE references."""
    rate = F.least(F.lit(1 / SAMPLED), F.lit(MOST) / F.col("n"))
    sample = refs.join(F.broadcast(big), "case_id").where(F.pmod(F.xxhash64("ref_id", "x", "y", "z"), F.lit(1 << 20)) < F.greatest(F.lit(1.0), rate * (1 << 20)))
    sampled, tile, fewest = SAMPLED, TILE, FEWEST

    def run(batch: pa.Table) -> pa.Table:
        x = np.stack([batch.column(c).to_numpy() for c in "xyz"], 1)
        x = x[np.isfinite(x).all(1)]
        nodes = _plant(x, max(fewest, tile // sampled // 2))
        return pa.table({"no": pa.array([batch.column("no")[0].as_py()], pa.int32()), **{f"n{i}": pa.array([[n[i] for n in nodes]]) for i in range(5)}}).cast(pa.schema(
            [("no", pa.int32()), *[(f"n{i}", pa.list_(pa.float64() if i == 1 else pa.int64())) for i in range(5)]]))

    rows = sample.select("no", "x", "y", "z").groupBy("no").applyInArrow(run, "no int, n0 array<bigint>, n1 array<double>, n2 array<bigint>, n3 array<bigint>, n4 array<bigint>")
    got = {r.no: r for r in rows.collect()}  # the trees, a row a large case
    roots, parts, at = np.zeros(big.count(), np.int64), [[] for _ in range(5)], 0
    for no in range(len(roots)):
        r = got.get(no)
        node = [np.array(r[f"n{i}"]) for i in range(5)] if r else [np.array([v]) for v in (-1, 0.0, 0, 0, 0)]
        roots[no] = at
        for i in range(5):
            parts[i].append(node[i] + at if i in (2, 3) else node[i])
        at += len(node[0])
    return roots, [np.concatenate(p) for p in parts]


def _changes(column: pa.Array) -> np.ndarray:
    """Places at which a sorted column has another value than before."""
    if pa.types.is_struct(column.type):
        parts = [_changes(f) for f in column.flatten()]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
    return np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1


def _closest(asked: np.ndarray, refs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of the k nearest references, ties by place; not a number comes last."""
    with np.errstate(all="ignore"):
        d, e = np.empty((2, len(asked), len(refs)))
        for c in range(3):
            into = e if c else d
            np.subtract(asked[:, c, None], refs[None, :, c], out=into)
            into *= into
            if c:
                d += e
    k = min(k, len(refs))
    rows = np.arange(len(asked))
    if k > SMALL_K or not np.isfinite(d.max()):
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        return at, np.take_along_axis(d, at, 1)
    at, far = np.empty((len(asked), k), np.int64), np.empty((len(asked), k))
    for i in range(k):
        at[:, i] = d.argmin(1)
        far[:, i] = d[rows, at[:, i]]
        d[rows, at[:, i]] = np.inf
    return at, far


def _box2(boxes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of boxes (n, 6) from the box or point lo to hi, rounded as those of points are, so never above them."""
    d = np.zeros(np.broadcast_shapes(boxes[..., 0].shape, lo[..., 0].shape))
    with np.errstate(all="ignore"):
        for c in range(3):
            e = np.maximum(np.maximum(boxes[..., c] - hi[..., c], lo[..., c] - boxes[..., 3 + c]), 0.0)
            d = d + e * e
    return d


def _visits(asked: np.ndarray, far: np.ndarray, tile: int, numbers: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a point and another tile of its case that may hold something as near as what it has: first the tiles near all
    points at once, then those of each."""
    if len(numbers) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    reach = np.where(np.isnan(far), np.inf, far)
    near = np.flatnonzero(~(_box2(boxes, asked.min(0), asked.max(0)) > reach.max()) & (numbers != tile))
    i, j = np.nonzero(~(_box2(boxes[near][None], asked[:, None], asked[:, None]) > reach[:, None]))
    return i, numbers[near[j]]


class _Tile:
    """The references of a tile as they come, in the order of their ids; of those at one place the first k do."""

    def __init__(self, k: int):
        self.k, self.x, self.ids, self.size, self.limit, self.closed = k, [], [], 0, 1 << 14, False

    def add(self, x: np.ndarray, ids: pa.Array) -> None:
        self.closed = False
        self.x.append(x)
        self.ids.append(ids)
        self.size += len(x)
        if self.size > self.limit:
            self.close()
            self.limit = max(self.limit, 2 * self.size)

    def close(self) -> None:
        if self.closed:
            return
        x, ids = (np.concatenate(self.x), pa.concat_arrays(self.ids)) if self.x else (np.zeros((0, 3)), None)
        if len(x) > self.k:
            order = np.lexsort((x[:, 2], x[:, 1], x[:, 0]))  # stable: a place's references keep their order
            new = np.r_[True, (x[order[1:]] != x[order[:-1]]).any(1)]
            nth = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
            keep = np.sort(order[nth < self.k])
            if len(keep) < len(x):
                x, ids = x[keep], ids.take(pa.array(keep))
        self.x, self.ids, self.size, self.closed = [x], [] if ids is None else [ids], len(x), True


def _meet(rows: DataFrame, k: int, boxes: tuple | None) -> DataFrame:
    """One row for each asking row: its k nearest of its tile (refs, d2s) and the other tiles it has to see. rows: case_id, tile,
    asks, ref_id, point_id, x, y, z, no. They are sorted by tile, references first, and pass once; a tile's references are held."""
    types = dict(rows.dtypes)
    ordered = rows.sortWithinPartitions("case_id", "tile", "asks", "ref_id")
    schema = f"case_id {types['case_id']}, point_id {types['point_id']}, x double, y double, z double, no int, refs array<{types['ref_id']}>, d2s array<double>, others array<int>"
    held = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tile = None, _Tile(k)
        for b in batches:
            if not b.num_rows:
                continue
            col = {c: b.column(c) for c in ("case_id", "tile", "asks", "ref_id", "point_id", "no")}
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1)
            asks, number = col["asks"].to_numpy(zero_copy_only=False), col["tile"].to_numpy()
            ends = np.unique(np.concatenate([[0, b.num_rows], _changes(col["case_id"]), _changes(col["tile"])])).astype(int)
            refs_of, d2_of = [], np.zeros(b.num_rows * k)
            owner, at_out, seen_i, seen_t = [], 0, [], []
            for s, e in zip(ends[:-1], ends[1:]):
                here = (col["case_id"][s].as_py(), int(number[s]))
                if here != last:
                    last, tile = here, _Tile(k)
                m = s + int(np.searchsorted(asks[s:e], 1))
                if m > s:
                    tile.add(x[s:m], col["ref_id"].slice(s, m - s))
                if m == e:
                    continue
                tile.close()
                n = tile.size
                step = max(1, held // max(n, 1))
                for a in range(m, e, step):
                    z = min(a + step, e)
                    far = np.full(z - a, np.inf)
                    if n:
                        at, d = _closest(x[a:z], tile.x[0], k)
                        refs_of.append(tile.ids[0].take(pa.array(at.ravel())))
                        d2_of[at_out : at_out + d.size] = d.ravel()
                        at_out += d.size
                        owner.append(np.full(z - a, d.shape[1]))
                        if d.shape[1] == k:
                            far = d[:, -1]
                    else:
                        owner.append(np.zeros(z - a, np.int64))
                    no = col["no"][a].as_py()
                    if boxes is not None and no is not None:
                        first, numbers, sides = boxes
                        r = slice(first[no], first[no + 1])
                        i, t = _visits(x[a:z], far, int(number[a]), numbers[r], sides[r])
                        seen_i.append(i + a)
                        seen_t.append(t)
            asking = np.flatnonzero(asks)
            if not len(asking):
                continue
            ids = pa.concat_arrays(refs_of) if refs_of else pa.nulls(0, col["ref_id"].type)
            offsets = pa.array(np.r_[0, np.cumsum(np.concatenate(owner))].astype(np.int32))
            si, st = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (seen_i, seen_t))
            order = np.argsort(si, kind="stable")
            others = pa.ListArray.from_arrays(pa.array(np.searchsorted(si[order], np.r_[asking, b.num_rows]).astype(np.int32)), pa.array(st[order].astype(np.int32)))
            pick = pa.array(asking)
            yield pa.RecordBatch.from_arrays(
                [col["case_id"].take(pick), col["point_id"].take(pick), *[pa.array(x[asking, c]) for c in range(3)], col["no"].take(pick), pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, pa.array(d2_of[:at_out])), others],
                ["case_id", "point_id", "x", "y", "z", "no", "refs", "d2s", "others"])

    return ordered.mapInArrow(run, schema)


def nearest_lists(rows: DataFrame, k: int) -> DataFrame:
    """case_id, point_id, x, y, z, near (ref_id, d2 of the k nearest references of the case, nearest first, ties by ref_id; empty in a
    case without any) of each asking row. rows: case_id, asks (0: a reference, 1: a point), ref_id, point_id, x, y, z; a written
    table or a cheap one, as it is read three times.

    A case of up to DIRECT references is one tile; a larger one is cut into tiles of about TILE by a tree that a sample of it places,
    so they follow the points however these lie. A point meets the references of its own tile, and after that those of each tile whose
    box is not farther than the k-th it has: nothing is left out, and few points have such tiles. Points and references are sorted
    by tile and pass as a stream; a task holds one tile's references, and its distances a bounded piece at a time.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col("case_id").isNotNull() | (F.col("asks") == 1))
    refs = rows.where("asks = 0")
    sizes = cut(refs.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > DIRECT), "large")
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    if not sizes.limit(1).count():
        placed = rows.withColumns({"tile": F.lit(0), "no": F.lit(None).cast("int")})
        return _meet(placed.repartition(parts, "case_id"), k, None).select("case_id", "point_id", "x", "y", "z", F.arrays_zip(F.col("refs").alias("ref_id"), F.col("d2s").alias("d2")).alias("near"))
    # At most a row for DIRECT references, numbered in one task.
    big = cut(sizes.withColumn("no", (F.row_number().over(Window.orderBy("case_id")) - 1).cast("int")), "large")
    roots, (axis, value, left, right, leaf) = _trees(big, refs)

    @F.pandas_udf("int")
    def tile_of(no, x, y, z):
        import pandas as pd

        inside = no.to_numpy() >= 0
        at, p = roots[no.to_numpy()[inside]], np.stack([x, y, z], 1)[inside]
        rest = np.flatnonzero(axis[at] >= 0)
        while len(rest):
            node = at[rest]
            at[rest] = np.where(p[rest, axis[node]] < value[node], left[node], right[node])
            rest = rest[axis[at[rest]] >= 0]
        out = np.zeros(len(no), np.int32)
        out[inside] = leaf[at]
        return pd.Series(out)

    numbered = rows.join(F.broadcast(big.select("case_id", "no")), "case_id", "left")
    placed = cut(numbered.withColumn("tile", tile_of(F.coalesce("no", F.lit(-1)), "x", "y", "z")), "tiles")
    ends = [F.min(F.when(~F.isnan(c), F.col(c))).alias(f"lo{c}") for c in "xyz"] + [F.max(F.when(~F.isnan(c), F.col(c))).alias(f"hi{c}") for c in "xyz"]
    got = placed.where("asks = 0 and no is not null").groupBy("no", "tile").agg(*ends).orderBy("no", "tile").toPandas()  # a row a tile
    boxes = np.searchsorted(got["no"].to_numpy(), np.arange(len(roots) + 1)), got["tile"].to_numpy(), got.iloc[:, 2:].to_numpy(float)
    first = cut(_meet(placed.repartition(parts, "case_id", "tile"), k, boxes), "nearest")
    more = first.where(F.size("others") > 0)
    asked = more.select("case_id", F.explode("others").alias("tile"), F.lit(1).alias("asks"), F.lit(None).cast(dict(rows.dtypes)["ref_id"]).alias("ref_id"), "point_id", "x", "y", "z", "no")
    second = _meet(placed.where("asks = 0 and no is not null").select(asked.columns).unionByName(asked).repartition(parts, "case_id", "tile"), k, None)
    zipped = F.arrays_zip(F.col("refs").alias("ref_id"), F.col("d2s").alias("d2"))
    lists = more.select("case_id", "point_id", "x", "y", "z", zipped.alias("near")).unionByName(second.select("case_id", "point_id", "x", "y", "z", zipped.alias("near")))
    ranked = F.array_sort(F.transform(F.flatten(F.collect_list("near")), lambda s: F.struct(s["d2"].alias("d2"), s["ref_id"].alias("ref_id"))))
    merged = lists.groupBy("case_id", "point_id", "x", "y", "z").agg(F.slice(ranked, 1, k).alias("near")).withColumn("near", F.transform("near", lambda s: F.struct(s["ref_id"].alias("ref_id"), s["d2"].alias("d2"))))
    return first.where(F.size("others") == 0).select("case_id", "point_id", "x", "y", "z", zipped.alias("near")).unionByName(merged)


def knn(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """case_id, point_id, rank (from 1), ref_id, d2: the k nearest rows of right (case_id, ref_id, x, y, z) to each row
    of left (case_id, point_id, x, y, z), nearest first, ties by ref_id; see nearest_lists."""
    at = [F.col(c).cast("double").alias(c) for c in "xyz"]
    ref, point = dict(right.dtypes)["ref_id"], dict(left.dtypes)["point_id"]
    refs = right.select("case_id", F.lit(0).alias("asks"), "ref_id", F.lit(None).cast(point).alias("point_id"), *at)
    asked = left.select("case_id", F.lit(1).alias("asks"), F.lit(None).cast(ref).alias("ref_id"), "point_id", *at)
    out = nearest_lists(refs.unionByName(asked), k)
    return out.select("case_id", "point_id", F.posexplode("near").alias("i", "r")).select("case_id", "point_id", (F.col("i") + 1).alias("rank"), "r.ref_id", "r.d2")


def attach_prior(points: DataFrame, prior: DataFrame, fields: list[str]) -> DataFrame:
    """Each point takes the fields of the nearest prior point, as prior_<field>; points of a case without a
    prior keep null."""
    near = knn(points, prior, 1).select("case_id", "point_id", "ref_id", "d2")
    values = prior.select("case_id", "ref_id", *[F.col(f).alias(f"prior_{f}") for f in fields])
    return points.join(near.join(values, ["case_id", "ref_id"]), ["case_id", "point_id"], "left")


def wall_geometry(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Distance to the nearest wall face and the unit vector from it; the face's own normal where they touch.
    faces: case_id, ref_id, x, y, z, fnx, fny, fnz."""
    near = knn(points, faces, 1).select("case_id", "point_id", "ref_id", F.sqrt("d2").alias("wall"))
    f = faces.select("case_id", "ref_id", *[F.col(c).alias(f"f{c}") for c in "xyz"], "fnx", "fny", "fnz")
    out = points.join(near, ["case_id", "point_id"]).join(f, ["case_id", "ref_id"])
    normal = {f"wn{c}": F.when(F.col("wall") > 1e-12, F.try_divide(F.col(c) - F.col(f"f{c}"), F.col("wall"))).otherwise(F.col(f"fn{c}")) for c in "xyz"}
    return out.withColumns(normal).select("case_id", "point_id", "ref_id", "wall", "wnx", "wny", "wnz", "z")


def with_ground(walls: DataFrame, ground_z: float) -> DataFrame:
    """The ground plane competes with the walls: nearer ground gives distance z - ground and normal up."""
    d = F.col("z") - ground_z
    nearer = d < F.col("wall")
    return walls.select("case_id", "point_id", F.least(F.col("wall"), d).alias("wall"), *[F.when(nearer, F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in (("wnx", 0.0), ("wny", 0.0), ("wnz", 1.0))])


def compare_shared(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str], l_ref: float, most: float) -> DataFrame:
    """Points of a matched with their nearest in b up to `most` lengths: matches, and relative L2 of the fields;
    without a match the status says so and the error is null."""
    near = knn(a, b, 1).where(F.sqrt("d2") / l_ref <= most).select("case_id", "point_id", "ref_id")
    av = a.select("case_id", "point_id", *[F.col(f).alias(f"a_{f}") for f in fields])
    bv = b.select("case_id", "ref_id", *[F.col(f).alias(f"b_{f}") for f in fields])
    m = near.join(av, ["case_id", "point_id"]).join(bv, ["case_id", "ref_id"])
    err = F.sqrt(F.sum(sum(((F.col(f"a_{f}") - F.col(f"b_{f}")) * (F.col(f"a_{f}") - F.col(f"b_{f}")) for f in fields), F.lit(0.0))))
    size = F.sqrt(F.sum(sum((F.col(f"b_{f}") * F.col(f"b_{f}") for f in fields), F.lit(0.0))))
    got = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matched"), (err / (size + 1e-12)).alias("rel_l2"))
    out = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points")).join(got, keys, "left")
    return out.select(*keys, "n_points", F.coalesce("n_matched", F.lit(0)).cast("long").alias("n_matched"), F.when(F.col("n_matched") > 0, "ok").otherwise("insufficient_matches").alias("status"), "rel_l2")


def compare_frames(a: DataFrame, b: DataFrame, l_ref: float) -> DataFrame:
    """Per case: quantiles .5, .9, .99 of the distance to the nearest point of b and of the difference in wall
    distance, both by the reference length."""
    near = knn(a, b, 1).select("case_id", "point_id", "ref_id", "d2")
    m = near.join(a.select("case_id", "point_id", F.col("wall_dist").alias("wa")), ["case_id", "point_id"]).join(b.select("case_id", "ref_id", F.col("wall_dist").alias("wb")), ["case_id", "ref_id"])
    q = lambda x: F.percentile(x, F.array(*[F.lit(v) for v in (0.5, 0.9, 0.99)]))
    out = m.groupBy("case_id").agg(q(F.sqrt("d2") / l_ref).alias("d"), q(F.abs(F.col("wa") - F.col("wb")) / l_ref).alias("w"))
    return out.select("case_id", *[F.col(c)[i].alias(f"{n}_{p}") for c, n in (("d", "match"), ("w", "wall")) for i, p in enumerate(("q50", "q90", "q99"))])


def one_to_one(left: DataFrame, right: DataFrame, tolerance: Column) -> DataFrame:
    """Per case: rows, rows whose nearest reference lies within their own tolerance, distinct references, and
    whether the match is one to one. left has a column for the tolerance's expression."""
    near = knn(left, right, 1).join(left.select("case_id", "point_id", tolerance.alias("tol")), ["case_id", "point_id"])
    return near.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.sqrt("d2") <= F.col("tol")).alias("n_close"), F.count_distinct("ref_id").alias("n_refs"),
        (F.bool_and(F.sqrt("d2") <= F.col("tol")) & (F.count_distinct("ref_id") == F.count(F.lit(1)))).alias("one_to_one"))
