"""Attention over sets of any size, rotary positions over three axes, and tokens as blocks, against plain NumPy."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.operators import attention, tokens


def plain_attention(q, k, v):
    s = q @ k.T / math.sqrt(q.shape[1])
    e = np.exp(s - s.max(1, keepdims=True))
    return e @ v / e.sum(1, keepdims=True)


@pytest.mark.parametrize("shape", [{"block": 1}, {"block": 7}, {"block": 10**6}, {"tile_queries": 9, "tile_keys": 40, "block": 7}, {"tile_queries": 10**6, "tile_keys": 25}])
def test_attention_does_not_depend_on_blocks_and_tiles(spark, shape):
    rng = np.random.default_rng(1)
    sizes = {"hot": (150, 400), "small": (3, 1), "none": (4, 0), "extreme": (5, 60)}
    data = {g: (rng.normal(size=(a, 4)) * (300 if g == "extreme" else 2), rng.normal(size=(b + 5, 4)), rng.normal(size=(b + 5, 4))) for g, (a, b) in sizes.items()}
    queries = spark.createDataFrame([(g, i, x.tolist()) for g, (q, _, _) in data.items() for i, x in enumerate(q)], "g string, query_id long, q array<double>").repartition(3)
    memory = spark.createDataFrame([(g, i, x.tolist(), y.tolist(), i < sizes[g][1]) for g, (_, k, v) in data.items() for i, (x, y) in enumerate(zip(k, v))], "g string, key_id long, k array<double>, v array<double>, valid boolean").repartition(5)
    got = {(r.g, r.query_id): [r[f"o{i}"] for i in range(4)] for r in attention.attention(queries, memory, "g", 4, **shape).collect()}
    want = {(g, i): x for g, (q, k, v) in data.items() if sizes[g][1] for i, x in enumerate(plain_attention(q, k[: sizes[g][1]], v[: sizes[g][1]]))}
    assert got.keys() == want.keys() and all(np.allclose(got[x], want[x], rtol=1e-9, atol=1e-12) for x in want)


def test_states_merge_in_any_order():
    rng = np.random.default_rng(2)
    q, k, v = rng.normal(size=(6, 4)) * 50, rng.normal(size=(30, 4)), rng.normal(size=(30, 4))
    for order in (range(30), reversed(range(30))):
        state = np.full(6, -np.inf), np.zeros(6), np.zeros((6, 4))
        for i in order:
            state = attention.merged(state, q @ k[i : i + 1].T / 2, v[i : i + 1])
        assert np.allclose(state[2] / state[1][:, None], plain_attention(q, k, v))


@pytest.mark.parametrize("size", [6, 14, 5])
def test_rotary_products_depend_on_differences_of_positions(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=size).tolist(), rng.normal(size=size).tolist(), *rng.normal(size=6).tolist()) for i in range(20)]
    d = spark.createDataFrame(rows, "id int, a array<double>, b array<double>, " + ", ".join(f"p{i} double" for i in range(6)))
    turn = lambda c, at, shift=0.0: attention.rotary_axes(F.col(c), [F.col(f"p{at + i}") + F.lit(shift * (i + 1)) for i in range(3)], size, 0.1, 50.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    got = d.select(dot(turn("a", 0), turn("b", 3)).alias("here"), dot(turn("a", 0, 1.7), turn("b", 3, 1.7)).alias("there"), dot(turn("a", 0), turn("a", 0)).alias("length"), dot(F.col("a"), F.col("a")).alias("same"), turn("a", 0).alias("t"), "a").collect()
    assert all(abs(r.here - r.there) < 1e-9 and abs(r.length - r.same) < 1e-9 and len(r.t) == size for r in got)
    assert all(r.t[size // 6 * 6 :] == r.a[size // 6 * 6 :] for r in got) and (size < 6) == all(r.t == r.a for r in got)


def test_tokens_as_blocks_and_pooled(spark):
    rng = np.random.default_rng(4)
    rows = [(c, i, *rng.normal(size=3).tolist(), float(abs(rng.normal()))) for c, n in (("a", 60), ("b", 3)) for i in range(n)]
    points = spark.createDataFrame(rows, "case_id string, point_id long, x double, y double, z double, wall_dist double")
    groups = tokens.token_groups(points, 5, 4, 6, 0.5, 2.0)
    found = tokens.assemble(groups, points, {"wall_dist": F.col("wall_dist"), "twice": F.col("wall_dist") * 2})
    at = {(r[0], r[1]): np.array(r[2:5]) for r in rows}
    wall = {(r[0], r[1]): r[5] for r in rows}
    want = {}
    for g in groups.collect():
        rel = (at[g.case_id, g.ref_id] - at[g.case_id, g.centre_id]) / g.radius
        want[g.case_id, g.scale, g.token, g.rank] = [*rel, wall[g.case_id, g.ref_id], 2 * wall[g.case_id, g.ref_id]]
    got = {tuple(r)[:4]: tuple(r)[4:] for r in found.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    columns = ["rx", "ry", "rz", "wall_dist", "twice"]
    blocks = {r.case_id: (np.frombuffer(r.data, np.float32).reshape(9, 6, 5), np.frombuffer(r.mask, np.uint8).reshape(9, 6)) for r in tokens.token_blocks(found, columns, 9, 6).collect()}
    assert blocks["a"][1].sum() == 54 and blocks["b"][1].sum() == 6 * 3 and not blocks["b"][0][6:].any()
    for (c, scale, token, rank), x in want.items():
        row = token + (5 if c == "a" else 3) * scale
        assert np.allclose(blocks[c][0][row, rank - 1], x, rtol=1e-6)
    near = F.col("wall_dist") < 0.3
    best = {(r.case_id, r.scale, r.token): r for r in tokens.pooled(found, groups, columns, near).collect()}
    for (c, scale, token), r in best.items():
        own = [x for k, x in want.items() if k[:3] == (c, scale, token) and x[3] < 0.3]
        assert r.n_valid == len(own) and np.allclose([r[n] for n in columns], np.max(own, 0) if own else 0)
    with pytest.raises(Exception, match="tokens of up to"):
        tokens.token_blocks(found, columns, 8, 6).collect()


@pytest.mark.parametrize("best", [1, 3, 50])
def test_large_cases_are_chosen_as_small_ones(spark, monkeypatch, best):
    rng = np.random.default_rng(7)
    rows = [("free", i, *rng.normal(size=3).tolist(), float(rng.uniform(0.1, 2))) for i in range(400)]
    rows += [("grid", 1000 - i, float(i % 5), float(i // 5 % 5), float(i // 25), 1.0) for i in range(125)]  # ties
    rows += [("same", i, 1.0, 1.0, 1.0 if i else 2.0, 0.5) for i in range(12)] + [("few", i, float(i), 0.0, 0.0, 1.0) for i in range(3)]
    points = spark.createDataFrame(rows, "case_id string, point_id long, x double, y double, z double, wall_dist double").repartition(4)
    sets = lambda d: sorted(map(tuple, d.collect()))
    near = lambda d: {(r.case_id, r.scale, r.token, r.rank): (r.centre_id, r.ref_id, round(r.dist, 9), round(r.r_eff, 9), r.radius) for r in d.collect()}
    far, start, groups = sets(tokens.farthest_points(points, 30, "wall_dist", 0)), sets(tokens.farthest_points(points, 8, start=77)), near(tokens.token_groups(points, 9, 6, 5, 0.5, 2.0))
    monkeypatch.setattr(tokens, "LARGE", 11)
    monkeypatch.setattr(tokens, "CHUNK", 40)
    monkeypatch.setattr(tokens, "BEST", best)
    assert set(tokens.large_cases(points)) == {"free", "grid", "same"}
    assert sets(tokens.farthest_points(points, 30, "wall_dist", 0)) == far
    if best == 3:
        assert sets(tokens.farthest_points(points, 8, start=77)) == start and near(tokens.token_groups(points, 9, 6, 5, 0.5, 2.0)) == groups
