"""What must not grow with a table's rows: what passes through the driver, and what one task holds."""
import hashlib
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from meshloom import queries
from meshloom.operators import etl, graph, retrieval, sampling, spatial


def test_orientation_sends_no_table_of_faces_through_the_driver(spark, monkeypatch):
    plans = []
    written = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, what="cut": plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, what))
    c = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    rows = [("a", i, *[x for v in f for x in c[v]]) for i, f in enumerate(((0, 1, 2), (0, 1, 3), (0, 3, 2), (1, 2, 3)))]
    out = graph.orientations(spark.createDataFrame(rows, "case_id string, face_id long, " + ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz")))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r.face_id: (r.flip, r.component, r.closed) for r in out.collect()} == {i: (i == 0, 0, True) for i in range(4)}
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_an_open_surface_with_as_many_faces_each_way_keeps_its_first(spark):
    a, b, c, d = (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (1.0, 1.0, 0.0)
    rows = [("a", 7, *a, *b, *c), ("a", 3, *b, *c, *d)]  # both run b to c
    faces = spark.createDataFrame(rows, "case_id string, face_id long, " + ", ".join(f"{x}{k} double" for k in range(3) for x in "xyz"))
    for parts in (faces, faces.orderBy("face_id").coalesce(1)):
        assert {r.face_id: r.flip for r in graph.orientations(parts).collect()} == {3: False, 7: True}


def test_neighbours_over_tiles_of_copies_lines_and_short_cases(spark, monkeypatch):
    monkeypatch.setattr(spatial, "DIRECT", 50)
    monkeypatch.setattr(spatial, "TILE", 64)
    monkeypatch.setattr(spatial, "SAMPLED", 2)
    monkeypatch.setattr(spatial, "HELD", 500)
    rng = np.random.default_rng(4)
    line = np.round(np.stack([rng.integers(0, 3, 900) / 10, rng.integers(0, 2, 900) / 2, rng.uniform(0, 3, 900)], 1), 2)
    refs = {1: np.concatenate([line, np.repeat(line[:2], 300, 0)]), 2: rng.uniform(-1, 1, (30, 3)), 3: np.zeros((2, 3)), 4: np.full((400, 3), 1.5)}
    asked = {1: np.concatenate([line[::7], rng.uniform(-1, 4, (60, 3))]), 2: rng.uniform(-2, 2, (40, 3)), 3: np.ones((4, 3)), 4: np.ones((3, 3)), 5: np.ones((2, 3))}
    frame = lambda cases, name: spark.createDataFrame([(c, i, *map(float, p)) for c, x in cases.items() for i, p in enumerate(x)], f"case_id long, {name} long, x double, y double, z double").repartition(3)
    got = spatial.knn(frame(asked, "point_id"), frame(refs, "ref_id"), 3).toPandas().sort_values(["case_id", "point_id", "rank"])
    assert set(got.case_id) == {1, 2, 3, 4}
    for c in (1, 2, 3, 4):
        e = asked[c][:, None] - refs[c][None]
        d, n = (e[..., 0] ** 2 + e[..., 1] ** 2) + e[..., 2] ** 2, min(3, len(refs[c]))
        g, at = got[got.case_id == c], np.argsort(d, axis=1, kind="stable")[:, :n]
        assert (g.ref_id.to_numpy().reshape(-1, n) == at).all() and (g.d2.to_numpy().reshape(-1, n) == np.take_along_axis(d, at, 1)).all()


def test_no_join_of_a_case_makes_rows_of_its_pairs(spark):
    """The plan has no join of points and references, whose pairs filled the disk."""
    cells = spark.range(400).selectExpr("id % 2 as case_id", "int(id % 5) as ix", "int(id / 5 % 5) as iy", "int(id / 25) as iz", "id % 3 > 0 as fluid")
    plan = etl.voxels_to_points(cells, ["case_id"], 0.5, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_tasks_of_a_grid_go_by_its_lines(spark, monkeypatch, tmp_path):
    n = 3000
    pd.DataFrame({"l_orderkey": range(n), "l_partkey": 1, "l_suppkey": np.arange(n) % 60, "l_linenumber": 1, "l_quantity": 30.0, "l_discount": 0.0, "l_tax": 0.0}).to_parquet(tmp_path / "lineitem.parquet")
    monkeypatch.setattr(queries, "LINES", 100, raising=False)
    for name in ("vorticity", "vorticity_all"):
        assert queries.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 30


def test_scores_of_large_blocks_are_held_in_pieces():
    rng = np.random.default_rng(5)
    q, x = rng.normal(size=(2, 3000, 8))
    tracemalloc.start()
    got = [np.concatenate(c) for c in zip(*retrieval.best(np.arange(3000), q, np.arange(3000) + 7, x, 4, 1 << 16))]
    assert tracemalloc.get_traced_memory()[1] < 16e6  # all scores at once are 72 MB
    tracemalloc.stop()
    assert (got[1].reshape(3000, 4)[:50] - 7 == np.argsort(-(q[:50] @ x.T), axis=1)[:, :4]).all()


@pytest.mark.parametrize("prefix", [1, 100_000])
def test_weighted_epoch_ranks_only_where_it_ends(spark, monkeypatch, prefix):
    monkeypatch.setattr(sampling, "PREFIX", prefix, raising=False)
    rows = pd.DataFrame({"case_id": range(1000), "g": ["a"] * 100 + ["b"] * 700 + ["c"] * 200})
    out = sampling.weighted_epoch(spark.createDataFrame(rows), "g", {"a": 2.5, "b": 1.0, "c": 0.0}, 7, 2)
    want = set()
    for g, m in (("a", 714), ("b", 286), ("c", 0)):
        ids = rows.case_id[rows.g == g].tolist()
        for i in range(max(1, -(-m // len(ids)))):
            order = sorted(ids, key=lambda c: (hashlib.md5(f"7|2|{i}|{c}".encode()).hexdigest(), c))
            want |= {(c, g, i) for c in order[: max(0, m - i * len(ids))]}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) == 1000 and set(got) == want
    ranks = [w for w in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number" in w]
    assert ranks and all("g#" in w and "s#" in w.split("windowspecdefinition(")[1].split("ASC")[0] for w in ranks)  # by group and prefix


def test_lines_are_numbered_by_ranges(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(6)
    n = 2000
    f = pd.DataFrame({"l_orderkey": rng.integers(0, 300, n), "l_partkey": rng.permutation(n), "l_suppkey": 1, "l_linenumber": rng.integers(1, 4, n), "l_quantity": 5.0, "l_extendedprice": 1.0, "l_discount": 0.0, "l_returnflag": "A", "l_linestatus": "F"})
    f["l_quantity"] = np.arange(n) * 1.0
    f.to_parquet(tmp_path / "lineitem.parquet")
    monkeypatch.setattr(queries, "LINES", 150, raising=False)
    p = queries._line_points(spark, str(tmp_path))
    got = {r.id: round(r.x * 50) for r in p.collect() if r.id % 10 == 0}
    order = f.sort_values(["l_orderkey", "l_linenumber", "l_partkey"]).l_quantity.astype(int).tolist()
    assert got == {i: order[i - 1] for i in range(10, n + 1, 10)}
    assert p.count() == 240  # the lines that neither ask nor are asked for are not carried on
