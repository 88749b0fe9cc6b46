"""Shard building that can be broken off, runs with their conventions, orientation of surfaces, dictionaries, monitors, fingerprints."""
import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.operators import checks, graph, pool, runs, shards
from meshloom.sources import dictionary, text

# --- shards ---------------------------------------------------------------------------------------------------------
POINTS = "case_id string, point_id long, wall_dist double, v double"


def jobs_of(spark, cases, params=None):
    rows = spark.createDataFrame([(c, s, d) for c, (s, d) in cases.items()], "case_id string, split string, file string")
    return rows.select("case_id", "split", shards.job_digest(params or {"n_keep": 20}, "case_id", "file").alias("digest"))


def reader(spark, sizes, errors=(), log=None):
    def read(jobs):
        wanted = {r.case_id for r in jobs.collect()}
        if log is not None:
            log.append(wanted)
        if "boom" in wanted:
            raise RuntimeError("killed")
        rows = [(c, i, 0.01 * (i % 50), float(i)) for c in sorted(wanted) for i in range(sizes.get(c, 0))]
        return spark.createDataFrame(rows, POINTS), spark.createDataFrame([(c, "broken archive") for c in sorted(wanted) if c in errors], "case_id string, error string")

    return read


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs}


def test_a_job_runs_again_without_writing_and_goes_on_after_a_fault(spark, tmp_path):
    out = str(tmp_path / "out")
    cases = {f"c{i}": ("train" if i % 2 else "val", "d") for i in range(9)}
    sizes = {c: 60 for c in cases} | {"c8": 0}
    log = []
    build = lambda cs, **k: {r.case_id: r for r in shards.build(jobs_of(spark, cs), reader(spark, sizes, ("c7",), log), out, 20, 1, F.col("v"), batch_cases=4, **k).collect()}
    got = build(cases)
    # Of 20 places 10 near walls, 4 of any kind, and of 6 for the wake the 3 that are left in its upper tenth.
    assert len(log) == 3 and set().union(*log) == cases.keys() and sum(map(len, log)) == 9
    assert {c: (r.n_points, r.n_kept, r.error) for c, r in got.items()} == {**{f"c{i}": (60, 17 if i % 2 else 60, None) for i in range(7)}, "c7": (0, 0, "broken archive"), "c8": (0, 0, "no points")}
    kept = shards.points(spark, out)
    assert {r.case_id: r.n for r in kept.groupBy("case_id").agg(F.count("*").alias("n")).collect()} == {f"c{i}": 17 if i % 2 else 60 for i in range(7)}
    before = files(out)
    log.clear()
    assert build({c: v for c, v in cases.items() if c not in ("c7", "c8")}).keys() == cases.keys() and log == [] and files(out) == before
    # Only what changed, or had an error, is done again.
    log.clear()
    sizes["c8"] = 5
    got = build({**cases, "c3": ("train", "other file")})
    assert set().union(*log) == {"c3", "c7", "c8"} and (got["c8"].n_kept, got["c8"].error) == (5, None)
    same = [p for p in before if "case_id=c0" in p or "case_id=c6" in p]
    assert all(files(out)[p] == before[p] for p in same)
    # A run that breaks off leaves what it has done.
    with pytest.raises(RuntimeError, match="killed"):
        build({**cases, **{f"n{i}": ("val", "d") for i in range(12)}, "boom": ("val", "d")})
    assert shards.points(spark, out).where("case_id = 'c0'").count() == 60
    log.clear()
    sizes |= {f"n{i}": 7 for i in range(12)}
    done = {c for c, r in {r.case_id: r for r in shards.manifest(spark, out).collect()}.items() if c.startswith("n") and r.error is None}
    build({f"n{i}": ("val", "d") for i in range(12)})
    assert set().union(*log) == {f"n{i}" for i in range(12)} - done


# --- orientation ------------------------------------------------------------------------------------------------------
def sphere(n=8, radius=1.0, at=(0.0, 0.0, 0.0)):
    ring = [[(radius * math.sin(math.pi * i / n) * math.cos(2 * math.pi * j / n), radius * math.sin(math.pi * i / n) * math.sin(2 * math.pi * j / n), radius * math.cos(math.pi * i / n)) for j in range(n)] for i in range(1, n)]
    top, bottom = (0.0, 0.0, radius), (0.0, 0.0, -radius)
    tris = [(top, ring[0][j], ring[0][(j + 1) % n]) for j in range(n)] + [(bottom, ring[-1][(j + 1) % n], ring[-1][j]) for j in range(n)]
    for a, b in itertools.pairwise(ring):
        for j in range(n):
            k = (j + 1) % n
            tris += [(a[j], b[j], b[k]), (a[j], b[k], a[k])]
    return [tuple(tuple(round(x + s, 9) for x, s in zip(p, at)) for p in t) for t in tris]


def table(spark, cases):
    names = ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz")
    return spark.createDataFrame([(case, i, *[x for p in t for x in p]) for case, tris in cases.items() for i, t in enumerate(tris)], f"case_id string, face_id long, {names}")


def test_every_triangle_of_shuffled_closed_surfaces_points_outward(spark):
    rng = np.random.default_rng(0)
    turn = lambda t: t[::-1] if rng.random() < 0.5 else t
    two = [*sphere(), *sphere(6, 0.5, (5.0, 0.0, 0.0))]
    order = rng.permutation(len(two))
    mixed = [turn(two[i]) for i in order]
    inside_out = [t[::-1] for t in sphere(5)]
    strip = [[(float(i), 0.0, 0.0), (float(i + 1), 0.0, 0.0), (float(i), 1.0, 0.0)] for i in range(5)] + [[(float(i + 1), 0.0, 0.0), (float(i + 1), 1.0, 0.0), (float(i), 1.0, 0.0)] for i in range(5)]
    strip[2] = strip[2][::-1]
    faces = table(spark, {"two": mixed, "inside out": inside_out, "open": strip}).repartition(5)
    told = {(r.case_id, r.face_id): r for r in graph.orientations(faces).collect()}
    assert {k[1] for k, r in told.items() if k[0] == "open" and r.flip} == {2} and not any(r.closed for k, r in told.items() if k[0] == "open")
    assert len({r.component for k, r in told.items() if k[0] == "two"}) == 2 and all(r.orientable for r in told.values())
    for r in graph.oriented(faces).where("case_id <> 'open'").collect():
        a, b, c = (np.array([r[f"{x}{k}"] for x in "xyz"]) for k in range(3))
        middle = (a + b + c) / 3
        centre = np.array([5.0, 0, 0]) if middle[0] > 3 else np.zeros(3)
        assert np.cross(b - a, c - a) @ (middle - centre) > 0


def test_a_one_sided_surface_is_told(spark):
    n = 9
    edge = [((1 + s * 0.3 * math.cos(t / 2)) * math.cos(t), (1 + s * 0.3 * math.cos(t / 2)) * math.sin(t), s * 0.3 * math.sin(t / 2)) for t in (2 * math.pi * i / n for i in range(n)) for s in (-1, 1)]
    at = [(tuple(np.round(edge[2 * i], 9)), tuple(np.round(edge[2 * i + 1], 9))) for i in range(n)]
    at.append((at[0][1], at[0][0]))  # once around, the sides have changed
    tris = [t for i in range(n) for t in ((at[i][0], at[i + 1][0], at[i][1]), (at[i + 1][0], at[i + 1][1], at[i][1]))]
    assert not any(r.orientable or r.flip for r in graph.orientations(table(spark, {"band": [[tuple(map(float, p)) for p in t] for t in tris]})).collect())


def test_components_of_paths_rings_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(3000 + i, 3000 + (i + 1) % 50) for i in range(50)] + [(7000, 7000)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}, **{i: 3000 for i in range(3000, 3050)}, 7000: 7000}


# --- runs -------------------------------------------------------------------------------------------------------------
MANIFEST = "source string, solid_field string, solid_value double, stress_order string, pressure string, rho double, p_ref double, inflow_dir array<double>, l_ref_value double, l_ref_rule string, origin_point array<double>, origin_rule string, ground string"


def test_runs_become_canonical_points(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = rng.uniform(-3, 3, (n, 3)) + [0, 0, 3.2]
    u, p, r, mask = rng.normal(size=(n, 3)), rng.normal(size=n) + 100, rng.uniform(size=(n, 6)), (rng.random(n) < 0.2).astype(float)
    cells = spark.createDataFrame([("r1", i, *x[i].tolist(), u[i].tolist(), float(p[i]), r[i].tolist(), float(mask[i])) for i in range(n)], "case_id string, cell_id long, x double, y double, z double, UMean array<double>, pMean double, R array<double>, mask double")
    body = sphere(6, 1.0, (0.5, 0.0, 2.0))
    faces = table(spark, {"r1": body})
    run = spark.createDataFrame([("r1", 2.0, 1e-3)], "case_id string, u_ref double, nu double")
    made = lambda **k: spark.createDataFrame([tuple(({"source": "s", "solid_field": "mask", "solid_value": 1.0, "stress_order": "vtk", "pressure": "static", "rho": 1.2, "p_ref": 100.0, "inflow_dir": [2.0, 0.0, 0.0], "l_ref_value": None, "l_ref_rule": "x-extent", "origin_point": None, "origin_rule": "bbox-centre-ground", "ground": "0.1"} | k).values())], MANIFEST)
    names = {"U": "UMean", "p": "pMean", "R": "R"}
    points, cases = runs.run_points(cells, faces, run, made(), 10_000, 0, names)
    got, case = {q.point_id: q for q in points.collect()}, cases.first()
    assert got.keys() == set(np.flatnonzero(mask != 1).tolist()) and case.n_cells == len(got) and list(case.presence) == [True, True, True, False]
    lo, hi = np.min([t for f in body for t in f], 0), np.max([t for f in body for t in f], 0)
    length, origin = hi[0] - lo[0], np.array([(lo[0] + hi[0]) / 2, (lo[1] + hi[1]) / 2, 0.1])
    assert case.l_ref == pytest.approx(length) and case.log10_re == pytest.approx(math.log10(2 * length / 1e-3))
    centres = np.array([np.mean(f, 0) for f in body])
    for i, q in got.items():
        d = np.linalg.norm(x[i] - centres, axis=1)
        ground = x[i][2] - 0.1
        want = [*(x[i] - origin) / length, min(d.min(), ground) / length, *u[i] / 2, 2 * (p[i] - 100) / (1.2 * 4), r[i][:3].sum() / 2 / 4]
        assert np.allclose([q.x, q.y, q.z, q.wall_dist, q.ux, q.uy, q.uz, q.cp, q.k], want)
        assert np.allclose([q.nx, q.ny, q.nz], [0, 0, 1] if ground < d.min() else (x[i] - centres[d.argmin()]) / d.min())
    few, _ = runs.run_points(cells, faces, run, made(), 100, 0, names)
    assert few.count() <= 100 and {q.stratum for q in few.collect()} >= {0, 2}
    none, told = runs.run_points(cells.drop("R"), faces, run, made(solid_field="none", stress_order="none"), 10_000, 0, names)
    assert none.count() == n and {q.k for q in none.collect()} == {0.0} and list(told.first().presence) == [True, True, False, False]
    for bad, said in (({"pressure": "VERIFY"}, "pressure"), ({"solid_field": "other"}, "other"), ({"inflow_dir": [0.0, 0.0, 0.0]}, "inflow_dir")):
        with pytest.raises(checks.CaseError, match=said):
            runs.run_points(cells, faces, run, made(**bad), 100, 0, names)


def test_grids_without_fields_become_points(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 4, (50, 3))
    cells = spark.createDataFrame([("g", i, *x[i].tolist(), 8.0) for i in range(50)], "case_id string, cell_id long, x double, y double, z double, volume double")
    roof = [[(0.0, 0.0, 2.0), (1.0, 0.0, 2.0), (0.0, 1.0, 2.0)], [(1.0, 0.0, 2.0), (1.0, 1.0, 2.0), (0.0, 1.0, 2.0)]]
    points, frame = runs.volume_points(cells, table(spark, {"g": roof}), spark.createDataFrame([("g", 5.0, None)], "case_id string, u_ref double, l_ref double"), ground=0.0)
    f = frame.first()
    assert (round(f.ox, 9), round(f.oy, 9), f.oz, f.l_ref, f.has_ground) == (0.5, 0.5, 0.0, 2.0, True)
    centres = np.array([np.mean(t, 0) for t in roof])
    for q in points.collect():
        d = min(np.linalg.norm(x[q.point_id] - centres, axis=1).min(), x[q.point_id][2])
        assert q.wall_dist == pytest.approx(d / 2) and q.cell_size == pytest.approx(1.0) and np.allclose([q.x, q.y, q.z], (x[q.point_id] - [0.5, 0.5, 0]) / 2)


# --- dictionaries -------------------------------------------------------------------------------------------------------
def test_dictionaries_become_entries_or_errors(spark):
    texts = {
        "boundary": 'FoamFile { class polyBoundaryMesh; } // head {\n3\n(\n  ground\n  {\n    type wall; /* ; } */\n    nFaces 4;\n  }\n  "side.*" { type patch; value uniform ( 0 0 1 ); inner { a "x; y"; b; } }\n  procBoundary0to1 { type processor; }\n)\n// **** //\n',
        "open": "a { b 1;", "many": "a 1; }", "tail": "a 1; b", "blank": " // nothing\n", "deep": "a {" * 9 + "x 1;" + "}" * 9, "none": None,
    }
    found = dictionary.entries(spark.createDataFrame(list(texts.items()), "file string, text string").repartition(3), ["file"]).collect()
    good = sorted((r.place, "/".join(r.path), r.key, r.value) for r in found if r.file == "boundary")
    assert good == [(1, "FoamFile", "class", "polyBoundaryMesh"), (2, "ground", "type", "wall"), (3, "ground", "nFaces", "4"), (4, '"side.*"', "type", "patch"), (5, '"side.*"', "value", "uniform (0 0 1)"),
                    (6, '"side.*"/inner', "a", "x; y"), (7, '"side.*"/inner', "b", None), (8, "procBoundary0to1", "type", "processor")]
    assert {r.file: r.error for r in found if r.error} == {"open": "a brace is open", "many": "a brace too many", "tail": "text after the last entry", "deep": "deeper than 8"}
    assert not [r for r in found if r.file in ("blank", "none")]
    frame = spark.createDataFrame(list(texts.items()), "file string, text string")
    assert sorted(tuple(r) for r in dictionary.patch_types(dictionary.entries(frame, ["file"]), ["file"]).collect()) == [("boundary", '"side.*"', "patch"), ("boundary", "ground", "wall")]


def test_manifests_and_vocabularies(spark, tmp_path):
    (tmp_path / "a.dict").write_text("source one; solid_mask { field mask; solid_value 1; } stress_order foam; pressure { convention static; rho 1.2; p_ref 0; }\ninflow_dir (1 0 0); L_ref { rule x-extent; } origin { point (0 0 1); } ground_z none; licence CC; verified_run 3;")
    (tmp_path / "b.dict").write_text("source two; solid_mask none; stress_order VERIFY; pressure { convention kinematic; } inflow_dir [1 0 0]; L_ref { value 2.5; } origin { rule bbox-centre-ground; } ground_z 0.5;")
    m = dictionary.manifests(dictionary.read(spark, f"file://{tmp_path}", "*.dict"), ["file"])
    a, b = sorted(m.collect(), key=lambda r: r.source)
    assert (a.solid_field, a.solid_value, a.pressure, a.rho, a.p_ref, list(a.inflow_dir), a.l_ref_rule, list(a.origin_point), a.ground) == ("mask", "1", "static", 1.2, 0.0, [1.0, 0.0, 0.0], "x-extent", [0.0, 0.0, 1.0], "none")
    assert (b.solid_field, b.l_ref_value, b.origin_rule, list(b.inflow_dir)) == ("none", 2.5, "bbox-centre-ground", [1.0, 0.0, 0.0])
    assert {r.source: list(r.problems) for r in checks.manifest_problems(m).collect()} == {"one": [], "two": ["stress_order: missing"]}
    rows = spark.createDataFrame([(1, "none", "x"), (2, "moving", None)], "id int, ground string, closure string")
    told = dictionary.vocabulary_problems(rows, ["id"], {"ground": ("none", "moving"), "closure": ("les", "y")}).collect()
    assert sorted(tuple(r) for r in told) == [(1, "closure", "x"), (2, "closure", None)]


# --- monitors and fingerprints --------------------------------------------------------------------------------------------
def test_monitors_of_three_restarts(spark, tmp_path):
    made = {"0": range(1, 81), "79": range(80, 121), "1e2": range(101, 151), "old": range(1, 500)}
    for start, its in made.items():
        d = tmp_path / "arm" / "postProcessing" / "forces" / start
        d.mkdir(parents=True)
        (d / "forces.dat").write_text("# Time\n" + "".join(f"{i} {float(start) if start != 'old' else -1}\n" for i in its))
        (d / "other.dat").write_text("1 1\n")
    lines = text.read_lines(spark, f"file://{tmp_path}", "forces.dat")
    found = text.monitor_files(lines.select("path"), "forces.dat")
    assert [(r.nth, r.start, r.next_start) for r in found.orderBy("nth").collect()] == [(1, 0.0, 79.0), (2, 79.0, 100.0), (3, 100.0, None)]
    v = F.split("line", " ")
    records = lines.where("line <> '' and line not like '#%'").select("path", F.col("line_no").alias("line"), v[0].cast("double").alias("it"), v[1].cast("double").alias("value"))
    got = {r.it: (r.value, r.start) for r in text.resolved(found, records).collect()}
    assert got == {float(i): ((0.0, 0.0) if i < 80 else (79.0, 79.0) if i < 101 else (100.0, 100.0)) for i in range(1, 151)}


def test_fingerprints_do_not_depend_on_partitions_and_see_a_change(spark):
    rows = [(i, f"s{i % 3}", "train", f"/p/{i}") for i in range(500)]
    d = spark.createDataFrame(rows, "case_id long, source string, split string, shard string")
    one = pool.fingerprint_tree(d).first()
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        assert pool.fingerprint_tree(d.orderBy(F.rand(1)).repartition(9)).first() == one and one.n == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    changed = d.withColumn("shard", F.when(F.col("case_id") == 77, "/q/77").otherwise(F.col("shard")))
    assert len({one.fingerprint, pool.fingerprint_tree(changed).first().fingerprint, pool.fingerprint_tree(d.where("case_id <> 3")).first().fingerprint}) == 3
