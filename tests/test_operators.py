"""Contracts of the operators on hand-made inputs."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshloom.functions import fields
from meshloom.operators import logs, mesh, metrics, pool, retrieval, sampling, series, spatial, tokens


def cube(spark, n=300, cases=2, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(cases):
        p = rng.uniform([-4, -3, 0], [8, 3, 3], (n, 3))
        d = np.minimum(np.abs(p).max(1), p[:, 2])
        out.append(pd.DataFrame({"case_id": c, "point_id": np.arange(n), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "wall_dist": d, "nx": 0.0, "ny": 0.0, "nz": 1.0, "ux": np.tanh(p[:, 2]), "uy": 0.1 * np.sin(p[:, 1]), "uz": 0.05 * np.cos(p[:, 0]), "cp": 0.5, "k": 0.01 * np.exp(-d), "eps": 0.02 * np.exp(-d), "cell_size": 0.05}))
    f = pd.concat(out)
    for c in ("ux", "uy", "uz", "cp", "k", "eps"):
        f[f"p_{c}"] = 0.9 * f[c]
    return spark.createDataFrame(f)


def brute_knn(p, q, k):
    out = {}
    for c, g in p.groupby("case_id"):
        r = q[q.case_id == c]
        x = r[["x", "y", "z"]].to_numpy()
        for row in g.itertuples():
            d = ((x - [row.x, row.y, row.z]) ** 2).sum(1)
            out[c, row.point_id] = [int(r.ref_id.to_numpy()[i]) for i in np.lexsort((r.ref_id.to_numpy(), d))[:k]]
    return out


@pytest.mark.parametrize("direct", [10**9, 20])
def test_knn_by_grid_and_directly(spark, monkeypatch, direct):
    monkeypatch.setattr(spatial, "DIRECT", direct)
    p = cube(spark, 120)
    got = {}
    for r in spatial.knn(p.where("point_id % 3 = 0"), p.withColumnRenamed("point_id", "ref_id"), 4).orderBy("rank").collect():
        got.setdefault((r.case_id, r.point_id), []).append(r.ref_id)
    f = p.toPandas()
    assert got == brute_knn(f[f.point_id % 3 == 0], f.rename(columns={"point_id": "ref_id"}), 4)


def test_knn_with_fewer_references_than_k_and_duplicates(spark):
    left = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0)], "case_id int, point_id long, x double, y double, z double")
    right = spark.createDataFrame([(1, 5, 1.0, 0.0, 0.0), (1, 4, 1.0, 0.0, 0.0), (2, 9, 0.0, 0.0, 0.0)], "case_id int, ref_id long, x double, y double, z double")
    assert [(r.rank, r.ref_id) for r in spatial.knn(left, right, 4).orderBy("rank").collect()] == [(1, 4), (2, 5)]


def test_farthest_points_of_every_case(spark):
    got = tokens.farthest_points(cube(spark, 60), 12, tokens.wall_weight(0.5)).orderBy("case_id", "step").collect()
    assert [r.point_id for r in got if r.case_id == 0][:1] == [0] and len(got) == 24
    assert len({(r.case_id, r.point_id) for r in got}) == 24
    for case, rows in cube(spark, 60).toPandas().sort_values("point_id").groupby("case_id"):
        x, w = rows[["x", "y", "z"]].to_numpy(), (1 / (1 + rows.wall_dist.clip(lower=0) / 0.5)).to_numpy() ** 2
        want = [0]
        while len(want) < 12:  # step by step from the definition
            d = ((x[:, None] - x[want][None]) ** 2).sum(2).min(1) * w
            want.append(max((i for i in range(len(x)) if i not in want), key=lambda i: (d[i], -i)))
        assert [r.point_id for r in got if r.case_id == case] == rows.point_id.to_numpy()[want].tolist()


def test_farthest_points_of_small_cases(spark):
    got = tokens.farthest_points(cube(spark, 3, 1), 10).collect()
    assert sorted(r.point_id for r in got) == [0, 1, 2]


def line(run, name, it, value):
    return (run, name, float(it), float(value))


def test_convergence_statuses(spark):
    rows = []
    for i in range(1, 31):
        for run in (1, 2, 3, 4, 5):
            rows.append(line(run, "p", i, 10.0 ** (-i / 5)))
            v = 1 + 0.5 * math.exp(-i / 3)
            if run == 2 and i == 20:
                v = float("nan")
            if run == 3:
                continue
            if run == 4 and i % 7 == 0:
                continue
            rows.append(line(run, "drag", i if run != 5 else i + 1000, v))
    s = spark.createDataFrame(rows, "run_id int, name string, it double, value double")
    got = {r.run_id: (r.status, r.iteration) for r in series.convergence(s, ["p"], ["drag"], 1e-3, 8, 0.01).collect()}
    first = next(i for i in range(15, 23) if 0.5 * (math.exp(-i / 3) - math.exp(-(i + 8) / 3)) <= 0.01 * (1 + 0.5 * math.exp(-i / 3)))
    assert got[1] == ("converged", first)
    assert got[2][0] == got[3][0] == got[4][0] == got[5][0] == "invalid"
    assert {r.run_id: r.status for r in series.convergence(s.where("run_id = 1"), ["p"], ["drag"], 1e-9, 8, 0.01).collect()} == {1: "not_converged"}


def test_latest_file_wins(spark):
    rows = [(1, 0.0, 1, 1.0, 10.0), (1, 79.0, 1, 1.0, 20.0), (1, 0.0, 2, 2.0, 5.0), (1, 0.0, 3, 2.0, 6.0)]
    s = spark.createDataFrame(rows, "run_id int, start double, line int, it double, value double")
    assert {r.it: r.value for r in series.latest_wins(s).collect()} == {1.0: 20.0, 2.0: 6.0}


def test_safety_reasons(spark):
    runs = {1: [1.0], 2: [1.0, float("nan")], 3: [1.0, 0.5, 900.0], 4: [1.0, 0.9, 0.2], 5: [1.0, 0.99, 0.98]}
    s = spark.createDataFrame([(r, i, v) for r, vs in runs.items() for i, v in enumerate(vs)], "run_id int, it int, value double")
    got = {r.run_id: r.reason for r in series.safety(s, 1, 100.0, 3, 0.5, 1e-4).collect()}
    assert got == {1: "too_short", 2: "not_finite", 3: "blowup", 4: "accepted", 5: "no_progress"}


def test_log_of_a_solver(spark):
    text = ["smoothSolver:  Solving for Ux, Initial residual = 9, x", "Time = 1", "smoothSolver:  Solving for Ux, Initial residual = 0.5, Final", "GAMG:  Solving for Ux, Initial residual = 0.4, Final",
            "smoothSolver:  Solving for p, Initial residual = bad, Final", "ExecutionTime = 2.0 s", "Time = 2", "smoothSolver:  Solving for Ux, Initial residual = 2e4, Final", "ExecutionTime = 4.5 s", "SIMPLE solution converged in 2 iterations"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "run_id int, line_no int, line string")
    res = logs.residuals(lines)
    got = {(r.field, r.step): r.residual for r in res.collect()}
    assert got[("Ux", 1)] == 0.5 and got[("Ux", 2)] == 2e4 and math.isnan(got[("p", 1)]) and len(got) == 3
    s = logs.summary(lines).first()
    assert (s.converged, s.execution_time, s.crashed) == (True, 4.5, False)
    assert logs.diverged(res.where("field = 'Ux'")).first().diverged and logs.diverged(res.where("field = 'p'")).first().diverged


def test_numbers_of_monitors(spark):
    d = spark.createDataFrame([(1, 1, "# it"), (1, 2, "  "), (1, 3, "1 (2 nan -3e1) (1 1 1)"), (1, 4, "2 (x 1 1)"), (1, 5, "3 1")], "run_id int, line_no int, line string")
    got = {r.line_no: (r.malformed, r.it, r.fx) for r in logs.forces(logs.numbers(d)).collect()}
    assert set(got) == {3, 4, 5} and got[3] == (False, 1.0, 2.0) and got[4][0] and got[5][0]


def test_metrics_of_equal_scaled_and_absent_fields(spark):
    p = cube(spark, 50, 1)
    got = metrics.rel_l2_by_group(p, ["case_id"], presence={"k": F.lit(False)}).first()
    assert abs(got.rel_l2_u - 0.1) < 1e-9 and got.rel_l2_k is None
    far = metrics.near_wall_ratio(p.where("wall_dist > 5"), ["case_id"]).collect()
    assert far == []
    assert math.isnan(metrics.near_wall_ratio(p.withColumn("wall_dist", F.lit(0.5)), ["case_id"]).first().ratio)


def test_absent_groups_do_not_leak_nan(spark):
    d = spark.createDataFrame([(float("nan"), False), (2.0, True)], "x double, present boolean")
    assert [r.v for r in d.select(fields.masked(F.col("present"), fields.encode(F.col("x"))).alias("v")).collect()][0] == 0.0


def test_rotation_keeps_what_it_should(spark):
    p = cube(spark, 40, 1)
    back = fields.rotate_z(fields.rotate_z(p, 0.3), -0.3)
    a, b = p.orderBy("point_id").toPandas(), back.orderBy("point_id").toPandas()
    assert np.allclose(a[["x", "y", "z", "ux", "uy", "cp"]], b[["x", "y", "z", "ux", "uy", "cp"]])
    assert np.allclose(a, fields.mirror_y(fields.mirror_y(p)).orderBy("point_id").toPandas()[a.columns])


def test_stratified_quotas_and_whole_small_cases(spark):
    p = cube(spark, 1000, 1)
    got = sampling.stratified(p, ["case_id"], 200, 1, F.col("x")).toPandas()
    assert not got.duplicated(["case_id", "point_id"]).any()
    n = got.groupby("stratum").size().to_dict()
    near = p.where("wall_dist < 0.25").count()
    assert n[1] == min(100, near) and n[0] == 40 and n.get(2, 0) <= 60
    assert sampling.stratified(p, ["case_id"], 5000, 1, F.col("x")).count() == 1000


def test_epochs_are_permutations_and_resume(spark):
    pool_ = spark.range(500).select(F.col("id").alias("case_id"), F.when(F.col("id") < 100, "a").otherwise("b").alias("g"))
    whole = [r.case_id for r in sampling.epoch_order(pool_, 1, 0).orderBy("pos").collect()]
    assert sorted(whole) == list(range(500)) and whole != list(range(500))
    assert [r.case_id for r in sampling.epoch_order(pool_, 1, 0, 123).orderBy("pos").collect()] == whole[123:]
    w = sampling.weighted_epoch(pool_, "g", {"a": 1.0, "b": 1.0}, 1, 0).toPandas()
    assert w.groupby("g").size().to_dict() == {"a": 250, "b": 250} and w[w.g == "a"].groupby("case_id").size().max() <= 3


def test_pool_fails_with_all_reasons(spark):
    rows = [("1", "a", "train", "s1", True, "f", None), ("1", "a", "val", "s2", True, "f", None), ("3", "b", "test", "s3", False, None, None), ("4", "b", "test", "s4", True, None, "broken")]
    m = spark.createDataFrame(rows, "case_id string, source string, split string, shard string, validated boolean, family string, error string")
    p = pool.union({"m": m})
    assert p.count() == 3
    with pytest.raises(pool.PoolError) as e:
        pool.require(p, spark.createDataFrame([("z",)], "source string"), spark.createDataFrame([("b",)], "source string"), ("a",))
    for rule in ("duplicate_case: 1", "family_in_splits: 1", "absent_source: 1", "held_out_source: 1", "not_validated: 1"):
        assert rule in str(e.value)
    good = p.where("case_id = '3'")
    assert pool.require(good, good.select("source").distinct(), spark.createDataFrame([], "source string"), ("b",)).count() == 1


def test_footprint_weights_and_ground(spark):
    f = spark.createDataFrame([(1, 2.0, 2.0, 1.0, 1.0, 1.0, False), (1, 3.0, 3.0, 1.0, 1.0, 1.0, False), (1, 9.0, 9.0, 0.0, 1.0, 50.0, True)], "case_id int, cx double, cy double, cz double, nz double, area double, is_ground boolean")
    r = mesh.footprint(f, ["case_id"]).first()
    assert (r.x, r.y, r.height) == (2.5, 2.5, 1.0)


def test_shared_points_without_a_match(spark):
    p = cube(spark, 20, 1)
    far = p.withColumn("x", F.col("x") + 100).withColumnRenamed("point_id", "ref_id")
    r = spatial.compare_shared(p, far, ["case_id"], ["ux"], 1.0, 1e-6).first()
    assert (r.status, r.n_matched, r.rel_l2) == ("insufficient_matches", 0, None)


def test_ridge_finds_a_linear_law_and_no_noise(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    good = pd.DataFrame(x, columns=list("abc")).assign(g=0, y=x @ [1.0, -2.0, 0.5] + 0.05 * rng.normal(size=60))
    noise = pd.DataFrame(rng.normal(size=(60, 3)), columns=list("abc")).assign(g=1, y=rng.normal(size=60))
    got = {r.g: r.r2 for r in retrieval.ridge_loo(spark.createDataFrame(pd.concat([good, noise])), ["g"], list("abc"), "y", (1e-3, 1.0, 1e3)).collect()}
    assert got[0] > 0.95 and got[1] < 0.2


# --- hand-worked cases of what the operators are defined by ------------------------------------------------------
BANNER = "sigFpe : Floating point exception trapping - not supported on this platform"


def test_crash_signs_and_the_banner_that_is_none(spark):
    logs_of = {1: [BANNER, "Time = 1"], 2: [BANNER, "Floating point exception (core dumped)"], 3: ["#0  Foam::error::printStack(Foam::Ostream&) at ??:?"], 4: ["--> FOAM FATAL ERROR:"], 5: ["  nan"], 6: ["nanobot", "x nan"], 7: ["segmentation fault"]}
    lines = spark.createDataFrame([(r, i, t) for r, ts in logs_of.items() for i, t in enumerate(ts)], "run_id int, line_no int, line string")
    got = {r.run_id: r for r in logs.summary(lines).collect()}
    assert {k for k, r in got.items() if r.crashed} == {2, 3, 4, 5}
    assert got[1].iterations == 1 and math.isnan(got[1].execution_time)


def test_residuals_keep_the_time_that_aligns_restarts(spark):
    text = ["Time = 250", "Solving for p, Initial residual = 0.1, Final", "Time = abc", "Solving for p, Initial residual = 0.2, Final", "Time = 2.5e2s", "Solving for p, Initial residual = nan, Final"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "run_id int, line_no int, line string")
    assert [(r.step, r.it) for r in logs.residuals(lines).orderBy("step").collect()] == [(1, 250.0), (2, 2.0), (3, 250.0)]


def test_iterations_count_from_the_first_residual(spark):
    """Residuals from 1, the monitor from 5, criterion met at 8: the eighth iteration."""
    rows = [line(1, "p", i, 1.0 if i < 8 else 1e-6) for i in range(1, 13)] + [line(1, "drag", i, 2.0) for i in range(5, 13)]
    rows += [line(2, "p", 10 * i, 1e-6) for i in range(3, 9)] + [line(2, "drag", 10 * i, 2.0) for i in range(4, 9)]
    s = spark.createDataFrame(rows, "run_id int, name string, it double, value double")
    assert {r.run_id: (r.status, r.iteration) for r in series.convergence(s, ["p"], ["drag"], 1e-3, 2, 0.01).collect()} == {1: ("converged", 8), 2: ("converged", 2)}


def test_channel_scales(spark):
    p = spark.createDataFrame([(3.0, 4.0, 12.0, 1.0, None, 0.0)] * 2, "ux double, uy double, uz double, cp double, k double, eps double")
    one = lambda **how: {r.channel: (r.mean, r.std) for r in metrics.channel_stats(p, **how).collect()}
    rms = math.sqrt(12.5)
    assert one()["ux"] == one()["uy"] == (0.0, pytest.approx(rms, abs=1e-12)) and one()["uz"] == (12.0, pytest.approx(1e-6)) and one()["k"] == (0.0, 1.0)
    assert one(common=True)["uz"] == (0.0, pytest.approx(rms, abs=1e-12))
    assert one(rotation_invariant=False, common=True)["uz"] == (0.0, pytest.approx(math.sqrt(169 / 3)))
    bad = p.withColumn("cp", F.lit(float("nan")))
    with pytest.raises(Exception, match="not finite and positive"):
        metrics.channel_stats(bad).collect()


def test_footprint_heights_are_above_the_ground(spark):
    face = "case_id int, cx double, cy double, cz double, nz double, area double, is_ground boolean"
    f = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 1.0, 1.0, False), (1, 2.0, 0.0, 7.0, 1.0, 3.0, False), (2, 1.0, 1.0, 4.0, 1.0, 1.0, True)], face)
    got = {r.case_id: r for r in mesh.footprint(f, ["case_id"], spark.createDataFrame([(1, 2.0)], "case_id int, ground_z double")).collect()}
    assert (got[1].z, got[1].height) == (2.0, 4.5) and (got[2].z, got[2].height) == (4.0, 0.0)
    assert mesh.footprint(f.where("case_id = 1"), ["case_id"]).first().height == 1.5  # above the lowest face


def test_a_case_without_a_building_has_no_height_but_a_row(spark):
    v = spark.createDataFrame([(c, 0, 0, z, c == 1 or (c == 3 and z == 1)) for c in (1, 2, 3) for z in range(3)], "case_id int, ix int, iy int, iz int, fluid boolean")
    got = {r.case_id: (r.height, r.n_columns) for r in mesh.building_height(v, ["case_id"], 0.5).collect()}
    assert math.isnan(got[1][0]) and got[1][1] == 0 and got[2] == (1.5, 1) and got[3] == (0.5, 1)


def test_probes_of_other_widths_are_malformed(spark):
    text = ["# probes", "1 (3 4 0) (0 0 2)", "2 (3 4 0)", "3 (3 4 0) (0 0 x)", "4 (1 2 2) (nan 0 0)", "5 1 2"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "run_id int, line_no int, line string")
    got = {r.line_no: r for r in logs.probes(logs.numbers(lines)).collect()}
    assert [k for k, r in sorted(got.items()) if r.malformed] == [2, 3, 5] and got[1].speeds == [5.0, 2.0] and got[4].it == 4.0 and math.isnan(got[4].speeds[1])


def test_safety_over_all_fields(spark):
    rows = [line(r, n, i, v) for r, n, vs in [(1, "U", [1, 0.1]), (1, "p", [1, 1e6]), (2, "U", [1, 0.1]), (2, "p", [1, float("nan")]), (3, "U", [1, 0.4]), (4, "U", [1, 0.4]), (5, "p", [1, 1]), (6, "U", [1, 0.9]), (7, "U", [1, 0.1])] for i, v in enumerate(vs)]
    s = spark.createDataFrame(rows, "run_id int, name string, it double, value double")
    known, reference = spark.createDataFrame([(7, True), (1, False)], "run_id int, diverged boolean"), spark.createDataFrame([(4, 0.3)], "run_id int, reference double")
    got = {r.run_id: r.reason for r in series.safety_all(s, "U", known, 1, 100.0, 2, 0.5, 1e-4, reference).collect()}
    assert got == {1: "blowup", 2: "blowup", 3: "accepted", 4: "no_progress", 5: "too_short", 6: "no_progress", 7: "diverged"}


def test_arms_are_scored_from_logs_and_monitors(spark):
    """One run of each status, and a restart whose later file corrects the earlier one."""
    def log(n, residual):
        return [BANNER, *[t for i in range(1, n + 1) for t in (f"Time = {i}", f"Solving for p, Initial residual = {residual(i)}, Final", f"ExecutionTime = {i}.5 s")]]

    falling, flat = (lambda i: 10.0**-i), (lambda i: 0.5)
    logs_of = {1: log(9, falling), 2: log(9, falling), 3: log(9, flat), 4: log(9, falling) + ["--> FOAM FATAL ERROR"], 5: log(9, falling), 6: log(9, falling), 7: log(9, falling)}
    lines = spark.createDataFrame([(r, i, t) for r, ts in logs_of.items() for i, t in enumerate(ts)], "run_id int, line_no int, line string")
    force = [(r, 0.0, i, f"{i} (2 0 0) (1 1 1)") for r in (1, 2, 3, 4, 6, 7) for i in range(1, 10)] + [(6, 0.0, 99, "9 (x 0 0)")] + [(7, 5.0, i, f"{i} ({90 + i} 0 0)") for i in range(4, 7)]
    probe = [(r, 0.0, i, f"{i} (3 4 0) (0 0 5)") for r in (1, 2, 3, 4, 5, 6, 7) for i in range(1, 10)]
    read = lambda rows: logs.numbers(spark.createDataFrame(rows, "run_id int, start double, line_no int, line string"))
    codes = spark.createDataFrame([(1, 0), (2, 9), (3, None), (4, 0), (5, 0), (6, 0), (7, 0), (8, 0)], "run_id int, returncode int")
    got = {r.run_id: r for r in series.score_arms(lines, logs.forces(read(force)), logs.probes(read(probe)), codes, (1.0, 0.0, 0.0), ["p"], ["drag", "pedestrian_speed"], 1e-3, 2, 0.01).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "converged", 2: "failed", 3: "not_converged", 4: "diverged", 5: "invalid", 6: "invalid", 7: "converged", 8: "invalid"}
    assert (got[1].iterations_to_criterion, got[1].iterations_to_residuals, got[1].iterations_run, got[1].execution_time) == (3, 3, 9, 9.5)
    # Of run 7 the drag of 4 to 6 is that of the later file, so it settles at the seventh iteration.
    assert got[7].iterations_to_criterion == 7 and got[5].missing_monitors == ["drag"] and got[8].missing_monitors == ["drag", "pedestrian_speed"]
    assert [k for k, r in got.items() if r.admissible] == [1, 3, 7] and got[2].iterations_to_criterion is None


def test_errors_of_methods_that_are_given(spark):
    p = spark.createDataFrame([(1, 1.0, *[float(i) for i in range(1, 7)], *[0.0] * 6)], "case_id int, wall_dist double, ux double, uy double, uz double, cp double, k double, eps double, p_ux double, p_uy double, p_uz double, p_cp double, p_k double, p_eps double")
    exact = {c: F.col(c) for c in ("ux", "uy", "uz", "cp", "k", "eps")}
    got = {r.method: r.rel_l2_u for r in metrics.by_method(p, ["case_id"], {"exact": exact, "none": {c: F.lit(0) for c in exact}}).collect()}
    assert got == {"exact": 0.0, "none": pytest.approx(1.0)}
