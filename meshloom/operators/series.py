"""Residual and monitor series: alignment, forward windows, convergence and what a run is worth."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import finite


def latest_wins(rows: DataFrame) -> DataFrame:
    """run_id, it, value: of restarted runs the file that starts later wins for an iteration, then the later line.
    rows: run_id, start, line, it, value."""
    return rows.groupBy("run_id", F.round("it", 9).alias("it")).agg(F.max_by("value", F.struct("start", "line")).alias("value"))


def convergence(series: DataFrame, residuals: list[str], quantities: list[str], tol: float, window: int, rel: float) -> DataFrame:
    """run_id, status, iteration: the first aligned iteration at which all residuals are at most tol and every
    quantity stays within rel of its value for the next `window` iterations, all of them there without a gap.

    Status: invalid for a missing or repeated series entry, a value that is not finite, no common iteration, or a
    gap behind a candidate when none succeeds; else converged or not_converged. The iteration is counted from the first
    one that the first residual has, in its median steps.
    """
    names = [*residuals, *quantities]
    own = [F.when(F.col("name") == n, F.col("value")) for n in names]
    # One shuffle by run; the grouping and all windows below keep its partitioning.
    d = series.select("run_id", "name", F.round("it", 9).alias("it"), "value").repartition("run_id").groupBy("run_id", "it").agg(
        F.bool_and(F.when(F.col("name").isin(names), finite(F.col("value")))).alias("ok"),
        *[F.count_if(F.col("name") == n).alias(f"c_{i}") for i, n in enumerate(names)], *[F.max(x).alias(f"v_{i}") for i, x in enumerate(own)])
    here = reduce(lambda a, b: a & b, [F.col(f"c_{i}") > 0 for i in range(len(names))])
    d = d.withColumns({"here": here, "led": F.col("c_0") > 0})
    lead = Window.partitionBy("run_id", "led").orderBy("it")
    d = d.withColumn("d", F.when(F.col("led"), F.lead("it").over(lead) - F.col("it")))
    run = Window.partitionBy("run_id")
    d = d.withColumns({"step": F.coalesce(F.percentile("d", 0.5).over(run), F.lit(1.0)), "start": F.min(F.when(F.col("led"), F.col("it"))).over(run)})
    order = Window.partitionBy("run_id", "here").orderBy("it")
    ahead = order.rowsBetween(Window.currentRow, window)
    small = reduce(lambda a, b: a & b, [F.col(f"v_{i}") <= tol for i in range(len(residuals))])
    still = reduce(lambda a, b: a & b, [F.greatest(F.max(f"v_{i}").over(ahead) - F.col(f"v_{i}"), F.col(f"v_{i}") - F.min(f"v_{i}").over(ahead)) <= rel * F.greatest(F.abs(F.col(f"v_{i}")), F.lit(1e-30)) for i in range(len(residuals), len(names))], F.lit(True))
    d = d.withColumns({"span": F.lead("it", window).over(order) - F.col("it") if window else F.lit(0.0), "still": still})
    even = F.abs(F.col("span") - window * F.col("step")) <= 1e-8 + 1e-5 * F.abs(window * F.col("step")) if window else F.lit(True)
    candidate = F.col("here") & small & F.col("span").isNotNull()
    bad = reduce(lambda a, b: a | b, [F.max(f"c_{i}") > 1 for i in range(len(names))] + [F.sum(f"c_{i}") == 0 for i in range(len(names))], F.bool_or(~F.col("ok")))
    out = d.groupBy("run_id").agg(
        F.coalesce(bad, F.lit(True)).alias("bad"), F.bool_or("here").alias("aligned"), F.first("step").alias("step"), F.first("start").alias("start"),
        F.min(F.when(candidate & even & F.col("still"), F.col("it"))).alias("hit"), F.bool_or(candidate & ~even).alias("blocked"))
    invalid = F.col("bad") | ~F.col("aligned") | (F.col("hit").isNull() & F.col("blocked"))
    status = F.when(invalid, "invalid").when(F.col("hit").isNotNull(), "converged").otherwise("not_converged")
    number = F.bround((F.col("hit") - F.col("start")) / F.col("step"), 0).cast("long") + 1
    return out.select("run_id", status.alias("status"), F.when(status == "converged", number).alias("iteration"))


def arm_status(failed: Column, diverged: Column, evidence: Column) -> Column:
    """failed before diverged before what the evidence says."""
    return F.when(failed, "failed").when(diverged, "diverged").otherwise(evidence)


def score_arms(lines: DataFrame, forces: DataFrame, probes: DataFrame, codes: DataFrame, direction: tuple[float, float, float], fields: list[str], quantities: list[str], tol: float, window: int, rel: float) -> DataFrame:
    """One row per run of codes (run_id, returncode): status (failed, diverged, invalid, converged, not_converged), admissible
    (the last two), iterations run and until the criterion, iterations until the residuals alone, execution_time, and the
    quantities that have no record.

    lines: run_id, line_no, line of the logs; forces and probes as operators.logs makes them, with `start`: of restarted
    runs the later file counts. The quantities are drag (force along `direction`) and pedestrian_speed (mean over the
    probes). A malformed record makes a run's evidence invalid.
    """
    from . import logs

    found = logs.residuals(lines)
    told = logs.summary(lines).join(logs.diverged(found), "run_id", "left")
    drag = sum((F.col(f"f{c}") * d for c, d in zip("xyz", direction)), F.lit(0.0))
    speed = F.aggregate("speeds", F.lit(0.0), lambda a, x: a + x) / F.size("speeds")
    one = lambda t, name, value: latest_wins(t.where("not malformed").select("run_id", "start", F.col("line_no").alias("line"), "it", value.alias("value"))).withColumn("name", F.lit(name))
    monitors = one(forces, "drag", drag).unionByName(one(probes, "pedestrian_speed", speed))
    series = found.select("run_id", "it", F.col("residual").alias("value"), F.col("field").alias("name")).unionByName(monitors)
    criterion = convergence(series, fields, quantities, tol, window, rel).withColumnRenamed("status", "evidence")
    alone = convergence(series, fields, [], tol, 0, 1.0).select("run_id", F.col("iteration").alias("iterations_to_residuals"))
    broken = forces.select("run_id", "malformed").unionByName(probes.select("run_id", "malformed")).groupBy("run_id").agg(F.bool_or("malformed").alias("broken"))
    there = monitors.groupBy("run_id").agg(F.collect_set("name").alias("there"))
    runs = codes.select("run_id", "returncode")
    for t in (told, criterion, alone, broken, there):
        runs = runs.join(t, "run_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    evidence = F.when(no(F.col("broken")), "invalid").otherwise(F.coalesce("evidence", F.lit("invalid")))
    status = arm_status(F.coalesce(F.col("returncode") != 0, F.lit(False)), no(F.col("crashed")) | no(F.col("diverged")), evidence)
    return runs.select(
        "run_id", status.alias("status"), status.isin("converged", "not_converged").alias("admissible"), F.coalesce("iterations", F.lit(0)).alias("iterations_run"),
        F.when(status == "converged", F.col("iteration")).alias("iterations_to_criterion"), "iterations_to_residuals", F.coalesce("execution_time", F.lit(float("nan"))).alias("execution_time"),
        F.array_except(F.lit(list(quantities)).cast("array<string>"), F.coalesce("there", F.array().cast("array<string>"))).alias("missing_monitors"))


def safety(series: DataFrame, settle: int, blowup: float, probe: int, ratio: float, accept_below: float) -> DataFrame:
    """run_id, accepted, reason, from a run's residuals in order: rejected when there are fewer than two, one is not
    finite, or one after `settle` reaches blowup; else accepted if the residual at `probe` is small enough."""
    a = series.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("it", "value"))), lambda x: x["value"]).alias("r"))
    tail = F.filter("r", lambda x, i: i >= settle)
    at = F.element_at("r", F.least(F.lit(probe), F.size("r")))
    reason = (F.when(F.size("r") < 2, "too_short").when(F.exists("r", lambda x: ~finite(x)), "not_finite")
              .when(F.exists(tail, lambda x: x >= blowup), "blowup").when((at <= ratio * F.col("r")[0]) | (at <= accept_below), "accepted").otherwise("no_progress"))
    return a.select("run_id", (reason == "accepted").alias("accepted"), reason.alias("reason"))


def safety_all(series: DataFrame, field: str, diverged: DataFrame, settle: int, blowup: float, probe: int, ratio: float, accept_below: float, reference: DataFrame | None = None) -> DataFrame:
    """run_id, accepted, reason, from the residuals of all fields (run_id, name, it, value): rejected when the run diverged,
    when `field` has fewer than two, or when any field has one that is not finite or one after its first `settle` that
    reaches blowup. Else the field's residual at `probe` decides: against the run's reference residual (run_id,
    reference) where there is one, else against the field's first and against accept_below."""
    a = series.groupBy("run_id", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("it", "value"))), lambda x: x["value"]).alias("r"))
    bad = F.exists("r", lambda x: ~finite(x)) | F.exists(F.filter("r", lambda x, i: i >= settle), lambda x: x >= blowup)
    runs = a.groupBy("run_id").agg(F.bool_or(bad).alias("bad"), F.max(F.when(F.col("name") == field, F.col("r"))).alias("r"))
    runs = runs.join(diverged.select("run_id", "diverged"), "run_id", "left")
    runs = runs.join(reference.select("run_id", "reference"), "run_id", "left") if reference is not None else runs.withColumn("reference", F.lit(None).cast("double"))
    at = F.element_at("r", F.least(F.lit(probe), F.size("r")))
    good = F.when(F.col("reference").isNotNull(), at <= F.col("reference")).otherwise((at <= ratio * F.col("r")[0]) | (at <= accept_below))
    reason = (F.when(F.coalesce("diverged", F.lit(False)), "diverged").when(F.col("r").isNull() | (F.size("r") < 2), "too_short").when(F.col("bad"), "blowup").when(good, "accepted").otherwise("no_progress"))
    return runs.select("run_id", (reason == "accepted").alias("accepted"), reason.alias("reason"))
