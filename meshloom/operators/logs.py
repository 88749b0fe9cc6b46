"""Solver logs and monitor files as text tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The signs of a crash in a solver's log, and how it writes times and residuals. The start-up banner
# "sigFpe : Floating point exception trapping - not supported" is no crash.
CRASH = r"(?i)(Floating point exception \(core dumped\)|^#\d+\s+Foam::error::printStack|--> FOAM FATAL|^\s*nan\b)"
TIME = r"^Time = ([-+]?[0-9.]+(?:[eE][-+]?\d+)?)"
RESIDUAL = r"(?i)Solving for (\w+), Initial residual = ([^,\s]+)"


def _number(text: str) -> Column:
    """The text's number; NaN where it cannot be read."""
    return F.coalesce(F.expr(f"try_cast({text} as double)"), F.lit(float("nan")))


def residuals(lines: DataFrame) -> DataFrame:
    """run_id, field, step, it, residual: the first initial residual of each field within a time step, and the number after
    the step's `Time =` (or the step, if that is no number), by which restarted logs are aligned with monitors. Lines before
    the first `Time =` are left out; a number that cannot be read is NaN. lines: run_id, line_no, line."""
    order = Window.partitionBy("run_id").orderBy("line_no")
    time, found = F.startswith("line", F.lit("Time = ")), F.regexp_extract("line", RESIDUAL, 1)
    # Only lines of times and residuals go through the shuffle.
    d = lines.withColumns({"field": found, "raw": F.regexp_extract("line", RESIDUAL, 2), "time": F.when(time, F.regexp_extract("line", TIME, 1))}).where(F.col("time").isNotNull() | (F.col("field") != ""))
    d = d.select("run_id", "line_no", "field", "raw", "time").withColumns({"step": F.count("time").over(order), "time": F.last("time", True).over(order)})
    d = d.where((F.col("step") > 0) & (F.col("field") != ""))
    first = d.groupBy("run_id", "field", "step").agg(F.min_by(F.struct("raw", "time"), "line_no").alias("r")).select("run_id", "field", "step", "r.*")
    return first.select("run_id", "field", "step", F.coalesce(F.expr("try_cast(time as double)"), F.col("step").cast("double")).alias("it"), _number("raw").alias("residual"))


def summary(lines: DataFrame) -> DataFrame:
    """run_id, iterations, converged, execution_time (the last; NaN if there is none), crashed."""
    d = lines.withColumn("raw", F.regexp_extract("line", r"ExecutionTime = ([0-9.]+) s", 1))
    return d.groupBy("run_id").agg(
        F.count_if(F.startswith("line", F.lit("Time = "))).alias("iterations"), F.bool_or(F.col("line").contains("solution converged")).alias("converged"),
        F.max_by("raw", F.when(F.col("raw") != "", F.col("line_no"))).alias("raw"), F.bool_or(F.col("line").rlike(CRASH)).alias("crashed"),
    ).select("run_id", "iterations", "converged", _number("raw").alias("execution_time"), "crashed")


def diverged(res: DataFrame, last: int = 5, most: float = 1e3) -> DataFrame:
    """run_id, diverged: a residual that is not finite, or one of a field's last five above the limit."""
    w = Window.partitionBy("run_id", "field").orderBy(F.desc("step"))
    d = res.withColumn("back", F.row_number().over(w))
    bad = F.isnan("residual") | (F.abs("residual") == float("inf"))
    return d.groupBy("run_id").agg(F.bool_or(bad | ((F.col("back") <= last) & (F.col("residual") > most))).alias("diverged"))


def numbers(lines: DataFrame, text: str = "line") -> DataFrame:
    """Adds `numbers` (array<double>) and `malformed`: parentheses count as blanks, nan and inf are numbers, any
    other token is not. Comment and blank lines go."""
    d = lines.where(~F.col(text).rlike(r"^\s*#|^\s*$"))
    tokens = F.filter(F.split(F.regexp_replace(text, r"[()]", " "), r"\s+"), lambda x: x != "")
    d = d.withColumn("tokens", tokens).withColumn("numbers", F.expr("transform(tokens, x -> try_cast(x as double))"))
    return d.withColumn("malformed", F.exists("numbers", lambda x: x.isNull())).drop("tokens")


def _start(parsed: DataFrame) -> list[str]:
    """The start time of the file that a line is of, where it is known."""
    return ["start"] if "start" in parsed.columns else []


def forces(parsed: DataFrame) -> DataFrame:
    """it, fx, fy, fz of monitor lines `it (fx fy fz) ...`; fewer than four numbers are malformed."""
    bad = F.col("malformed") | (F.size("numbers") < 4)
    return parsed.select("run_id", *_start(parsed), "line_no", bad.alias("malformed"), *[F.when(~bad, F.get("numbers", F.lit(i))).alias(n) for i, n in enumerate(("it", "fx", "fy", "fz"))])


def probes(parsed: DataFrame) -> DataFrame:
    """run_id, line_no, malformed, it, speeds: the lengths of the vectors of monitor lines `it (ux uy uz) (ux uy uz) ...`. A
    line is malformed if it holds anything but numbers, not a time and whole vectors, or another number of them than
    the first line of the run (and start) does."""
    n = F.size("numbers")
    bad = F.col("malformed") | (n < 4) | ((n - 1) % 3 != 0)
    width = F.first(n).over(Window.partitionBy("run_id", *_start(parsed)).orderBy("line_no"))
    d = parsed.withColumn("malformed", bad | (n != width))
    part = lambda k: F.get("numbers", k) * F.get("numbers", k)
    speeds = F.transform(F.sequence(F.lit(1), n - 3, F.lit(3)), lambda k: F.sqrt(part(k) + part(k + 1) + part(k + 2)))
    return d.select("run_id", *_start(parsed), "line_no", "malformed", *[F.when(~F.col("malformed"), x).alias(c) for c, x in (("it", F.get("numbers", F.lit(0))), ("speeds", speeds))])


def last_records(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key, by `order`."""
    others = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")
