"""Every query by name, over the canonical views of the test tables, with the SQL that checks it.

A query is the library's operator with fixed parameters; its SQL is written on its own for DuckDB. Doubles are
rounded to six places on both sides.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import fields
from .operators import attention, batches, checks, etl, logs, mesh, metrics, pool, retrieval, samples, sampling, series, spatial, tokens
from .plans import views
from .plans.shared import cut
from .plans.views import sql
from .streaming import series as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return add


def r(*pairs: str) -> str:
    """`name` or `expression as name` with the expression rounded."""
    out = []
    for p in pairs:
        e, _, n = p.rpartition(" as ")
        out.append(f"round({e or n}, 6) + 0.0 as {n}")
    return ", ".join(out)


def _case(x: str, *groups: str) -> str:
    """rel_l2 over channels in SQL."""
    err = " + ".join(f"({x}{c} - {c}) * ({x}{c} - {c})" for c in groups)
    return f"sqrt(sum({err})) / (sqrt(sum({' + '.join(f'{c} * {c}' for c in groups)})) + 1e-12)"


# --- series ------------------------------------------------------------------------------------------------------
RES, QUA = ["click", "view"], ["purchase", "signup"]


def _converge_sql(quantities: list[str], window: int, tol: float, rel: float, which: str = "true") -> str:
    names = RES + quantities
    pivot = ", ".join(f"max(value) filter (where name = '{n}') as v{i}" for i, n in enumerate(names))
    still = " and ".join([f"greatest(max(v{i}) over a - v{i}, v{i} - min(v{i}) over a) <= {rel} * greatest(abs(v{i}), 1e-30)" for i in range(2, len(names))]) or "true"
    span = f"lead(it, {window}) over o - it" if window else "0.0"
    inlist = ", ".join(f"'{n}'" for n in names)
    return sql(f""", s as (select run_id, name, it, value from series where name in ({inlist}) and ({which})),
  w as (select run_id, it, {pivot} from s group by all having count(distinct name) = {len(names)}),
  l as (select run_id, it, lead(it) over (partition by run_id order by it) - it as d from s where name = '{RES[0]}'),
  t as (select run_id, min(it) as start, coalesce(quantile_cont(d, 0.5), 1) as step from l group by run_id),
  f as (select *, {span} as span, (v0 <= {tol} and v1 <= {tol}) as small, ({still}) as still
    from w join t using (run_id) window o as (partition by run_id order by it), a as (partition by run_id order by it rows between current row and {window} following)),
  e as (select *, span is not null and small as candidate, abs(span - {window} * step) <= 1e-8 + 1e-5 * {window} * step as even from f),
  g as (select run_id, any_value(start) as start, any_value(step) as step, min(it) filter (where candidate and even and still) as hit, coalesce(bool_or(candidate and not even), false) as blocked from e group by run_id),
  n as (select run_id, count(distinct name) as k from s group by run_id),
  v as (select run_id, coalesce(k, 0) < {len(names)} or start is null or (hit is null and blocked) as invalid, hit, start, step from (select distinct run_id from series) r left join n using (run_id) left join g using (run_id))
select run_id, case when invalid then 'invalid' when hit is not null then 'converged' else 'not_converged' end as status,
  case when not invalid and hit is not null then cast(round_even((hit - start) / step, 0) as bigint) + 1 end as iteration from v""", "series")


@query("convergence_first_iteration", _converge_sql(QUA, 1, 60.0, 0.9))
def _(s, d):
    return series.convergence(views.series(s, d), RES, QUA, 60.0, 1, 0.9)


_LATE = "name in ('click', 'view') or (it >= 3 and it <> 6)"


@query("convergence_late_monitors", _converge_sql(QUA, 2, 120.0, 3.0, _LATE))
def _(s, d):
    """The monitors begin at the third iteration and miss one; the residuals do not."""
    x = views.series(s, d)
    out = series.convergence(x.where(_LATE), RES, QUA, 120.0, 2, 3.0)
    return x.select("run_id").distinct().join(out, "run_id", "left").select("run_id", F.coalesce("status", F.lit("invalid")).alias("status"), "iteration")


@query("residual_only_iteration", _converge_sql([], 0, 20.0, 0.0))
def _(s, d):
    return series.convergence(views.series(s, d), RES, [], 20.0, 0, 0.0)


_RESTART = ("select run_id, cast(floor(value) as double) / 7 as it, case name when 'click' then 0.0 when 'view' then 79.0 "
    "else 120.0 end as start, event_id as line, value from series")


@query("series_latest_wins", sql(f"select run_id, {r('it')}, {r('value')} from (select run_id, round(it, 9) as it, arg_max(value, "
    f"(start, line)) as value from ({_RESTART}) group by all)", "series"))
def _(s, d):
    return series.latest_wins(views.over(views.series(s, d), "series", _RESTART))


@query("arm_status", sql(""", a as (select run_id, run_id % 11 = 0 as failed, coalesce(max(value) filter (where name = 'error') > 250, false) as diverged from series group by run_id),
  c as (""" + _converge_sql(QUA, 1, 60.0, 0.9).replace("with " + views.SQL["series"] + " , ", "with ") + """)
select a.run_id, case when failed then 'failed' when diverged then 'diverged' else status end as status, not failed and not diverged and status in ('converged', 'not_converged') as admissible from a join c using (run_id)""", "series"))
def _(s, d):
    x = views.series(s, d)
    a = x.groupBy("run_id").agg((F.col("run_id") % 11 == 0).alias("failed"), F.coalesce(F.max(F.when(F.col("name") == "error", F.col("value"))) > 250, F.lit(False)).alias("diverged"))
    c = series.convergence(x, RES, QUA, 60.0, 1, 0.9)
    status = series.arm_status(F.col("failed"), F.col("diverged"), F.col("status"))
    return a.join(c, "run_id").select("run_id", status.alias("status"), status.isin("converged", "not_converged").alias("admissible"))


@query("safety_check", sql(""", a as (select run_id, list(value order by it) as r from series where name = 'click' group by run_id),
  b as (select *, r[least(10, len(r))] as p from a)
select run_id, reason = 'accepted' as accepted, reason from (select run_id, case when len(r) < 2 then 'too_short' when len(list_filter(r[6:], lambda x: x >= 200)) > 0 then 'blowup'
  when p <= 0.5 * r[1] or p <= 15 then 'accepted' else 'no_progress' end as reason from b)""", "series"))
def _(s, d):
    return series.safety(views.series(s, d).where("name = 'click'"), 5, 200.0, 10, 0.5, 15.0)


_SAFE = """, f as (select run_id, name, list(value order by it) as r from series group by all),
  b as (select run_id, bool_or(len(list_filter(r[4:], lambda x: x >= 380)) > 0) as bad, max(r) filter (where name = 'click') as r, run_id % 13 = 0 as diverged, case when run_id % 3 = 0 then 20.0 end as reference from f group by run_id),
  c as (select *, case when diverged then 'diverged' when r is null or len(r) < 2 then 'too_short' when bad then 'blowup'
    when case when reference is not null then r[least(10, len(r))] <= reference else r[least(10, len(r))] <= 0.5 * r[1] or r[least(10, len(r))] <= 15 end then 'accepted' else 'no_progress' end as reason from b)
select run_id, reason = 'accepted' as accepted, reason from c"""


@query("safety_all_fields", sql(_SAFE, "series"))
def _(s, d):
    x = views.series(s, d)
    runs = x.select("run_id").distinct()
    reference = runs.where("run_id % 3 = 0").withColumn("reference", F.lit(20.0))
    return series.safety_all(x, "click", runs.withColumn("diverged", F.col("run_id") % 13 == 0), 3, 380.0, 10, 0.5, 15.0, reference)


# --- logs --------------------------------------------------------------------------------------------------------
@query("log_parse_residuals", sql(r""", a as (select *, sum(case when line like 'Time = %' then 1 else 0 end) over o as step, last_value(case when line like 'Time = %' then line end ignore nulls) over o as time,
  regexp_extract(line, 'Solving for (\w+), Initial residual = ([^,\s]+)', 1) as field, regexp_extract(line, 'Solving for (\w+), Initial residual = ([^,\s]+)', 2) as raw from lines window o as (partition by run_id order by line_no))
select run_id, field, cast(step as bigint) as step, cast(substr(any_value(time), 8) as double) as it, round(cast(arg_min(raw, line_no) as double), 6) + 0.0 as residual from a where step > 0 and field <> '' group by run_id, field, step""", "lines"))
def _(s, d):
    return logs.residuals(views.log_lines(s, d))


# Logs that begin with the banner about floating point exceptions; some runs crash, by each of the four signs.
_LOG = """select run_id, line_no, line from {t}
union all select run_id, -1 as line_no, 'sigFpe : Floating point exception trapping - not supported on this platform' as line from (select distinct run_id from {t}) a
union all select run_id, line_no + 1000000000 as line_no, case run_id % 8 when 0 then 'Floating point exception (core dumped)' when 1 then '#0  Foam::error::printStack(Foam::Ostream&)' when 2 then '--> FOAM FATAL ERROR: (openfoam)'
  when 3 then '  nan residual' when 4 then 'SIMPLE solution converged in 12 iterations' when 5 then concat('ExecutionTime = ', cast(line_no as {s}), '.25 s  ClockTime = 3 s') when 6 then 'a banana' else 'End' end as line from {t} where line like 'Time = %'"""


@query("log_summary", sql(", l as (" + _LOG.format(t="lines", s="varchar") + r""") select run_id, count(*) filter (where line like 'Time = %') as iterations, bool_or(line like '%solution converged%') as converged,
  coalesce(arg_max(cast(nullif(regexp_extract(line, 'ExecutionTime = ([0-9.]+) s', 1), '') as double), case when line like 'ExecutionTime%' then line_no end), 'nan'::double) as execution_time,
  bool_or(line like '%Floating point exception (core dumped)%' or regexp_matches(line, '^#[0-9]+ +Foam::error::printStack') or line like '%--> FOAM FATAL%' or regexp_matches(line, '^ *nan([^a-z]|$)')) as crashed from l group by 1""", "lines"))
def _(s, d):
    return logs.summary(views.over(views.log_lines(s, d), "lines", _LOG.format(t="lines", s="string")))


_MONITOR = ("select run_id, event_id as line_no, case when event_id % 17 = 0 then concat('# comment ', "
    "cast(event_id as {s})) when event_id % 13 = 0 then concat(cast(it as {s}), ' (1.5 x 2)') when event_id % 19 = 0 then concat(cast(it as {s}), "
    "' 1') else concat(cast(cast(it as bigint) as {s}), ' (', cast(cast(round(value * 100) as bigint) as {s}), "
    "' -2 nan) (1 2 3)') end as line from {t}")


@query("monitor_numbers", sql(f""", m as ({_MONITOR.format(s='varchar', t='series')}), f as (select * from m where not regexp_matches(line, '^\\s*#')),
  p as (select run_id, line_no, list_transform(list_filter(string_split_regex(regexp_replace(line, '[()]', ' ', 'g'), '\\s+'), lambda x: x <> ''), lambda x: try_cast(x as double)) as v from f),
  b as (select *, len(list_filter(v, lambda x: x is null)) > 0 or len(v) < 4 as bad from p)
select run_id, line_no, bad as malformed, case when not bad then v[1] end as it, case when not bad then v[2] end as fx, case when not bad then v[3] end as fy from b""", "series"))
def _(s, d):
    return logs.forces(logs.numbers(views.over(views.series(s, d), "series", _MONITOR.format(s="string", t="series")))).drop("fz")


_PROBES = ("select run_id, event_id as line_no, case when event_id % 29 = 0 then concat(cast(it as {s}), "
    "' (1 2)') when event_id % 23 = 0 then concat(cast(it as {s}), ' (1 2 2) (3 4 x)') when event_id % 31 = 0 then concat(cast(it as {s}), "
    "' (1 2 2)') else concat(cast(cast(it as bigint) as {s}), ' (', cast(cast(round(value * 100) as bigint) as {s}), "
    "' -2 1) (3 4 0)') end as line from {t}")


@query("probe_monitors", sql(f""", m as ({_PROBES.format(s='varchar', t='series')}),
  p as (select run_id, line_no, list_transform(list_filter(string_split_regex(regexp_replace(line, '[()]', ' ', 'g'), '\\s+'), lambda x: x <> ''), lambda x: try_cast(x as double)) as v from m),
  b as (select *, len(list_filter(v, lambda x: x is null)) > 0 or len(v) < 4 or (len(v) - 1) % 3 <> 0 or len(v) <> first_value(len(v)) over (partition by run_id order by line_no) as bad from p)
select run_id, line_no, bad as malformed, case when not bad then v[1] end as it, case when not bad then round(sqrt(v[2] ** 2 + v[3] ** 2 + v[4] ** 2), 6) end as first_speed, case when not bad then len(v) // 3 end as n_probes from b""", "series"))
def _(s, d):
    p = logs.probes(logs.numbers(views.over(views.series(s, d), "series", _PROBES.format(s="string", t="series"))))
    return p.select("run_id", "line_no", "malformed", "it", F.get("speeds", F.lit(0)).alias("first_speed"), F.when(~F.col("malformed"), F.size("speeds").cast("long")).alias("n_probes"))


@query("log_last_record_per_step", """select user_id, event_type, arg_max(event_id, event_id) as event_id, round(arg_max(value, event_id), 6) + 0.0 as value from events group by all""")
def _(s, d):
    return logs.last_records(views.table(s, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


# --- metrics -----------------------------------------------------------------------------------------------------
_GROUP_SQL = ", ".join(r(f"{_case('p_', *c)} as rel_l2_{g}") for g, c in (("u", ("ux", "uy", "uz")), ("cp", ("cp",)), ("k", ("k",)), ("eps", ("eps",))))


@query("rel_l2_by_case", sql(f"select case_id, {_GROUP_SQL} from points group by case_id", "points"))
def _(s, d):
    return metrics.rel_l2_by_group(views.points(s, d), ["case_id"])


@query("rel_l2_weighted", sql(f"select case_id, {r('sqrt(sum(w * (pred - truth) * (pred - truth))) / (sqrt(sum(w * truth * truth)) + 1e-12) as rel_l2')} from wide group by case_id", "wide"))
def _(s, d):
    return views.wide(s, d).groupBy("case_id").agg(metrics.rel_l2([(F.col("pred"), F.col("truth"))], F.col("w")).alias("rel_l2"))


_E2 = "(p_ux - ux) * (p_ux - ux) + (p_uy - uy) * (p_uy - uy) + (p_uz - uz) * (p_uz - uz)"


@query("near_wall_ratio", sql(f"""select case_id, {r("coalesce(n, 'nan'::double) as near", "coalesce(f, 'nan'::double) as far", "case when f > 0 then coalesce(n / f, 'nan'::double) else 'nan'::double end as ratio")} from (select case_id, sqrt(avg({_E2}) filter (where wall_dist < 0.25)) as n, sqrt(avg({_E2}) filter (where wall_dist > 0.5)) as f from points group by case_id)""", "points"))
def _(s, d):
    return metrics.near_wall_ratio(views.points(s, d), ["case_id"], far=0.5)


_METHODS = ", m as (" + " union all ".join(f"select case_id, '{n}' as method, " + ", ".join(f"{e.format(c=c, u=1.0 if c == 'ux' else 0.0)} as m_{c}, {c}" for c in ("ux", "uy", "uz", "cp", "k", "eps")) + " from points" for n, e in (("prior-alone", "p_{c}"), ("uniform-inflow", "cast({u} as double)"), ("blend", "0.5 * (p_{c} + {u})"))) + ")"
@query("metrics_long_by_method", sql(f"{_METHODS} select case_id, method, " + ", ".join(r(f"{_case('m_', *c)} as rel_l2_{g}") for g, c in (("u", ("ux", "uy", "uz")), ("cp", ("cp",)), ("k", ("k",)), ("eps", ("eps",)))) + " from m group by case_id, method", "points"))
def _(s, d):
    return metrics.by_method(views.points(s, d), ["case_id"])


@query("metrics_nanmedian", sql(f"{_METHODS}, l as (select case_id, method, {_case('m_', 'ux', 'uy', 'uz')} as rel_l2_u, case "
    f"when case_id = 3 then 'nan'::double else {_case('m_', 'cp')} end as rel_l2_cp from m group by case_id, "
    f"method) select method, {r('quantile_cont(rel_l2_u, 0.5) as rel_l2_u', 'quantile_cont(rel_l2_cp, 0.5) filter (where not isnan(rel_l2_cp)) as rel_l2_cp')} "
    f"from l group by method", "points"))
def _(s, d):
    m = metrics.by_method(views.points(s, d), ["case_id"]).withColumn("rel_l2_cp", F.when(F.col("case_id") == 3, F.lit(float("nan"))).otherwise(F.col("rel_l2_cp")))
    return metrics.nan_median(m, ["method"], ["rel_l2_u", "rel_l2_cp"])


_ENC = {c: (f"ln(1 + greatest({c}, 0) / 0.001)" if c in ("k", "eps") else c) for c in ("ux", "uy", "uz", "cp", "k", "eps")}


def _stats_sql(scale: str, scaled: tuple[str, ...]) -> str:
    """The components in `scaled` have mean 0 and the given scale, the others their own moments."""
    own = {c: (f"avg({e})", f"stddev_pop({e}) + 1e-6") for c, e in _ENC.items()} | {c: ("0.0", scale) for c in scaled}
    return sql(" union all ".join(f"select '{c}' as channel, {r(f'{m} as mean', f'{v} as std')} from points" for c, (m, v) in own.items()), "points")


_HORIZONTAL = "sqrt(0.5 * (avg(ux * ux) + avg(uy * uy)))"


@query("channel_stats", _stats_sql(_HORIZONTAL, ("ux", "uy")))
def _(s, d):
    return metrics.channel_stats(views.points(s, d))


@query("channel_stats_common", _stats_sql(_HORIZONTAL, ("ux", "uy", "uz")))
def _(s, d):
    return metrics.channel_stats(views.points(s, d), common=True)


@query("channel_stats_common_scale", _stats_sql("sqrt((sum(ux * ux) + sum(uy * uy) + sum(uz * uz)) / (3 * count(*)))", ("ux", "uy", "uz")))
def _(s, d):
    return metrics.channel_stats(views.points(s, d), rotation_invariant=False, common=True)


@query("clipped_fraction", sql(f"select case_id, {r('count(*) filter (where uz - 0.1 < 0) / count(*) as clipped_k', 'count(*) filter (where cp < 0) / count(*) as clipped_eps')}, "
    f"cast(count(*) filter (where ux > 0.2) as bigint) as not_finite from points group by case_id", "points"))
def _(s, d):
    x = views.points(s, d).withColumns({"k": F.col("uz") - 0.1, "eps": F.col("cp")}).withColumn("ux", F.when(F.col("ux") > 0.2, F.lit(float("nan"))).otherwise(F.col("ux")))
    return metrics.clipped(x, ["case_id"]).withColumn("not_finite", F.col("not_finite").cast("long"))


@query("coverage_grouping_sets", sql(", d as (select source, tier, family % 4 as n_draws from pool) select case when grouping(source, "
    "tier) = 3 then 'all' when grouping(source, tier) = 1 then 'source' else 'tier' end as by, "
    "coalesce(source, tier, 'all') as name, count(*) as n, count(*) filter (where n_draws > 0) as drawn, "
    "cast(sum(n_draws) as bigint) as draws, round(count(*) filter (where n_draws > 0) / count(*), "
    "6) + 0.0 as share from d group by grouping sets ((), (source), (tier))", "pool"))
def _(s, d):
    return metrics.coverage(views.pool(s, d).withColumn("n_draws", F.col("family") % 4))


_W = {"ux": 1, "uy": 1, "uz": 1, "cp": 1, "k": 0.5, "eps": 0.5}


@query("masked_mse_loss", sql("select case_id, round(sum(" + " + ".join(f"{w} * (p_{c} - {c}) * (p_{c} - {c})" + (" * (case when point_id % 3 = 0 then 0 else 1 end)" if c == "k" else "") for c, w in _W.items()) + ") / greatest(sum(4.5 + case when point_id % 3 = 0 then 0 else 0.5 end), 1), 6) + 0.0 as loss from points group by case_id", "points"))
def _(s, d):
    return metrics.masked_loss(views.points(s, d), ["case_id"], presence={"k": F.col("point_id") % 3 != 0})


@query("case_targets", sql(f"""select case_id, {r("coalesce(avg(sqrt(ux * ux + uy * uy + uz * uz)) filter (where z > 0.05 and z < 0.3 and wall_dist >= 0.9 * z), 'nan'::double) as street_speed", "coalesce(avg(cp) filter (where wall_dist < 0.1), 'nan'::double) as wall_cp", "coalesce(avg(k), 'nan'::double) as mean_k")} from points group by case_id""", "points"))
def _(s, d):
    return metrics.case_targets(views.points(s, d), ["case_id"])


@query("geometry_features_case", sql(f"""select case_id, {r("avg(case when wall_dist < 0.1 then 1.0 else 0.0 end) as near_share", "coalesce(avg(z) filter (where wall_dist < 0.1 and z > 0.05), 0) as mean_z", "coalesce(stddev_pop(z) filter (where wall_dist < 0.1 and z > 0.05), 0) as std_z", "coalesce(quantile_cont(z, 0.9) filter (where wall_dist < 0.1 and z > 0.05), 0) as q90_z", "max(x) - min(x) as extent_x", "max(y) - min(y) as extent_y", "ln(count(*)) as log_n")} from points group by case_id""", "points"))
def _(s, d):
    return metrics.case_features(views.points(s, d), ["case_id"])


# --- pool --------------------------------------------------------------------------------------------------------
def _manifests(s, d):
    p = views.pool(s, d)
    first = p.where("case_id % 5 <> 4").withColumn("error", F.when(F.col("case_id") % 50 == 0, "broken"))
    second = p.where("case_id % 5 = 4 or case_id % 97 = 0").drop("tier")
    return pool.union({"a": first, "b": second})


_MAN = (", u as (select case_id, source, split, family, shard from pool where case_id % 5 <> 4 and case_id % 50 <> 0 "
    "union all select case_id, source, split, family, shard from pool where case_id % 5 = 4 or case_id % 97 = 0)")


@query("pool_union_validate", sql(_MAN + """ select 'duplicate_case' as rule, count(*) as n from (select case_id from u group by 1 having count(*) > 1)
union all select 'family_in_splits', count(*) from (select family from u group by 1 having count(distinct split) > 1)
union all select 'absent_source', 1 union all select 'held_out_source', count(*) from u where source = '5-LOW'""", "pool"))
def _(s, d):
    wanted = s.createDataFrame([("1-URGENT",), ("9-NONE",)], "source string")
    return pool.violations(_manifests(s, d), wanted, s.createDataFrame([("5-LOW",)], "source string"))


@query("pool_duplicates", sql(_MAN + " select case_id, count(*) as n from u group by 1 having count(*) > 1", "pool"))
def _(s, d):
    return pool.duplicates(_manifests(s, d))


@query("pool_family_leak", sql("select family, count(distinct split) as n_splits, count(*) as n from pool group by 1 having count(distinct split) > 1", "pool"))
def _(s, d):
    return pool.family_leaks(views.pool(s, d))


@query("pool_absent_sources", sql("select source from (values ('1-URGENT'), ('9-NONE'), ('8-NONE')) t(source) where source not in (select source from pool)", "pool"))
def _(s, d):
    return pool.absent_sources(views.pool(s, d), s.createDataFrame([("1-URGENT",), ("9-NONE",), ("8-NONE",)], "source string"))


@query("pool_heldout_semi", sql("select case_id, source from pool where source in ('5-LOW', '3-MEDIUM')", "pool"))
def _(s, d):
    return pool.held_out(views.pool(s, d), s.createDataFrame([("5-LOW",), ("3-MEDIUM",)], "source string")).select("case_id", "source")


@query("pool_fingerprint", sql(", b as (select case_id % 256 as b, sha256(string_agg(concat_ws(',', case_id, source, split, "
    "shard), chr(10) order by case_id)) as d, count(*) as n from pool group by 1) select sha256(string_agg(d, "
    "chr(10) order by b)) as fingerprint, cast(sum(n) as bigint) as n from b", "pool"))
def _(s, d):
    return pool.fingerprint(views.pool(s, d))


@query("split_assignment", sql(", k as (select case_id, split from pool where tier = 'P'), r as (select case_id, row_number() over (order by md5('s1|' || case_id::varchar), "
    "case_id) as n from pool where tier <> 'P') select case_id, split from k union all select case_id, "
    "case when n <= 100 then 'val' else 'train' end from r", "pool"))
def _(s, d):
    p = views.pool(s, d)
    return pool.assign_splits(p, "s1", 100, p.where("tier = 'P'").select("case_id", "split"))


# --- sampling ----------------------------------------------------------------------------------------------------
def _md5(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"


@query("stratified_sample", sql(f""", s as (select case_id, count(*) as n, quantile_cont(x, 0.9) as q from points group by 1), d as (select * from points join s using (case_id)),
  a as (select case_id, point_id from d where n > 20 and wall_dist < 0.25 qualify row_number() over (partition by case_id order by {_md5("'3'", "'near'", "point_id")}, point_id) <= 10),
  b as (select case_id, point_id from d where n > 20 and (case_id, point_id) not in (select case_id, point_id from a) qualify row_number() over (partition by case_id order by {_md5("'3'", "'any'", "point_id")}, point_id) <= 4),
  c as (select case_id, point_id from d where n > 20 and x >= q and (case_id, point_id) not in (select case_id, point_id from a union all select case_id, point_id from b) qualify row_number() over (partition by case_id order by {_md5("'3'", "'wake'", "point_id")}, point_id) <= 6)
select case_id, point_id, 1 as stratum from a union all select case_id, point_id, 0 from b union all select case_id, point_id, 2 from c union all select case_id, point_id, case when wall_dist < 0.25 then 1 else 0 end from d where n <= 20""", "points"))
def _(s, d):
    return sampling.stratified(views.points(s, d), ["case_id"], 20, 3, F.col("x")).select("case_id", "point_id", "stratum")


@query("context_sample", sql(f""", a as (select case_id, point_id from points where wall_dist < 0.25 qualify row_number() over (partition by case_id order by {_md5("'5'", "'near'", "point_id")}, point_id) <= 10),
  t as (select case_id, count(*) as t from a group by 1),
  b as (select case_id, point_id, coalesce(t, 0) as t, row_number() over (partition by case_id order by {_md5("'5'", "'rest'", "point_id")}, point_id) as n from points left join t using (case_id) where (case_id, point_id) not in (select case_id, point_id from a))
select case_id, point_id from a union all select case_id, point_id from b where n <= 14 - t""", "points"))
def _(s, d):
    return sampling.context(views.points(s, d), ["case_id"], 14, 5).select("case_id", "point_id")


_EPOCH = f"select case_id, row_number() over (order by {_md5(chr(39) + '7' + chr(39), chr(39) + '2' + chr(39), 'case_id')}, case_id) - 1 as pos from pool"


@query("epoch_permutation", sql(_EPOCH, "pool"))
def _(s, d):
    return sampling.epoch_order(views.pool(s, d), 7, 2)


@query("epoch_resume_offset", sql(f"select * from ({_EPOCH}) where pos >= 1000", "pool"))
def _(s, d):
    return sampling.epoch_order(views.pool(s, d), 7, 2, 1000)


@query("weighted_epoch", sql(f""", w as (select * from (values ('1-URGENT', 0.5), ('2-HIGH', 0.25), ('5-LOW', 0.25)) t(source, share)),
  z as (select source, count(*) as size, any_value(cast(round_even((select count(*) from pool) * share, 0) as bigint)) as m from pool join w using (source) group by 1),
  e as (select case_id, source, size, m, unnest(range(0, greatest(1, cast(ceil(m / size) as bigint)))) as round from pool join z using (source)),
  k as (select *, row_number() over (partition by source, round order by {_md5("'7'", "'2'", "round", "case_id")}, case_id) as r from e)
select case_id, source, cast(round as int) as round from k where round * size + r <= m""", "pool"))
def _(s, d):
    return sampling.weighted_epoch(views.pool(s, d), "source", {"1-URGENT": 2.0, "2-HIGH": 1.0, "5-LOW": 1.0}, 7, 2)


def _unit_sql(*parts: str) -> str:
    return f"cast(('0x' || substr({_md5(*parts)}, 1, 8))::bigint as double) / 4294967296.0"


def _mask_sql(score: str, ratio: float, head: str = "") -> str:
    return sql(f"{head}, s as (select case_id, point_id, {score} as score from points), c as (select case_id, "
    f"quantile_cont(score, {1 - ratio}) as cut from s group by 1) select case_id, point_id, round(score, "
    f"6) + 0.0 as score, score >= cut as masked from s join c using (case_id)", "points")


@query("mask_near_wall", _mask_sql("-wall_dist + 0.1 * " + _unit_sql("'1'", "point_id"), 0.6))
def _(s, d):
    return sampling.point_mask(views.points(s, d), ["case_id"], -F.col("wall_dist") + 0.1 * sampling.unit(1, F.col("point_id")), 0.6).select("case_id", "point_id", "score", "masked")


@query("mask_wake", _mask_sql("x + 0.1 * " + _unit_sql("'1'", "point_id"), 0.6))
def _(s, d):
    return sampling.point_mask(views.points(s, d), ["case_id"], F.col("x") + 0.1 * sampling.unit(1, F.col("point_id")), 0.6).select("case_id", "point_id", "score", "masked")


_BOXES = [(0.05, 0.0, 0.1, 0.08), (-0.1, 0.1, 0.0, 0.12), (0.0, -0.15, -0.05, 0.1)]


@query("mask_boxes", _mask_sql("-least(" + ", ".join(f"greatest(abs(x - ({a})), abs(y - ({b})), abs(z - ({c}))) / {h}" for a, b, c, h in _BOXES) + ")", 0.5))
def _(s, d):
    far = F.least(*[F.greatest(F.abs(F.col("x") - a), F.abs(F.col("y") - b), F.abs(F.col("z") - c)) / h for a, b, c, h in _BOXES])
    return sampling.point_mask(views.points(s, d), ["case_id"], -far, 0.5).select("case_id", "point_id", "score", "masked")


_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_OWNER = (f", n as (select a.case_id, a.point_id, b.point_id as ref_id, {_D2} as d2 from points a join points b on a.case_id = b.case_id "
    f"and b.point_id % 7 = 0 qualify row_number() over (partition by a.case_id, a.point_id order by {_D2}, "
    f"b.point_id) = 1)")


def _refs(s, d, modulo: int):
    return views.points(s, d).where(F.col("point_id") % modulo == 0).withColumnRenamed("point_id", "ref_id")


@query("mask_tokens", sql(_OWNER + f", s as (select case_id, point_id, {_unit_sql(chr(39) + '1' + chr(39), 'ref_id')} as score "
    f"from n), c as (select case_id, quantile_cont(score, 0.4) as cut from s group by 1) select case_id, "
    f"point_id, round(score, 6) + 0.0 as score, score >= cut as masked from s join c using (case_id)", "points"))
def _(s, d):
    owner = spatial.knn(views.points(s, d), _refs(s, d, 7), 1)
    return sampling.point_mask(owner, ["case_id"], sampling.unit(1, F.col("ref_id")), 0.6).select("case_id", "point_id", "score", "masked")


@query("pedestrian_probes", sql(f"select case_id, point_id from points where abs(z - 0.05) <= 0.08 and wall_dist > 0.2 and x between -0.2 "
    f"and 0.2 qualify row_number() over (partition by case_id order by {_md5(chr(39) + '9' + chr(39), 'point_id')}, "
    f"point_id) <= 8", "points"))
def _(s, d):
    return sampling.street_probes(views.points(s, d), ["case_id"], 0.05, 0.08, 0.2, (-0.2, 0.2), 8, 9).select("case_id", "point_id")


# --- space -------------------------------------------------------------------------------------------------------
@query("knn_tokens", sql(f"select a.case_id, a.point_id, cast(row_number() over w as int) as rank, b.point_id as ref_id, "
    f"round(sqrt({_D2}), 6) + 0.0 as dist from points a join points b using (case_id) where a.point_id % 5 = 0 "
    f"window w as (partition by a.case_id, a.point_id order by {_D2}, b.point_id) qualify row_number() over w <= 4", "points"))
def _(s, d):
    p = views.points(s, d)
    return spatial.knn(p.where("point_id % 5 = 0"), p.withColumnRenamed("point_id", "ref_id"), 4).select("case_id", "point_id", "rank", "ref_id", F.sqrt("d2").alias("dist"))


@query("voronoi_owner", sql(_OWNER + " select case_id, point_id, ref_id from n", "points"))
def _(s, d):
    return spatial.knn(views.points(s, d), _refs(s, d, 7), 1).select("case_id", "point_id", "ref_id")


@query("attach_prior_nn", sql(_OWNER + f" select n.case_id, n.point_id, n.ref_id, {r('b.ux as prior_ux', 'b.cp as prior_cp')} from n "
    f"join points b on n.case_id = b.case_id and n.ref_id = b.point_id", "points"))
def _(s, d):
    return spatial.attach_prior(views.points(s, d), _refs(s, d, 7), ["ux", "cp"]).select("case_id", "point_id", "ref_id", "prior_ux", "prior_cp")


def _walls(s, d):
    return _refs(s, d, 7).select("case_id", "ref_id", "x", "y", "z", F.col("nx").alias("fnx"), F.col("ny").alias("fny"), F.col("nz").alias("fnz"))


_WALL = _OWNER + ", g as (select n.case_id, n.point_id, n.ref_id, a.z, sqrt(d2) as wall, " + ", ".join(f"case when sqrt(d2) > 1e-12 then (a.{c} - b.{c}) / sqrt(d2) else b.n{c} end as wn{c}" for c in "xyz") + " from n join points a on n.case_id = a.case_id and n.point_id = a.point_id join points b on n.case_id = b.case_id and n.ref_id = b.point_id)"


@query("wall_geometry_nn", sql(_WALL + f" select case_id, point_id, ref_id, {r('wall', 'wnx', 'wny', 'wnz')} from g", "points"))
def _(s, d):
    return spatial.wall_geometry(views.points(s, d), _walls(s, d)).drop("z")


@query("wall_distance_ground", sql(_WALL + f" select case_id, point_id, {r('least(wall, z + 0.1) as wall', 'case when z + 0.1 < wall then 0.0 else wnx end as wnx', 'case when z + 0.1 < wall then 0.0 else wny end as wny', 'case when z + 0.1 < wall then 1.0 else wnz end as wnz')} "
    f"from g", "points"))
def _(s, d):
    return spatial.with_ground(spatial.wall_geometry(views.points(s, d), _walls(s, d)), -0.1)


@query("compare_frames", sql(_OWNER + ", m as (select n.case_id, sqrt(d2) / 2 as d, abs(a.wall_dist - b.wall_dist) / 2 as w from n "
    "join points a on n.case_id = a.case_id and n.point_id = a.point_id join points b on n.case_id = b.case_id "
    "and n.ref_id = b.point_id) select case_id, " + r(*[f"quantile_cont({c}, {q}) as {n}_q{str(q)[2:].ljust(2, '0')}" for c, n in (("d", "match"), ("w", "wall")) for q in (0.5, 0.9, 0.99)]) + " from m group by 1", "points"))
def _(s, d):
    return spatial.compare_frames(views.points(s, d), _refs(s, d, 7), 2.0)


@query("compare_shared_points", sql(_OWNER + f", m as (select n.case_id, a.ux as au, b.ux as bu, a.cp as ac, b.cp as bc from n join points a on n.case_id = a.case_id "
    f"and n.point_id = a.point_id join points b on n.case_id = b.case_id and n.ref_id = b.point_id "
    f"where sqrt(d2) / 2 <= 0.01), g as (select case_id, count(*) as n, sqrt(sum((au - bu) * (au - bu) + (ac - bc) * (ac - bc))) / (sqrt(sum(bu * bu + bc * bc)) + 1e-12) as e "
    f"from m group by 1) select case_id, t.n_points, coalesce(n, 0) as n_matched, case when n > 0 then 'ok' "
    f"else 'insufficient_matches' end as status, {r('e as rel_l2')} from (select case_id, count(*) as n_points "
    f"from points group by 1) t left join g using (case_id)", "points"))
def _(s, d):
    return spatial.compare_shared(views.points(s, d), _refs(s, d, 7), ["case_id"], ["ux", "cp"], 2.0, 0.01)


@query("owner_match_one_to_one", sql(_OWNER + " select n.case_id, count(*) as n, count(*) filter (where sqrt(d2) <= 5 * cell_size) as n_close, "
    "count(distinct ref_id) as n_refs, bool_and(sqrt(d2) <= 5 * cell_size) and count(distinct ref_id) = count(*) as one_to_one "
    "from n join points a on n.case_id = a.case_id and n.point_id = a.point_id group by 1", "points"))
def _(s, d):
    return spatial.one_to_one(views.points(s, d), _refs(s, d, 7), 5 * F.col("cell_size"))


def _fps_sql(n: int, weight: str, start: int) -> str:
    return f"""recursive_rows as (select case_id, point_id, x, y, z, {weight} as w, row_number() over (partition by case_id order by point_id) - 1 as i, count(*) over (partition by case_id) as n from points),
  f(case_id, step, point_id, chosen) as (select case_id, 0, point_id, [point_id] from recursive_rows where i = {start} % n
    union all select c.case_id, c.step + 1, c.pick, list_append(c.chosen, c.pick) from (select f.case_id, f.step, f.chosen, arg_max(p.point_id, (p.w * m.d, -p.i)) as pick
      from f join recursive_rows p using (case_id), lateral (select min((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) as d from recursive_rows q where q.case_id = f.case_id and list_contains(f.chosen, q.point_id)) m
      where f.step < {n} - 1 and not list_contains(f.chosen, p.point_id) group by f.case_id, f.step, f.chosen) c)"""


@query("fps_uniform", sql(", " + _fps_sql(16, "1.0", 0) + " select case_id, step, point_id from f", "points", recursive=True))
def _(s, d):
    return tokens.farthest_points(views.points(s, d), 16)


_WW = "power(1 / (1 + greatest(wall_dist, 0) / 0.5), 2)"


@query("fps_weighted", sql(", " + _fps_sql(12, _WW, 0) + " select case_id, step, point_id from f", "points", recursive=True))
def _(s, d):
    return tokens.farthest_points(views.points(s, d), 12, tokens.wall_weight(0.5))


def _groups(s, d):
    return tokens.token_groups(views.points(s, d), 6, 4, 5, 0.5, 2.0)


_TOK = ", " + _fps_sql(6, _WW, 0) + ", " + _fps_sql(4, "1.0", 1).replace("recursive_rows", "rows2").replace("f(case_id", "f2(case_id").replace("from f join", "from f2 f join") + (f", c as (select case_id, 0 as scale, step, point_id from f union all select case_id, 1, step, "
    f"point_id from f2), t as (select c.case_id, c.scale, c.step, c.point_id, b.point_id as ref_id, "
    f"sqrt({_D2}) as dist from c join points a on c.case_id = a.case_id and c.point_id = a.point_id "
    f"join points b on b.case_id = c.case_id qualify row_number() over (partition by c.case_id, "
    f"c.scale, c.step order by {_D2}, b.point_id) <= 5)")


@query("token_coverage", sql(_TOK + f", v as (select case_id, point_id, wall_dist, case when (case_id, point_id) in (select case_id, "
    f"ref_id from t) then 1.0 else 0.0 end as seen from points) select case_id, {r('avg(seen) as covered', 'avg(seen) filter (where wall_dist < 0.25) as covered_near', 'avg(seen) filter (where wall_dist >= 0.25) as covered_far')} "
    f"from v group by 1", "points", recursive=True))
def _(s, d):
    return tokens.token_coverage(views.points(s, d), _groups(s, d))


@query("tokeniser_stats", sql(_TOK + f", e as (select case_id, scale, step, max(dist) as r from t group by all), q as (select case_id, "
    f"scale, quantile_cont(r, 0.1) as a, quantile_cont(r, 0.5) as b, quantile_cont(r, 0.9) as c "
    f"from e group by all) select scale, {r('quantile_cont(a, 0.5) as r_q10', 'quantile_cont(b, 0.5) as r_q50', 'quantile_cont(c, 0.5) as r_q90')} "
    f"from q group by 1", "points", recursive=True))
def _(s, d):
    return tokens.tokeniser_stats(_groups(s, d))


@query("token_groups", sql(_TOK + ", e as (select *, row_number() over (partition by case_id, scale, step order by dist, ref_id) as rank, "
    "max(dist) over (partition by case_id, scale, step) as r_eff from t) select case_id, scale, "
    "step as token, point_id as centre_id, cast(rank as int) as rank, ref_id, round(r_eff, 6) + 0.0 as r_eff "
    "from e", "points", recursive=True))
def _(s, d):
    return _groups(s, d).drop("dist", "radius")


# --- fields and frames -------------------------------------------------------------------------------------------
@query("encode_fields", sql(f"select case_id, point_id, {r('ln(1 + greatest(k - 0.0005, 0) / 0.001) as k', 'ln(1 + greatest(eps, 0) / 0.001) as eps')} from points", "points"))
def _(s, d):
    return views.points(s, d).select("case_id", "point_id", fields.encode(F.col("k") - 0.0005).alias("k"), fields.encode(F.col("eps")).alias("eps"))


@query("decode_fields", sql(f"select case_id, point_id, {r('(exp(greatest(ux * 9, 0)) - 1) * 0.001 as k', '(exp(greatest(uy * 9, 0)) - 1) * 0.001 as eps')} from points", "points"))
def _(s, d):
    return views.points(s, d).select("case_id", "point_id", fields.decode(F.col("ux") * 9).alias("k"), fields.decode(F.col("uy") * 9).alias("eps"))


_COND = [("log10_re", "x * 10", 6.0, 2.0), ("abl_alpha", "case when y > 0 then y end", 0.2, 0.1), ("log10_z0", "case when z > 0.1 then 'nan'::double else z end", -3.0, 1.5), ("turb_intensity", "k", 0.1, 0.05)]
_FIN = "({e}) is not null and not isnan({e})"


@query("conditioning_vector", sql("select case_id, point_id, " + r(*[f"case when {_FIN.format(e=e)} then (({e}) - ({m})) / {w} else 0.0 end as v{i}" for i, (_, e, m, w) in enumerate(_COND)], *[f"case when {_FIN.format(e=e)} then 1.0 else 0.0 end as v{i + 4}" for i, (_, e, _, _) in enumerate(_COND)], *[f"{c} / sqrt(nx * nx + ny * ny + nz * nz) as v{i + 8}" for i, c in enumerate(("nx", "ny", "nz"))], "case when point_id % 2 = 0 then 1.0 else 0.0 end as v11") + " from points", "points"))
def _(s, d):
    p = views.points(s, d).withColumns({n: F.expr(e.replace("'nan'::double", "double('nan')")) for n, e, _, _ in _COND})
    v = p.select("case_id", "point_id", fields.conditioning_vector(F.col("point_id") % 2 == 0, [F.col("nx"), F.col("ny"), F.col("nz")]).alias("v"))
    return v.select("case_id", "point_id", *[F.col("v")[i].alias(f"v{i}") for i in range(12)])


@query("geometry_features_point", sql("select case_id, point_id, " + r("ln(greatest(wall_dist, 0) + 0.01) as g0", "least(wall_dist, 5) as g1", "nx as g2", "ny as g3", "nz as g4", "greatest(least(z * 100, 20), -5) / 5 as g5", "greatest(least(x * 20, 10), -10) as g6", "case when point_id % 3 = 0 then 0 else ln(greatest(cell_size, 1e-4)) / 5 end as g7", "case when point_id % 3 = 0 then 0.0 else 1.0 end as g8") + " from points", "points"))
def _(s, d):
    p = views.points(s, d).withColumn("cell_size", F.when(F.col("point_id") % 3 != 0, F.col("cell_size")))
    g = p.select("case_id", "point_id", fields.geometry_features(F.col("z") * 100, F.col("x") * 100).alias("g"))
    return g.select("case_id", "point_id", *[F.col("g")[i].alias(f"g{i}") for i in range(9)])


@query("rotate_z", sql("select case_id, point_id, " + r("x * cos(0.7) - y * sin(0.7) as x", "x * sin(0.7) + y * cos(0.7) as y", "z", "ux * cos(0.7) - uy * sin(0.7) as ux", "ux * sin(0.7) + uy * cos(0.7) as uy", "cp") + " from points", "points"))
def _(s, d):
    return fields.rotate_z(views.points(s, d), 0.7).select("case_id", "point_id", "x", "y", "z", "ux", "uy", "cp")


@query("mirror_y", sql("select case_id, point_id, " + r("x", "-y as y", "-ny as ny", "-uy as uy", "-p_uy as p_uy") + " from points", "points"))
def _(s, d):
    return fields.mirror_y(views.points(s, d)).select("case_id", "point_id", "x", "y", "ny", "uy", "p_uy")


@query("physical_fields", sql("select case_id, point_id, " + r("ux * 10 as si_ux", "uy * 10 as si_uy", "uz * 10 as si_uz", "0.5 * cp * 100 + case when case_id % 2 = 0 then 101.0 else 0 end as si_p", "k * 100 as si_k", "eps * 1000 / 2 as si_eps") + ", case_id % 2 = 0 as gauge_known from points", "points"))
def _(s, d):
    cols = fields.physical_fields(F.lit(10.0), F.lit(2.0), F.when(F.col("case_id") % 2 == 0, F.lit(101.0)))
    return views.points(s, d).select("case_id", "point_id", *[c.alias(n) for n, c in cols.items()])


_K, _L = "greatest(k * 100, 1e-4)", "least(0.41 * greatest(wall_dist * 2, 1e-6), 0.2)"
_EPS = f"greatest(case when case_id % 2 = 0 then eps * 1000 / 2 else power(0.09, 0.75) * power({_K}, 1.5) / {_L} end, 1e-8 * 1000 / 2)"


@query("to_physical", sql("select case_id, point_id, " + r("ux * 10 as si_ux", f"{_K} as si_k", f"{_EPS} as si_eps", f"{_EPS} / (0.09 * {_K}) as si_omega") + " from points", "points"))
def _(s, d):
    cols = fields.to_solver(F.lit(10.0), F.lit(2.0), F.when(F.col("case_id") % 2 == 0, "k-epsilon").otherwise("les"))
    return views.points(s, d).select("case_id", "point_id", *[cols[c].alias(c) for c in ("si_ux", "si_k", "si_eps", "si_omega")])


@query("eps_mixing_length", sql(f"select case_id, point_id, {r('power(0.09, 0.75) * power(greatest(k, 0), 1.5) / least(0.41 * greatest(wall_dist, 1e-6), 0.15) as eps')} from points", "points"))
def _(s, d):
    return views.points(s, d).select("case_id", "point_id", fields.mixing_length_eps(F.col("k"), F.col("wall_dist"), F.lit(1.5)).alias("eps"))


@query("k_from_stress", "select vec_id, " + r("0.5 * (embedding[1]::double + embedding[2]::double + embedding[3]::double) as k_vtk", "0.5 * (embedding[1]::double + embedding[4]::double + embedding[6]::double) as k_foam") + " from embeddings")
def _(s, d):
    stress = [F.col("embedding")[i].cast("double") for i in range(6)]
    return views.table(s, d, "embeddings").select("vec_id", fields.k_from_stress(stress, "vtk").alias("k_vtk"), fields.k_from_stress(stress, "foam").alias("k_foam"))


@query("canonical_roundtrip", sql("select case_id, point_id, " + r("ux / 38.9 as c_ux", "2 * cp / (1.225 * 38.9 * 38.9) as c_cp", "k / (38.9 * 38.9) as c_k", "ux", "cp", "k") + " from points", "points"))
def _(s, d):
    u = F.lit(38.9)
    c = fields.to_canonical([F.col("ux"), F.col("uy"), F.col("uz")], F.col("cp"), F.col("k"), u, "static")
    back = fields.from_canonical(c, u, "static")
    return views.points(s, d).select("case_id", "point_id", c[0].alias("c_ux"), c[3].alias("c_cp"), c[4].alias("c_k"), back[0].alias("ux"), back[3].alias("cp"), back[4].alias("k"))


@query("lr_schedule", "select cast(i as bigint) as step, " + r("case when i < 10 then 0.001 * (i + 1) / 10 else 0.001 * 0.5 * (1 + cos(pi() * least(1, (i - 10) / 90))) end as lr") + " from (select event_id % 120 as i from events)")
def _(s, d):
    step = F.col("event_id") % 120
    return views.table(s, d, "events").select(step.alias("step"), fields.warmup_cosine(step, 0.001, 10, 100).alias("lr"))


@query("protocol_lr", "select cast(i as bigint) as step, " + r("case when i < 5 then (i + 1) / 5 else 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1, (i - 5) / 45))) end as factor") + " from (select event_id % 60 as i from events)")
def _(s, d):
    step = F.col("event_id") % 60
    return views.table(s, d, "events").select(step.alias("step"), fields.warmup_cosine(step, 1.0, 5, 50, 0.1).alias("factor"))


# --- meshes ------------------------------------------------------------------------------------------------------
@query("footprint_stats", sql(""", f as (select case_id, x, y, z, nz, cell_size as area, wall_dist < 0.2 as g, case when case_id % 2 = 0 then -0.05 end as ground from points), k as (select * from f where not g or case_id not in (select case_id from f where not g)),
  l as (select case_id, avg(z) filter (where g) as level from f group by 1),
  s as (select case_id, coalesce(any_value(ground), any_value(level), min(z)) as z0, sum(greatest(nz, 0) * area) as w, sum(greatest(nz, 0) * area * x) as wx, sum(greatest(nz, 0) * area * y) as wy, sum(greatest(nz, 0) * area * z) as wz from k join l using (case_id) group by 1)
select case_id, """ + r("wx / w as x", "wy / w as y", "z0 as z", "wz / w - z0 as height") + " from s", "points"))
def _(s, d):
    f = views.points(s, d).select("case_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), "nz", F.col("cell_size").alias("area"), (F.col("wall_dist") < 0.2).alias("is_ground"))
    return mesh.footprint(f, ["case_id"], f.where("case_id % 2 = 0").select("case_id", F.lit(-0.05).alias("ground_z")).distinct())


_IN_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax"]
_GRID_VALUES = "l_quantity / 50 as ux, l_discount * 10 as uy, l_tax * 10 as uz, l_quantity > 20 as fluid"
_NUMBERED = f"(select *, row_number() over (partition by l_suppkey order by {', '.join(_IN_ORDER)}) - 1 as i from lineitem)"


#: Lines of a task: the number of tasks goes by the lines, not by how small these look when compressed.
LINES = 250_000


def _tasks(lines):
    return max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // LINES))


def _numbered(s, d):
    lines = views.table(s, d, "lineitem")
    return lines.repartition(_tasks(lines), "l_suppkey").withColumn("i", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*_IN_ORDER)) - 1)


def _grid(s, d):
    """A grid of 10 x 5 columns for each supplier, with as many layers as all its lines fill."""
    at = lambda e: F.floor(e).cast("int")
    return _numbered(s, d).select(F.col("l_suppkey").alias("case_id"), at(F.col("i") % 10).alias("ix"), at(F.col("i") / 10 % 5).alias("iy"), at(F.col("i") / 50).alias("iz"), *[F.expr(e) for e in _GRID_VALUES.split(", ")])


_GRID = f"g as (select l_suppkey as case_id, i % 10 as ix, i // 10 % 5 as iy, i // 50 as iz, {_GRID_VALUES} from {_NUMBERED})"


@query("mean_building_height", f"""with {_GRID}, n as (select case_id, max(iz) + 1 as nz from g group by 1),
  c as (select case_id, ix, iy, bool_or(iz = 0 and not fluid) as solid, min(iz) filter (where fluid) as top from g group by all)
select case_id, {r("coalesce(avg(coalesce(top, nz)) filter (where solid) * 0.5, 'nan'::double) as height")}, count(*) filter (where solid) as n_columns,
  {r("coalesce(avg((ix + 0.5) * 0.5) filter (where solid), 'nan'::double) as x", "coalesce(avg((iy + 0.5) * 0.5) filter (where solid), 'nan'::double) as y")} from c join n using (case_id) group by 1""")
def _(s, d):
    return mesh.building_height(_grid(s, d), ["case_id"], 0.5)


def _whole_grid(s, d):
    """All lines of all suppliers as 10 x 10 x 5 grids: a supplier's case has one part for every 500 lines."""
    at = lambda by, n: F.floor(F.col("i") / by % n).cast("int")
    return _numbered(s, d).select(F.col("l_suppkey").alias("case_id"), F.floor(F.col("i") / 500).cast("int").alias("part"), at(1, 10).alias("ix"), at(10, 10).alias("iy"), at(100, 5).alias("iz"), *[F.expr(e) for e in _GRID_VALUES.split(", ")])


_WHOLE_GRID = f"g as (select l_suppkey as case_id, i // 500 as part, i % 10 as ix, i // 10 % 10 as iy, i // 100 % 5 as iz, {_GRID_VALUES} from {_NUMBERED})"


@query("mean_building_height_all", f"""with {_WHOLE_GRID}, c as (select case_id, part, ix, iy, bool_or(iz = 0 and not fluid) as solid, coalesce(min(iz) filter (where fluid), 5) as top from g group by all)
select case_id, cast(part as int) as part, {r("coalesce(avg(top) filter (where solid) * 0.5, 'nan'::double) as height")}, count(*) filter (where solid) as n_columns,
  {r("coalesce(avg((ix + 0.5) * 0.5) filter (where solid), 'nan'::double) as x", "coalesce(avg((iy + 0.5) * 0.5) filter (where solid), 'nan'::double) as y")} from c group by case_id, part""")
def _(s, d):
    return mesh.building_height(_whole_grid(s, d), ["case_id", "part"], 0.5, 5)


def _slope_sql(u: str, by: str, others: str) -> str:
    w = f"(partition by case_id, {others} order by {by})"
    return (f"coalesce(case when lag({u}) over {w} is null then (lead({u}) over {w} - {u}) / 0.5 when lead({u}) over {w} is null then ({u} - lag({u}) over {w}) / 0.5 "
    f"else (lead({u}) over {w} - lag({u}) over {w}) / 1.0 end, 0)")


@query("vorticity", f"with {_GRID}, s as (select case_id, ix, iy, iz, {_slope_sql('uz', 'iy', 'ix, iz')} - {_slope_sql('uy', 'iz', 'ix, iy')} as a, "
    f"{_slope_sql('ux', 'iz', 'ix, iy')} - {_slope_sql('uz', 'ix', 'iy, iz')} as b, {_slope_sql('uy', 'ix', 'iy, iz')} - {_slope_sql('ux', 'iy', 'ix, iz')} as c "
    f"from g) select case_id, cast(ix as int) as ix, cast(iy as int) as iy, cast(iz as int) as iz, "
    f"{r('sqrt(a * a + b * b + c * c) as vorticity')} from s")
def _(s, d):
    return mesh.vorticity(_grid(s, d), ["case_id"], 0.5)


@query("vorticity_all", f"with {_WHOLE_GRID}, s as (select case_id, part, ix, iy, iz, {_slope_sql('uz', 'iy', 'part, ix, iz')} - {_slope_sql('uy', 'iz', 'part, ix, iy')} as a, "
    f"{_slope_sql('ux', 'iz', 'part, ix, iy')} - {_slope_sql('uz', 'ix', 'part, iy, iz')} as b, "
    f"{_slope_sql('uy', 'ix', 'part, iy, iz')} - {_slope_sql('ux', 'iy', 'part, ix, iz')} as c from g) "
    f"select case_id, cast(part as int) as part, cast(ix as int) as ix, cast(iy as int) as iy, cast(iz as int) as iz, "
    f"{r('sqrt(a * a + b * b + c * c) as vorticity')} from s")
def _(s, d):
    return mesh.vorticity(_whole_grid(s, d), ["case_id", "part"], 0.5)


@query("orient_normals", sql("select case_id, point_id, " + ", ".join(r(f"case when nx * (p_ux - x) + ny * (p_uy - y) + nz * (p_uz - z) < 0 then -n{c} else n{c} end as n{c}") for c in "xyz") + ", nx * (p_ux - x) + ny * (p_uy - y) + nz * (p_uz - z) < 0 as flip from points", "points"))
def _(s, d):
    f = views.points(s, d).select("case_id", "point_id", "nx", "ny", "nz", *[F.col(c).alias(f"c{c}") for c in "xyz"], F.col("p_ux").alias("ox"), F.col("p_uy").alias("oy"), F.col("p_uz").alias("oz"))
    return mesh.orient(f, ["case_id"])[0].select("case_id", "point_id", "nx", "ny", "nz", "flip")


_FACES = ("f as (select case_id, point_id as face_id, [point_id, coalesce(lead(point_id) over w, point_id), "
    "coalesce(lead(point_id, 2) over w, point_id)] as v from points window w as (partition by case_id "
    "order by point_id))")


def _faces(s, d):
    w = Window.partitionBy("case_id").orderBy("point_id")
    return views.points(s, d).select("case_id", F.col("point_id").alias("face_id"), F.array("point_id", F.coalesce(F.lead("point_id").over(w), "point_id"), F.coalesce(F.lead("point_id", 2).over(w), "point_id")).alias("vertices"))


_CENTRES = (f", {_FACES}, e as (select case_id, face_id, unnest(v) as point_id from f), c as (select case_id, "
    f"face_id, avg(x) as x, avg(y) as y, avg(z) as z from e join points using (case_id, point_id) "
    f"group by all)")


@query("face_centres", sql(f"{_CENTRES} select case_id, face_id, {r('x', 'y', 'z')} from c", "points"))
def _(s, d):
    return mesh.face_centres(_faces(s, d), views.points(s, d))


@query("cell_centres", sql(f"{_CENTRES}, o as (select case_id, face_id, face_id // 4 as cell_id from f union all select case_id, "
    f"face_id, face_id // 4 + 1 from f where face_id % 2 = 0) select case_id, cell_id, {r('avg(x) as x', 'avg(y) as y', 'avg(z) as z')}, "
    f"count(*) as n_faces from o join c using (case_id, face_id) group by all", "points"))
def _(s, d):
    f = _faces(s, d)
    owner = f.select("case_id", "face_id", F.floor(F.col("face_id") / 4).alias("cell_id"))
    other = f.where("face_id % 2 = 0").select("case_id", "face_id", (F.floor(F.col("face_id") / 4) + 1).alias("cell_id"))
    return mesh.cell_centres(mesh.face_centres(f, views.points(s, d)), owner, other)


@query("nearest_layer_slice", sql(f", l as (select case_id, arg_min(zl, (abs(zl - 0.05), zl)) as zl from (select distinct case_id, "
    f"round(z, 2) as zl from points) group by 1) select case_id, {r('zl')}, count(*) as n, {r(_case('p_', 'ux', 'uy', 'uz') + ' as rel_l2')} "
    f"from points join l using (case_id) where abs(z - zl) < 0.01 group by all", "points"))
def _(s, d):
    near = sampling.nearest_layer(views.points(s, d), ["case_id"], 0.05)
    return near.groupBy("case_id", "zl").agg(F.count(F.lit(1)).alias("n"), metrics.rel_l2([(F.col(f"p_{c}"), F.col(c)) for c in ("ux", "uy", "uz")]).alias("rel_l2"))


# --- retrieval and probes ----------------------------------------------------------------------------------------
_Z = ("m as (select i, avg(x) as m, stddev_pop(x) + 1e-6 as s from (select unnest(embedding)::double as x, "
    "generate_subscripts(embedding, 1) as i from embeddings) group by 1), e as (select vec_id, "
    "label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), "
    "z as (select vec_id, label, i, (x - m) / s as z from e join m using (i)), n as (select vec_id, "
    "label, sqrt(sum(z * z)) + 1e-12 as n from z group by all), v as (select vec_id, label, list(z.z / n.n "
    "order by i) as v from z join n using (vec_id, label) group by all)")


@query("embedding_index", f"with {_Z} select vec_id, label, {r('v[1] as v0', 'v[17] as v16', 'v[64] as v63')} from v")
def _(s, d):
    return retrieval.standardise(views.table(s, d, "embeddings"), 64).select("vec_id", "label", *[F.col("v")[i].alias(f"v{i}") for i in (0, 16, 63)])


@query("cosine_topk", f"with {_Z} select q.vec_id as query_id, b.vec_id, round(list_dot_product(q.v, b.v), 6) + 0.0 as score, "
    f"cast(row_number() over w as int) as rank from v q, v b where q.vec_id % 20 = 0 window w as (partition by q.vec_id "
    f"order by list_dot_product(q.v, b.v) desc, b.vec_id) qualify row_number() over w <= 5")
def _(s, d):
    index = retrieval.standardise(views.table(s, d, "embeddings"), 64)
    return retrieval.top_k(index, index.where("vec_id % 20 = 0"), 5, 64)


_RF = ["x", "y", "z"]


@query("ridge_gram", sql(" union all ".join([f"select {i} as i, {j} as j, {r(f'sum({a} * {b}) as value')} from points" for i, a in enumerate(_RF) for j, b in enumerate(_RF) if i <= j] + [f"select {i}, -1, {r(f'sum({a} * cp) as value')} from points" for i, a in enumerate(_RF)]), "points"))
def _(s, d):
    return retrieval.gram(views.points(s, d), _RF, "cp")


_RIDGE = tuple(10.0**k for k in range(-5, 6))


def _ridge_sql() -> str:
    """Leave-one-out by the hat diagonal; the 4 x 4 systems are inverted by their minors."""
    q = range(4)
    every = lambda f: ", ".join(f(i, j) for i in q for j in q)
    upper = {0: "m00 * m11 - m10 * m01", 1: "m00 * m12 - m10 * m02", 2: "m00 * m13 - m10 * m03", 3: "m01 * m12 - m11 * m02", 4: "m01 * m13 - m11 * m03", 5: "m02 * m13 - m12 * m03"}
    lower = {5: "m22 * m33 - m32 * m23", 4: "m21 * m33 - m31 * m23", 3: "m21 * m32 - m31 * m22", 2: "m20 * m33 - m30 * m23", 1: "m20 * m32 - m30 * m22", 0: "m20 * m31 - m30 * m21"}
    inverse = [
        ["m11 * c5 - m12 * c4 + m13 * c3", "-m01 * c5 + m02 * c4 - m03 * c3", "m31 * s5 - m32 * s4 + m33 * s3", "-m21 * s5 + m22 * s4 - m23 * s3"],
        ["-m10 * c5 + m12 * c2 - m13 * c1", "m00 * c5 - m02 * c2 + m03 * c1", "-m30 * s5 + m32 * s2 - m33 * s1", "m20 * s5 - m22 * s2 + m23 * s1"],
        ["m10 * c4 - m11 * c2 + m13 * c0", "-m00 * c4 + m01 * c2 - m03 * c0", "m30 * s4 - m31 * s2 + m33 * s0", "-m20 * s4 + m21 * s2 - m23 * s0"],
        ["-m10 * c3 + m11 * c1 - m12 * c0", "m00 * c3 - m01 * c1 + m02 * c0", "-m30 * s3 + m31 * s1 - m32 * s0", "m20 * s3 - m21 * s1 + m22 * s0"],
    ]
    return sql(f""", r as (select case_id, cp as t, x as x0, y as x1, z as x2, wall_dist as x3 from points),
  mo as (select case_id, count(*) as n, avg(t) as mt, {', '.join(f'avg(x{i}) as a{i}, stddev_pop(x{i}) + 1e-12 as d{i}' for i in q)} from r group by 1),
  z as (select case_id, n, t - mt as t, {', '.join(f'(x{i} - a{i}) / d{i} as z{i}' for i in q)} from r join mo using (case_id)),
  g as (select case_id, sum(t * t) as total, {every(lambda i, j: f'sum(z{i} * z{j}) as g{i}{j}')}, {', '.join(f'sum(z{i} * t) as v{i}' for i in q)} from z group by 1),
  m as (select *, {every(lambda i, j: f'g{i}{j}' + (' + alpha' if i == j else '') + f' as m{i}{j}')} from g, (select unnest({[float(x) for x in _RIDGE]}) as alpha)),
  c as (select *, {', '.join(f'{e} as s{k}' for k, e in upper.items())}, {', '.join(f'{e} as c{k}' for k, e in lower.items())} from m),
  d as (select *, s0 * c5 - s1 * c4 + s2 * c3 + s3 * c2 - s4 * c1 + s5 * c0 as det from c),
  b as (select case_id, alpha, total, v0, v1, v2, v3, {every(lambda i, j: f'({inverse[i][j]}) / det as b{i}{j}')} from d),
  w as (select *, {', '.join('(' + ' + '.join(f'b{i}{j} * v{j}' for j in q) + f') as w{i}' for i in q)} from b),
  e as (select case_id, alpha, total, n, (t - {' - '.join(f'w{i} * z{i}' for i in q)}) / greatest(1 - ({' + '.join(f'b{i}{j} * z{i} * z{j}' for i in q for j in q)}) - 1 / n, 1e-6) as e from z join w using (case_id)),
  o as (select case_id, alpha, any_value(n) as n, any_value(total) as total, sum(e * e) as sse from e group by all),
  p as (select case_id, any_value(n) as n, 1 - min(sse) / any_value(total) as r2, arg_min(alpha, (sse, alpha)) as alpha from o group by 1)
select case_id, n, {r('r2', 'alpha')}, alpha in ({min(_RIDGE)}, {max(_RIDGE)}) as at_edge from p""", "points")


@query("ridge_loo", _ridge_sql())
def _(s, d):
    return retrieval.ridge_loo(views.points(s, d), ["case_id"], ["x", "y", "z", "wall_dist"], "cp", _RIDGE)


@query("rope_rotate", "with v as (select vec_id, list_transform(embedding[1:10], lambda x: x::double) as v, vec_id % 50 / 10 as p from embeddings) select vec_id, " + ", ".join(r(f"v[{2 * i + 1}] * cos(p * 2 * pi() / power(100, {i} / 3)) - v[{2 * i + 2}] * sin(p * 2 * pi() / power(100, {i} / 3)) as r{2 * i}", f"v[{2 * i + 1}] * sin(p * 2 * pi() / power(100, {i} / 3)) + v[{2 * i + 2}] * cos(p * 2 * pi() / power(100, {i} / 3)) as r{2 * i + 1}") for i in range(4)) + ", " + r("v[9] as r8", "v[10] as r9") + " from v")
def _(s, d):
    v = views.table(s, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("v"))
    out = v.select("vec_id", attention.rotary(F.col("v"), F.col("vec_id") % 50 / 10, 4).alias("r"))
    return out.select("vec_id", *[F.col("r")[i].alias(f"r{i}") for i in range(10)])


@query("attention_small", "with v as (select label, vec_id, list_transform(embedding[1:4], lambda x: x::double * 5) as q, "
    "list_transform(embedding[5:8], lambda x: x::double * 5) as k, list_transform(embedding[9:12], "
    "lambda x: x::double) as v from embeddings), s as (select a.label, a.vec_id as query_id, b.v, "
    "list_dot_product(a.q, b.k) / 2 as s from v a join v b on a.label = b.label and b.vec_id % 3 <> 0 "
    "where a.vec_id % 4 = 0), e as (select *, exp(s - max(s) over (partition by label, query_id)) as e "
    "from s) select label, query_id, " + r(*[f"sum(e * v[{i + 1}]) / sum(e) as o{i}" for i in range(4)]) + " from e group by all")
def _(s, d):
    part = lambda a, scale: F.transform(F.slice("embedding", a, 4), lambda x: x.cast("double") * scale)
    e = views.table(s, d, "embeddings").select("label", "vec_id", part(1, 5.0).alias("q"), part(5, 5.0).alias("k"), part(9, 1.0).alias("v"))
    q = e.where("vec_id % 4 = 0").select("label", F.col("vec_id").alias("query_id"), "q")
    return attention.attention(q, e.select("label", F.col("vec_id").alias("key_id"), "k", "v", (F.col("vec_id") % 3 != 0).alias("valid")), "label", 4)


@query("masked_maxpool", sql(f"select case_id, point_id % 8 as token, {r('max(ux) filter (where wall_dist < 0.5) as ux', 'max(cp) filter (where wall_dist < 0.5) as cp')} "
    f"from points group by all", "points"))
def _(s, d):
    return attention.max_pool(views.points(s, d).withColumn("token", F.col("point_id") % 8), ["case_id", "token"], ["ux", "cp"], F.col("wall_dist") < 0.5)


# --- streams -----------------------------------------------------------------------------------------------------
def _event_stream(s: SparkSession, d: str) -> DataFrame:
    """The events table's file as a stream."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_latest_wins", f"select user_id as run_id, {r('it')}, {r('value')} from (select user_id, round(floor(value) / 7, "
    f"9) as it, arg_max(value, (event_type, event_id)) as value from events group by all)")
def _(s, d):
    rows = _event_stream(s, d).select(F.col("user_id").alias("run_id"), (F.floor("value") / 7).alias("it"), F.col("event_type").alias("start"), F.col("event_id").alias("line"), "value")
    return streaming.run_now(streaming.latest_wins(rows))


@query("stream_residual_state", f"select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, user_id as run_id, event_type as name, "
    f"count(*) as n, {r('arg_max(value, event_id) as last')}, max(value) > 150 as over from events "
    f"group by all")
def _(s, d):
    rows = _event_stream(s, d).select("ts", F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), "value", "event_id")
    return streaming.run_now(streaming.residual_state(rows, 150.0))


# --- samples and manifest jobs -----------------------------------------------------------------------------------
_SPEC = samples.SampleSpec(n_context=14, n_query=12)
_N = f"'{1 * 1_000_003 + 2 * 1_009 + 3}'"
_CTX = f"""a as (select case_id, point_id from points where wall_dist < 0.25 qualify row_number() over (partition by case_id order by {_md5(_N, "'near'", "point_id")}, point_id) <= 10),
  t as (select case_id, count(*) as t from a group by 1),
  b as (select case_id, point_id, coalesce(t, 0) as t, row_number() over (partition by case_id order by {_md5(_N, "'rest'", "point_id")}, point_id) as n from points left join t using (case_id) where (case_id, point_id) not in (select case_id, point_id from a)),
  ctx as (select case_id, point_id from a union all select case_id, point_id from b where n <= 14 - t),
  dr as (select case_id, case when u >= 0.75 then 1.0 when u >= 0.5 then 0.9 else 0.6 end as ratio, p < 0.5 as use_prior from (select case_id, {_unit_sql("'1'", "'2'", "'3'", "'ratio'", "case_id")} as u, {_unit_sql("'1'", "'2'", "'3'", "'prior'", "case_id")} as p from (select distinct case_id from points))),
  sc as (select case_id, point_id, ratio, use_prior, {_unit_sql(_N, "'mask'", "point_id")} as score from ctx join dr using (case_id)),
  cu as (select case_id, case any_value(ratio) when 0.6 then quantile_cont(score, 0.4) when 0.9 then quantile_cont(score, 0.1) else -1 end as cut from sc group by 1),
  mk as (select case_id, point_id, ratio, use_prior, score >= cut as masked from sc join cu using (case_id))"""


@query("sample_context", sql(f", {_CTX} select case_id, point_id, masked, use_prior, cast(ratio as double) as ratio from mk", "points"))
def _(s, d):
    return samples.sample(views.points(s, d), _SPEC, 1, 2, 3)["context"]


@query("sample_queries", sql(f""", {_CTX}, h as (select case_id, point_id, count(*) over (partition by case_id) as n from mk where masked),
  e as (select case_id, point_id, unnest(range(0, cast(ceil(12 / n) as bigint))) as round from h)
select case_id, cast(row_number() over w as int) as slot, point_id from e window w as (partition by case_id order by round, {_md5(_N, "'query'", "round", "point_id")}, point_id) qualify row_number() over w <= 12""", "points"))
def _(s, d):
    return samples.sample(views.points(s, d), _SPEC, 1, 2, 3)["queries"]


_NEAR3 = (f", n as (select a.case_id, a.point_id, b.ux, b.cp, 1 / (sqrt({_D2}) + 1e-9) as w from points a "
    f"join points b on a.case_id = b.case_id and b.point_id % 3 = 0 where a.point_id % 3 <> 0 qualify row_number() over (partition by a.case_id, "
    f"a.point_id order by {_D2}, b.point_id) <= 3)")


@query("knn_interpolated", sql(_NEAR3 + f" select case_id, point_id, {r('sum(w * ux) / sum(w) as ux', 'sum(w * cp) / sum(w) as cp')} from n group by all", "points"))
def _(s, d):
    p = views.points(s, d)
    return samples.interpolate(p.where("point_id % 3 <> 0"), p.where("point_id % 3 = 0"), ["ux", "cp"])


@query("ensemble_spread", sql(f"select case_id, {r('avg(v) as v_mean', 'stddev_pop(v) as v_std')} from (select case_id, ux as v "
    f"from points union all select case_id, p_ux from points) group by 1", "points"))
def _(s, d):
    p = views.points(s, d)
    return samples.ensemble(p.select("case_id", F.col("ux").alias("v")).unionByName(p.select("case_id", F.col("p_ux").alias("v"))), ["case_id"], ["v"])


@query("backfill_reynolds", sql(", m as (select case_id, 10.0 as u_ref, n_points as l_ref from pool), q as (select case_id, "
    "case when case_id % 9 = 0 then 11.0 else 10.0 end as u, 1e-5 as nu from pool where case_id % 10 <> 3), "
    "e as (select m.*, case when nu is null then 'no parameters' when abs(u - u_ref) > 1e-9 then 'velocity differs' end as error, "
    "nu from m left join q using (case_id)) select case_id, u_ref::double as u_ref, round(l_ref, "
    "6) + 0.0 as l_ref, error, case when error is null then round(log10(u_ref * l_ref / nu), 6) + 0.0 end as log10_re "
    "from e", "pool"))
def _(s, d):
    p = views.pool(s, d)
    m = p.select("case_id", F.lit(10.0).alias("u_ref"), F.col("n_points").alias("l_ref"))
    q = p.where("case_id % 10 <> 3").select("case_id", F.when(F.col("case_id") % 9 == 0, 11.0).otherwise(10.0).alias("u"), F.lit(1e-5).alias("nu"))
    return etl.backfill_reynolds(m, q)


@query("voxel_points", f"with {_GRID}, n as (select a.case_id, a.ix, a.iy, a.iz, min(sqrt(((a.ix + 0.5) * 0.5 - (b.ix + 0.5) * 0.5) ** 2 + ((a.iy + 0.5) * 0.5 - (b.iy + 0.5) * 0.5) ** 2 + ((a.iz + 0.5) * 0.5 - (b.iz + 0.5) * 0.5) ** 2)) as d "
    f"from g a left join g b on a.case_id = b.case_id and not b.fluid where a.fluid group by all) "
    f"select case_id, cast(ix as int) as ix, cast(iy as int) as iy, cast(iz as int) as iz, {r('(ix + 0.5) * 0.5 / 2 as x', '(iy + 0.5) * 0.5 / 2 as y', '(iz + 0.5) * 0.5 / 2 as z')}, "
    f"{r('greatest(least(d, (iz + 0.5) * 0.5 + 0.25) - 0.25, 0) / 2 as wall_dist')} from n")
def _(s, d):
    return etl.voxels_to_points(_grid(s, d), ["case_id"], 0.5, 2.0)


@query("voxel_points_all", f"with {_WHOLE_GRID}, n as (select a.case_id, a.part, a.ix, a.iy, a.iz, min(sqrt(((a.ix + 0.5) * 0.5 - (b.ix + 0.5) * 0.5) ** 2 + ((a.iy + 0.5) * 0.5 - (b.iy + 0.5) * 0.5) ** 2 + ((a.iz + 0.5) * 0.5 - (b.iz + 0.5) * 0.5) ** 2)) as d "
    f"from g a left join g b on a.case_id = b.case_id and a.part = b.part and not b.fluid where a.fluid "
    f"group by all) select case_id, cast(part as int) as part, cast(ix as int) as ix, cast(iy as int) as iy, "
    f"cast(iz as int) as iz, {r('(ix + 0.5) * 0.5 / 2 as x', '(iy + 0.5) * 0.5 / 2 as y', '(iz + 0.5) * 0.5 / 2 as z')}, "
    f"{r('greatest(least(d, (iz + 0.5) * 0.5 + 0.25) - 0.25, 0) / 2 as wall_dist')} from n")
def _(s, d):
    out = etl.voxels_to_points(_whole_grid(s, d), ["case_id", "part"], 0.5, 2.0)
    return out.select("case_id.*", *out.columns[1:])


@query("swap_partner", sql(", c as (select case_id, row_number() over (order by case_id) - 1 as i, count(*) over () as n "
    "from (select distinct case_id from points)) select a.case_id, b.case_id as partner from c a "
    "join c b on b.i = (a.i + 1) % a.n", "points"))
def _(s, d):
    return pool.next_case(views.points(s, d).select("case_id"))


# --- rules of cases, samples and manifests -----------------------------------------------------------------------
_ODD = {"x": "case when point_id % 97 = 0 and case_id = 3 then {nan} else x end", "cell_size": "case when case_id = 4 then null when point_id % 101 = 0 then {inf} else cell_size end", "k": "case when point_id % 5 = 0 then {nan} else k end", "p_cp": "case when point_id % 7 = 0 then null else p_cp end"}
_CASES = ("select distinct label as case_id, case when label = 5 then 0.0 when label = 6 then {nan} else 1.5 end as l_ref, "
    "10.0 as u_ref, label % 2 = 0 as k_there, label % 3 = 0 as cp_there from embeddings")


@query("case_problems", sql(", p as (select * replace (" + ", ".join(f"{e.format(nan=chr(39) + 'nan' + chr(39) + '::double', inf=chr(39) + 'inf' + chr(39) + '::double')} as {c}" for c, e in _ODD.items()) + ") from points), c as (" + _CASES.format(nan="'nan'::double") + """),
  b as (select case_id, count(*) filter (where isnan(x)) as points, count(*) filter (where isinf(cell_size)) as cell_size, count(*) filter (where isnan(k)) as k, count(*) filter (where p_cp is null) as p_cp from p group by 1),
  r as (select case_id, 'scales' as rule, 1 as n from c where not l_ref > 0 or isnan(l_ref) union all select case_id, 'points', points from b union all select case_id, 'cell_size', cell_size from b
    union all select case_id, 'fields', k from b join c using (case_id) where k_there union all select case_id, 'prior', p_cp from b join c using (case_id) where cp_there)
select case_id, rule, cast(n as bigint) as n from r where n > 0""", "points"))
def _(s, d):
    p = views.points(s, d).withColumns({c: F.expr(e.format(nan="double('nan')", inf="double('inf')")) for c, e in _ODD.items()})
    c = views.over(views.table(s, d, "embeddings"), "embeddings", _CASES.format(nan="double('nan')"))
    no = F.lit(False)
    return checks.case_problems(p, c.select("case_id", "l_ref", "u_ref", F.array(no, no, F.col("k_there"), no).alias("presence"), F.array(no, F.col("cp_there"), no, no).alias("prior_presence")))


@query("query_prior_problems", sql("""select case_id, case when case_id % 11 = 0 then 'another frame' when case_id % 4 = 0 then case when case_id % 8 = 0 then 'no prior' when case_id % 3 = 0 then 'other prior groups' end end as problem from pool
where case_id % 11 = 0 or case_id % 8 = 0 or (case_id % 4 = 0 and case_id % 3 = 0)""", "pool"))
def _(s, d):
    c = views.pool(s, d).select("case_id", F.lit(2.0).alias("l_ref"), F.lit(10.0).alias("u_ref"), (F.col("case_id") % 4 == 0).alias("has_prior"), F.array(*[F.lit(x) for x in (True, True, False, False)]).alias("prior_presence"))
    other = F.when(F.col("case_id") % 3 == 0, F.array(*[F.lit(x) for x in (True, False, False, False)])).otherwise(F.col("prior_presence"))
    q = c.withColumns({"l_ref": F.when(F.col("case_id") % 11 == 0, 2.001).otherwise(2.000001), "has_prior": F.col("case_id") % 8 != 0, "prior_presence": other})
    return checks.query_problems(c, q, F.lit(True))


_PAPERS = """select n_name as source, case when n_nationkey % 9 = 1 then 'solid' else 'none' end as solid_field, case when n_nationkey = 10 then 1.0 end as solid_value,
  case when n_nationkey = 2 then 'VERIFY: order' when n_nationkey = 3 then 'xyz' else 'vtk' end as stress_order, case when n_nationkey % 5 = 4 then 'static' else 'kinematic' end as pressure, case when n_nationkey < 15 then 1.2 end as rho, 0.0 as p_ref,
  case when n_nationkey = 5 then {zero} else {one} end as inflow_dir, case when n_nationkey % 2 = 0 then 1.5 when n_nationkey = 7 then -1.0 end as l_ref_value, case when n_nationkey in (1, 9) then 'x-extent' end as l_ref_rule,
  case when n_nationkey = 8 then null else 'bbox-centre-ground' end as origin_rule, case when n_nationkey = 12 then {point} end as origin_point, case when n_nationkey = 6 then 'high' when n_nationkey = 16 then '0.5' else 'none' end as ground from nation"""


@query("manifest_problems", "with m as (" + _PAPERS.format(zero="[0.0, 0.0, 0.0]", one="[1.0, 0.0, 0.0]", point="[1.0, 2.0, 3.0]") + """),
  a as (select *, list_filter([case when stress_order like '%VERIFY%' then 'stress_order: missing' end, case when l_ref_value is null and l_ref_rule is null then 'l_ref: missing' end, case when origin_point is null and origin_rule is null then 'origin: missing' end], lambda x: x is not null) as lack from m),
  b as (select *, list_filter([case when solid_field <> 'none' and solid_value is null then 'solid_mask: no solid value' end, case when stress_order not in ('vtk', 'foam', 'none') then 'stress_order: unknown' end, case when pressure = 'static' and rho is null then 'pressure: static needs rho and p_ref' end,
    case when inflow_dir[1] = 0 then 'inflow_dir: a non-zero 3-vector' end, case when l_ref_value <= 0 then 'l_ref: a length or x-extent' when source = 'INDONESIA' and l_ref_value is null then 'l_ref: this source needs a length' end, case when ground = 'high' then 'ground_z: a height or none' end], lambda x: x is not null) as bad from a)
select source, array_to_string(case when len(lack) > 0 then lack else bad end, '; ') as problems from b""")
def _(s, d):
    papers = _PAPERS.format(zero="array(0.0D, 0.0D, 0.0D)", one="array(1.0D, 0.0D, 0.0D)", point="array(1.0D, 2.0D, 3.0D)")
    m = views.over(views.table(s, d, "nation"), "nation", papers)
    return checks.manifest_problems(m, ("INDONESIA",)).select("source", F.array_join("problems", "; ").alias("problems"))


@query("reference_frames", sql(", b as (select case_id, min(x) as lox, max(x) as hix, min(y) as loy, max(y) as hiy, min(z) as loz from points group by 1) select case_id, " + r("case when case_id % 2 = 0 then 3.0 else hix - lox end as l_ref", "case when case_id = 3 then 1.0 else (lox + hix) / 2 end as ox", "case when case_id = 3 then 2.0 else (loy + hiy) / 2 end as oy", "case when case_id = 3 then 3.0 when case_id % 4 = 0 then 0.25 else loz end as oz") + " from b", "points"))
def _(s, d):
    b = views.points(s, d).groupBy("case_id").agg(*[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"]).withColumn("source", F.col("case_id").cast("string"))
    m = b.select("source", F.when(F.col("case_id") % 2 == 0, 3.0).alias("l_ref_value"), F.when(F.col("case_id") == 3, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("origin_point"), F.when(F.col("case_id") % 4 == 0, "0.25").otherwise("none").alias("ground"))
    return checks.reference_frames(b, m).drop("source")


@query("physical_points", sql("select case_id, point_id, " + r("x * 2.5 + case_id as si_x", "y * 2.5 - 1 as si_y", "case when case_id <> 4 then z * 2.5 end as si_z") + " from points", "points"))
def _(s, d):
    at = fields.physical_points(F.lit(2.5), [F.col("case_id"), F.lit(-1.0), F.when(F.col("case_id") != 4, F.lit(0.0))])
    return views.points(s, d).select("case_id", "point_id", *[c.alias(n) for n, c in at.items()])


@query("standardise_channels", sql(", m as (select avg(ux) as a, stddev_pop(ux) + 1e-6 as b, avg(cp) as c, stddev_pop(cp) + 1e-6 as e from points) select case_id, point_id, " + r("(ux - a) / b as ux", "(cp - c) / e as cp", "ux as ux_back") + " from points, m", "points"))
def _(s, d):
    p = views.points(s, d)
    stats = metrics.channel_stats(p, rotation_invariant=False)
    there = fields.standardise(p, stats, ("ux", "cp"))
    back = fields.standardise(there, stats, ("ux",), back=True).select("case_id", "point_id", F.col("ux").alias("ux_back"))
    return there.select("case_id", "point_id", "ux", "cp").join(back, ["case_id", "point_id"])


@query("evaluation_steps", "select cast(i as bigint) as step, i % 12 <> 5 and (i % 10 = 0 or i = 57) as evaluate from (select event_id % 60 as i from events)")
def _(s, d):
    step = F.col("event_id") % 60
    return views.table(s, d, "events").select(step.alias("step"), fields.should_evaluate(step, 10, step == 57, step % 12 == 5).alias("evaluate"))


@query("pool_of_sources", sql(_MAN + " select case_id, source, split, shard from u where source in ('1-URGENT', '2-HIGH')", "pool"))
def _(s, d):
    wanted = s.createDataFrame([("1-URGENT",), ("2-HIGH",), ("2-HIGH",)], "source string")
    return pool.of_sources(_manifests(s, d), wanted).select("case_id", "source", "split", "shard")


# --- large cases: the grid of the neighbours, and Arrow folds ----------------------------------------------------
_LINES = ("select l_returnflag || l_linestatus as case_id, row_number() over (order by l_orderkey, l_linenumber, "
    "l_partkey, l_suppkey, l_extendedprice, l_quantity) as id, l_quantity / 50 as x, l_discount * 10 as y, "
    "l_extendedprice / 50000 as z from lineitem")


def _line_points(s, d):
    """The lines that ask or are asked for, of all as points: clustered on planes of discount and quantity. They are numbered by ranges
    of the order's first column, each after the number of lines before it, and written, so that both sides have the same numbers."""
    lines = views.table(s, d, "lineitem")
    n = _tasks(lines)
    ends = sorted(set(lines.approxQuantile("l_orderkey", [i / n for i in range(1, n)], 0.2 / n if lines.count() else 0.1) or [0.0]))
    ranged = Bucketizer(splits=[-float("inf"), *ends, float("inf")], inputCol="at", outputCol="range", handleInvalid="keep").transform(lines.withColumn("at", F.col("l_orderkey").cast("double")))
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("range", (F.sum("c").over(Window.orderBy("range")) - F.col("c")).alias("base"))  # a row a range
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    number = F.col("base") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    p = ranged.repartition(n, "range").join(F.broadcast(before), "range").withColumn("id", number).where("id % 10 = 0 or id % 25 = 0")
    return cut(p.selectExpr("l_returnflag || l_linestatus as case_id", "id", "cast(l_quantity / 50 as double) as x", "cast(l_discount * 10 as double) as y", "cast(l_extendedprice / 50000 as double) as z"), "lines")


@query("knn_large", f"with p as ({_LINES}), n as (select a.case_id, a.id as point_id, b.id as ref_id, {_D2} as d2, "
    f"row_number() over (partition by a.case_id, a.id order by {_D2}, b.id) as rank from p a join p b on a.case_id = b.case_id "
    f"and b.id % 10 = 0 where a.id % 25 = 0) select case_id, point_id, cast(rank as int) as rank, "
    f"ref_id, round(sqrt(d2), 6) + 0.0 as dist from n where rank <= 3")
def _(s, d):
    p = _line_points(s, d)
    # The stated query points; every line is in the references' table or beside it.
    asked = p.where("id % 25 = 0").withColumnRenamed("id", "point_id")
    return spatial.knn(asked, p.where("id % 10 = 0").withColumnRenamed("id", "ref_id"), 3).select("case_id", "point_id", "rank", "ref_id", F.sqrt("d2").alias("dist"))


# --- read-outs ---------------------------------------------------------------------------------------------------
@query("readout_table")
def _(s, d):
    p = views.points(s, d)
    names = ["near_share", "mean_z", "std_z", "q90_z", "extent_x", "extent_y"]
    shapes = {"geometry": (metrics.case_features(p, ["case_id"]), names), "extents": (metrics.case_features(p, ["case_id"]), names[4:])}
    return retrieval.readout(shapes, metrics.case_targets(p, ["case_id"]), "case_id", ["street_speed", "wall_cp", "mean_k"], tuple(10.0**k for k in range(-3, 8)), 200)


# --- what a network reads ----------------------------------------------------------------------------------------
_RNG = {c: f"case when case_id % 2 = 0 then {e} else 0 end as {c}" for c, e in _ENC.items()}


@query("network_rows", sql("select case_id, point_id, " + r(_RNG["ux"].replace("case_id % 2 = 0", "case_id % 5 <> 0"), _RNG["k"], "case when case_id % 2 = 0 and case_id % 3 = 0 then p_cp else 0 end as p_cp", "case when point_id % 4 = 0 then 1.0 else cell_size end as cell_size", "case when point_id % 4 = 0 then 0.0 else 1.0 end as cs_flag") + " from points", "points"))
def _(s, d):
    p = views.points(s, d).withColumns({"cell_size": F.when(F.col("point_id") % 4 != 0, F.col("cell_size")), "ux": F.when(F.col("case_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("ux"))})
    even, yes = F.col("case_id") % 2 == 0, F.lit(True)
    c = p.select("case_id").distinct().select("case_id", F.array(F.col("case_id") % 5 != 0, yes, even, yes).alias("presence"), F.when(F.col("case_id") % 3 == 0, F.array(yes, yes, yes, yes)).alias("prior_presence"))
    return batches.network_rows(p, c, even).select("case_id", "point_id", "ux", "k", "p_cp", "cell_size", "cs_flag")


@query("padded_tokens", sql(_TOK + ", e as (select case_id, scale, step, point_id, count(*) as n, max(dist) as r_eff from t group by all), "
    "g as (select case_id, unnest(range(8)) as slot from (select distinct case_id from points)) "
    "select g.case_id, cast(slot as int) as slot, n is not null as valid, coalesce(point_id, 0) as centre_id, "
    "round(coalesce(r_eff, 1.0), 6) + 0.0 as r_eff from g left join e on g.case_id = e.case_id "
    "and e.scale = 0 and e.step = slot", "points", recursive=True))
def _(s, d):
    tokens_of = _groups(s, d).where("scale = 0").select("case_id", F.col("token").cast("int").alias("slot"), "centre_id", "r_eff").distinct()
    return batches.pad(tokens_of, ["case_id"], "slot", 8, {"centre_id": 0, "r_eff": 1.0})


@query("epoch_batches", sql(f", e as ({_EPOCH}) select case_id, pos // 16 as batch, cast(pos % 16 as int) as row from e", "pool"))
def _(s, d):
    return batches.collate(sampling.epoch_order(views.pool(s, d), 7, 2), 16)


@query("voxel_channels", sql("select case_id, point_id, " + r("2 * cp as cp", "exp(greatest(uy, 0)) - 1 as k", "(exp(greatest(uz, 0)) - 1) * 0.75 as eps") + " from points", "points"))
def _(s, d):
    c = batches.voxel_channels([F.col(x) for x in ("ux", "uy", "uz", "cp", "uy", "uz")], F.lit(1.5), F.lit(2.0))
    return views.points(s, d).select("case_id", "point_id", c[3].alias("cp"), c[4].alias("k"), c[5].alias("eps"))


_TURN = f"{_unit_sql(chr(39) + '4' + chr(39), chr(39) + '1' + chr(39), chr(39) + '2' + chr(39), chr(39) + 'turn' + chr(39), 'case_id')} * 2 * pi()"
_SIDE = f"case when {_unit_sql(chr(39) + '4' + chr(39), chr(39) + '1' + chr(39), chr(39) + '2' + chr(39), chr(39) + 'mirror' + chr(39), 'case_id')} < 0.5 then -1 else 1 end"


@query("augmented_points", sql(f", a as (select *, case when case_id % 3 > 0 then {_TURN} else 0 end as t, {_SIDE} as m from points) select case_id, point_id, " + r("x * cos(t) - y * sin(t) as x", "m * (x * sin(t) + y * cos(t)) as y", "m * (p_ux * sin(t) + p_uy * cos(t)) as p_uy", "z") + " from a", "points"))
def _(s, d):
    p = views.points(s, d)
    out = samples.augment(p, p.select("case_id").distinct().withColumn("rotation_ok", F.col("case_id") % 3 > 0), 4, 1, 2)
    return out.select("case_id", "point_id", "x", "y", "p_uy", "z")


from . import queries_model  # noqa: E402, F401  adds its queries to the two tables above
