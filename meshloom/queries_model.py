"""Queries over the pieces of the representation model, and of pools, monitors and dictionaries, that were added after queries.py."""
from __future__ import annotations

from pyspark.sql import functions as F

from .operators import attention, batches, graph, pool, tokens
from .plans import views
from .plans.views import sql
from .queries import _TOK, _groups, query, r
from .sources import dictionary, text

# --- rotary positions over three axes: 14 values, two pairs an axis, two that pass ---------------------------------
_SHORTEST, _LONGEST = 0.05, 20.0


def _rotary_sql(v: str, position: tuple[str, ...], size: int) -> list[str]:
    n = size // 6
    out = []
    for k in range(3 * n):
        angle = f"({position[k // n]} * 2 * pi() / ({_SHORTEST} * power({_LONGEST / _SHORTEST}, {k % n} / {max(1, n - 1)})))"
        a, b = f"{v}[{2 * k + 1}]", f"{v}[{2 * k + 2}]"
        out += [f"{a} * cos{angle} - {b} * sin{angle}", f"{a} * sin{angle} + {b} * cos{angle}"]
    return out + [f"{v}[{i + 1}]" for i in range(6 * n, size)]


@query("rotary_three_axes", sql(", v as (select p.*, list_transform(e.embedding[1:14], lambda x: x::double) as v from points p join embeddings e on e.vec_id = p.point_id) "
    "select case_id, point_id, " + r(*[f"{x} as r{i}" for i, x in enumerate(_rotary_sql("v", ("x", "y", "z"), 14))]) + " from v", "points"))
def _(s, d):
    e = views.table(s, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.slice("embedding", 1, 14).cast("array<double>").alias("v"))
    out = views.points(s, d).join(e, "point_id").select("case_id", "point_id", attention.rotary_axes(F.col("v"), [F.col(c) for c in "xyz"], 14, _SHORTEST, _LONGEST).alias("r"))
    return out.select("case_id", "point_id", *[F.col("r")[i].alias(f"r{i}") for i in range(14)])


# --- attention with rotary positions, all points of a case as keys ---------------------------------------------------
def _turned_sql(at: int) -> str:
    return "[" + ", ".join(_rotary_sql(f"list_transform(e.embedding[{at}:{at + 7}], lambda x: x::double * 3)", ("p.x", "p.y", "p.z"), 8)) + "]"


@query("attention_rotary", sql(f", v as (select p.case_id, p.point_id, {_turned_sql(1)} as q, {_turned_sql(9)} as k, list_transform(e.embedding[17:24], lambda x: x::double) as v, p.wall_dist "
    "from points p join embeddings e on e.vec_id = p.point_id), s as (select a.case_id, a.point_id as query_id, b.v, list_dot_product(a.q, b.k) / sqrt(8) as s from v a join v b on a.case_id = b.case_id and b.wall_dist < 1.0), "
    "e as (select *, exp(s - max(s) over (partition by case_id, query_id)) as e from s) select case_id, query_id, " + r(*[f"sum(e * v[{i + 1}]) / sum(e) as o{i}" for i in range(8)]) + " from e group by all", "points"))
def _(s, d):
    part = lambda at, scale: F.transform(F.slice("embedding", at, 8), lambda x: x.cast("double") * scale)
    e = views.table(s, d, "embeddings").select(F.col("vec_id").alias("point_id"), part(1, 3.0).alias("q"), part(9, 3.0).alias("k"), part(17, 1.0).alias("v"))
    turned = lambda c: attention.rotary_axes(F.col(c), [F.col(a) for a in "xyz"], 8, _SHORTEST, _LONGEST).alias(c)
    points = views.points(s, d).select("case_id", "point_id", "x", "y", "z", "wall_dist")
    rows = points.join(e, "point_id").select("case_id", "point_id", turned("q"), turned("k"), "v", (F.col("wall_dist") < 1.0).alias("valid"))
    return attention.attention(rows.withColumnRenamed("point_id", "query_id"), rows.withColumnRenamed("point_id", "key_id"), "case_id", 8)


# --- tokens as the encoder takes them in -----------------------------------------------------------------------------
_FEATURES = ("wall_dist", "nx", "ny", "nz", "ux", "uy", "uz", "cp")
_VALID = "wall_dist < 1.5"


@query("token_assembly", sql(_TOK + ", g as (select t.case_id, t.scale, t.step as token, case when t.scale = 0 then 0.5 else 2.0 end as radius, max(t.dist) over (partition by t.case_id, t.scale, t.step) as reach, "
    "(b.x - a.x) / case when t.scale = 0 then 0.5 else 2.0 end as rx, (b.y - a.y) / case when t.scale = 0 then 0.5 else 2.0 end as ry, (b.z - a.z) / case when t.scale = 0 then 0.5 else 2.0 end as rz, "
    + ", ".join(f"b.{c}" for c in _FEATURES) + " from t join points a on a.case_id = t.case_id and a.point_id = t.point_id join points b on b.case_id = t.case_id and b.point_id = t.ref_id) "
    f"select case_id, cast(scale as int) as scale, cast(token as int) as token, count(*) filter (where {_VALID}) as n_valid, {r('ln(any_value(radius)) as log_radius', 'ln(greatest(any_value(reach), 1e-4)) as log_reach')}, "
    + r(*[f"coalesce(max({c}) filter (where {_VALID}), 0.0) as {c}" for c in ("rx", "ry", "rz", *_FEATURES)]) + " from g group by case_id, scale, token", "points", recursive=True))
def _(s, d):
    points, groups = views.points(s, d), _groups(s, d)
    rows = tokens.assemble(groups, points, {c: F.col(c) for c in _FEATURES})
    return tokens.pooled(rows, groups, ["rx", "ry", "rz", *_FEATURES], F.col("wall_dist") < 1.5)


# --- pools ---------------------------------------------------------------------------------------------------------
_HEX6 = "('0x' || substr(md5(case_id::varchar), 1, 6))::bigint"


@query("pool_fingerprint_tree", sql(f", l as (select {_HEX6} as b, 0 as k, sha256(concat_ws(',', case_id, source, split, shard)) as d from pool), "
    "a as (select b, count(*) as n, sha256(string_agg(d, '' order by d)) as d from l group by b), c as (select b // 256 as b, sum(n) as n, sha256(string_agg(d, '' order by b)) as d from a group by 1), "
    "e as (select b // 256 as b, sum(n) as n, sha256(string_agg(d, '' order by b)) as d from c group by 1) "
    "select sha256(string_agg(d, '' order by b)) as fingerprint, cast(sum(n) as bigint) as n from e", "pool"))
def _(s, d):
    return pool.fingerprint_tree(views.pool(s, d))


# --- monitors of restarted runs: paths of files, and the series that they make together ------------------------------
_PATHS = ("select user_id as run_id, concat('/runs/', cast(user_id as {s}), '/postProcessing/', event_type, '/', case event_id % 4 when 0 then '0' when 1 then '100' when 2 then '2e1' else 'old' end, "
          "case when event_id % 7 = 0 then '/other.dat' else '/forces.dat' end) as path, event_id, value from events")
_FOUND_SQL = ("with p as (" + _PATHS.format(s="varchar") + r"), f as (select *, regexp_extract(path, '/runs/([^/]+)/postProcessing/([^/]+)/([^/]+)/([^/]+)$', ['c', 'm', 's', 'f']) as x from p), "
              "g as (select x.c as case_id, x.m as monitor, try_cast(x.s as double) as start, path, event_id, value from f where x.f = 'forces.dat' and try_cast(x.s as double) is not null)")


@query("monitor_files", _FOUND_SQL + ", h as (select distinct case_id, monitor, start, path from g) select case_id, monitor, cast(row_number() over (partition by case_id, monitor order by start, path) as int) as nth, " + r("start")
    + ", lead(start) over (partition by case_id, monitor order by start, path) as next_start, path from h")
def _(s, d):
    return text.monitor_files(views.over(views.table(s, d, "events"), "events", _PATHS.format(s="string")).select("path"), "forces.dat")


@query("monitor_series", _FOUND_SQL + f", w as (select case_id, monitor, event_id % 50 as it, arg_max(value, (start, path, event_id)) as value, arg_max(start, (start, path, event_id)) as start from g group by all) select case_id, monitor, {r('it', 'value', 'start')} from w")
def _(s, d):
    rows = views.over(views.table(s, d, "events"), "events", _PATHS.format(s="string"))
    records = rows.select("path", F.col("event_id").alias("line"), (F.col("event_id") % 50).cast("double").alias("it"), "value")
    return text.resolved(text.monitor_files(rows.select("path"), "forces.dat"), records)


# --- dictionaries: a text for each region, of its nations, read back into entries --------------------------------------
_DICT_SQL = """
with n as (select n_regionkey, n_nationkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation),
e as (select n_regionkey, (k - 1) * 3 + 1 as place, [n_name] as path, 'type' as key, case when n_nationkey % 3 = 0 then 'wall' else 'patch' end as value from n
  union all select n_regionkey, (k - 1) * 3 + 2, [n_name, 'inner'], 'at', '(' || n_nationkey || ' 0 1)' from n
  union all select n_regionkey, (k - 1) * 3 + 3, [n_name], 'label', 'a; // {b}' from n)
select n_regionkey, cast(place as int) as place, array_to_string(path, '/') as path, key, value from e
"""


def _dictionaries(s, d):
    one = F.concat(F.lit("  "), F.col("n_name_"), F.lit("\n  {\n type "), F.when(F.col("n_nationkey") % 3 == 0, "wall").otherwise("patch"), F.lit("; // kind {\n inner{at ( "), F.col("n_nationkey").cast("string"), F.lit(' 0 1 );}\n label "a; // {b}"; /* ; } */ }\n'))
    n = views.table(s, d, "nation").withColumn("n_name_", F.regexp_replace("n_name", " ", "_"))
    texts = n.groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", one.alias("one")))), lambda x: x["one"]).alias("all"))
    return texts.select("n_regionkey", F.concat(F.size("all").cast("string"), F.lit("\n(\n"), F.array_join("all", ""), F.lit(")\n// end {\n")).alias("text"))


@query("dictionary_entries", _DICT_SQL.replace("n_name,", "replace(n_name, ' ', '_') as n_name,", 1))
def _(s, d):
    found = dictionary.entries(_dictionaries(s, d), ["n_regionkey"])
    return found.where("error is null").select("n_regionkey", "place", F.array_join("path", "/").alias("path"), "key", "value")


@query("patch_types", "select n_regionkey, replace(n_name, ' ', '_') as patch, case when n_nationkey % 3 = 0 then 'wall' else 'patch' end as type from nation")
def _(s, d):
    return dictionary.patch_types(dictionary.entries(_dictionaries(s, d), ["n_regionkey"]), ["n_regionkey"])


@query("strip_targets", sql("select case_id, point_id, " + r("x", "cp") .replace("round(cp, 6) + 0.0", "cast(null as double)") + " from points", "points"))
def _(s, d):
    p = views.points(s, d).select("case_id", "point_id", "x", "cp")
    return batches.strip_targets(p, p.select("case_id").distinct())[0]


# --- files of solver cases, from made paths ---------------------------------------------------------------------------
_CASE_PATHS = ("select concat('/runs/c', cast(user_id as {s}), case when event_id % 5 = 0 then '/processor1' else '' end, '/', "
               "case event_id % 6 when 0 then '0' when 1 then '50' when 2 then 'system' when 3 then '1.5e2' when 4 then 'constant' else 'notes' end, '/', "
               "case event_id % 7 when 0 then 'U' when 1 then 'p' when 2 then 'C' when 3 then 'phi' when 4 then 'polyMesh/points' else event_type end) as path, event_id as length from events")
_FILES_SQL = ("with p as (" + _CASE_PATHS.format(s="varchar") + "), q as (select path, length, string_split(substr(path, 7), '/') as x from p), "
              "f as (select path, length, x[1] as case_id, case when x[2] = 'processor1' then x[2] end as part, case when x[2] = 'processor1' then x[3:] else x[2:] end as y from q), "
              "g as (select path, length, case_id, part, y[1] as folder, array_to_string(y[2:], '/') as file, try_cast(y[1] as double) as time from f)")


def _case_files(s, d):
    return text.split_paths(views.over(views.table(s, d, "events"), "events", _CASE_PATHS.format(s="string")), "/runs")


@query("time_folders", _FILES_SQL + " select distinct case_id, part, folder from g where time is not null and time <> 0")
def _(s, d):
    return text.time_folders(_case_files(s, d))


@query("latest_time", _FILES_SQL + f" select case_id, arg_max(folder, time) as folder, {r('max(time) as time')} from g where time is not null and part is null group by 1")
def _(s, d):
    return text.latest_time(_case_files(s, d))


@query("case_entries", _FILES_SQL + " select case_id, folder || '/' || file as entry, path, length from g where part is null and (folder in ('constant', 'system') "
    "or (folder = '0' and not contains(file, '/') and file not in ('C', 'Ccx', 'Ccy', 'Ccz', 'Vc', 'phi', 'Phi')))")
def _(s, d):
    return text.case_entries(_case_files(s, d))


# --- closed vocabularies, and surfaces whose triangles were turned at random -------------------------------------------
@query("vocabulary_problems", "select o_orderkey, 'status' as column, o_orderstatus as value from orders where o_orderstatus not in ('F', 'O') "
    "union all select o_orderkey, 'priority', case when o_orderkey % 10 <> 0 then o_orderpriority end from orders where o_orderkey % 10 = 0 or o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')")
def _(s, d):
    rows = views.table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")).alias("priority"))
    return dictionary.vocabulary_problems(rows, ["o_orderkey"], {"status": ("F", "O"), "priority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")})


# Four corners a customer; the faces of the tetrahedron, outward, of which a hash turns some.
_CORNERS = ("0 0 0", "1 0 0", "0 1 0", "0 0 1")
_OUTWARD = ((0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3))


@query("surface_orientation", "select c_nationkey as case_id, c_custkey * 4 + f as face_id, substr(md5((c_custkey * 4 + f)::varchar), 1, 1) < '6' as flip, true as closed, true as orientable from customer, range(4) t(f)")
def _(s, d):
    c = views.table(s, d, "customer").select(F.col("c_nationkey").alias("case_id"), "c_custkey", F.posexplode(F.array(*[F.array(*map(F.lit, f)) for f in _OUTWARD])).alias("f", "p"))
    c = c.withColumn("face_id", F.col("c_custkey") * 4 + F.col("f"))
    turned = F.substring(F.md5(F.col("face_id").cast("string")), 1, 1) < "6"
    corner = lambda k: F.when(turned, F.col("p")[(0, 2, 1)[k]]).otherwise(F.col("p")[k])
    base = {"x": F.col("c_custkey") * 3.0, "y": F.lit(0.0), "z": F.lit(0.0)}
    at = lambda axis, k: base[axis] + F.element_at(F.array(*[F.lit(float(p.split()["xyz".index(axis)])) for p in _CORNERS]), corner(k) + 1)
    faces = c.select("case_id", "face_id", *[at(a, k).alias(f"{a}{k}") for k in range(3) for a in "xyz"])
    return graph.orientations(faces).drop("component")
