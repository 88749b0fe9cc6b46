"""Nested dictionary files of solver cases as a table of entries, read by window functions over their tokens.

    name { type wall; value uniform (0 0 1); inner { a 1; } }

A text is cut into tokens (quoted strings, brackets, semicolons, words) behind its comments. Running sums of the braces give each
token its depth; the word before an opening brace names what it opens, so the last such word of each depth is a token's
path; what stands between two ends (a brace or a semicolon) is an entry: its first word is the key, the rest the value.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Nesting up to which paths are told; deeper text is an error row.
DEPTH = 8
_TOKEN = r'"(?:[^"\\]|\\.)*"|[{};()\[\]]|[^\s{};()\[\]"]+'
_COMMENT = r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*(?s:.*?)\*/'


def entries(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, place (the entry's number), path (array of the names around it), key, value (null where there is none), error.

    A text whose braces do not match, that ends within an entry or is nested deeper than DEPTH has one row with an error and
    no entries. A null or blank text has none. Brackets of a list around the entries, and its count, are no part of them.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), _COMMENT, "$1")
    tokens = texts.select(*keys, F.posexplode(F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(0))).alias("at", "token"))
    order = Window.partitionBy(*keys).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens, closes = F.col("token") == "{", F.col("token") == "}"
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    ends = opens | closes | (F.col("token") == ";")
    d = tokens.withColumns({"depth": F.coalesce(F.sum(step).over(before), F.lit(0)), "after": F.sum(step).over(upto), "entry": F.coalesce(F.sum(ends.cast("long")).over(before), F.lit(0)), "last": F.lag("token").over(order)})
    # The name that an opening brace at depth k has, for all that follows until the next one there.
    d = d.withColumns({f"n{k}": F.last(F.when(opens & (F.col("depth") == k), F.col("last")), ignorenulls=True).over(before) for k in range(DEPTH)})
    words = F.col("token").isin("{", "}", ";")
    group = d.groupBy(*keys, "entry").agg(
        F.min("at").alias("at"), F.max_by("token", "at").alias("end"), F.max("depth").alias("depth"), F.max("after").alias("after"), F.min("after").alias("least"),
        F.transform(F.sort_array(F.collect_list(F.when(~words, F.struct("at", "token")))), lambda x: x["token"]).alias("words"), *[F.first(f"n{k}").alias(f"n{k}") for k in range(DEPTH)])
    case = Window.partitionBy(*keys)
    final = F.max_by("after", "at").over(case)
    error = F.when(F.min("least").over(case) < 0, "a brace too many").when(final != 0, "a brace is open").when(F.max("depth").over(case) > DEPTH, f"deeper than {DEPTH}").when(F.max_by("end", "at").over(case).isin(";", "}") | (F.max_by("rest", "at").over(case) == 0), None).otherwise("text after the last entry")
    group = group.withColumn("rest", F.size(F.filter("words", lambda x: ~x.isin(")", "]"))))
    d = group.withColumns({"error": error, "first": F.min("at").over(case)})
    path = F.slice(F.array(*[f"n{k}" for k in range(DEPTH)]), 1, F.col("depth"))
    value = _joined(F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))))
    good = d.where(F.col("error").isNull() & (F.col("end") == ";") & (F.size("words") > 0))
    rows = good.select(*keys, F.row_number().over(case.orderBy("at")).alias("place"), path.alias("path"), F.element_at("words", 1).alias("key"), F.when(F.size("words") > 1, value).alias("value"), F.lit(None).cast("string").alias("error"))
    bad = d.where(F.col("error").isNotNull() & (F.col("at") == F.col("first"))).select(*keys, F.lit(None).cast("int").alias("place"), F.lit(None).cast("array<string>").alias("path"), *[F.lit(None).cast("string").alias(c) for c in ("key", "value")], "error")
    return rows.unionByName(bad)


def _joined(words: Column) -> Column:
    """Words with one space between them, none inside of brackets, and quotes around a value taken off."""
    text = F.array_join(words, " ")
    tight = reduce(lambda t, x: F.regexp_replace(t, *x), [(r"([(\[]) ", "$1"), (r" ([)\]])", "$1")], text)
    return F.regexp_replace(tight, r'^"([^"]*)"$', "$1")


def read(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, place, path of names, key, value, error of every file of this name below root; files of this kind are small."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return entries(files, ["file"])


def patch_types(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, patch, type of a boundary file's entries; patches between processors do not count."""
    patch = F.element_at("path", -1)
    return found.where("error is null and key = 'type' and size(path) = 1").where(~patch.startswith("procBoundary")).select(*keys, patch.alias("patch"), F.col("value").alias("type"))


def vocabulary_problems(rows: DataFrame, keys: list[str], vocabularies: dict[str, tuple[str, ...]]) -> DataFrame:
    """keys, column, value of what lies outside a closed vocabulary; null is none of its words."""
    told = F.explode(F.array(*[F.when(~F.coalesce(F.col(c).isin(*words), F.lit(False)), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c, words in vocabularies.items()])).alias("x")
    return rows.select(*keys, told).where("x is not null").select(*keys, "x.*")


def manifests(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row a file in the form of checks.manifest_problems, from a source's manifest as a dictionary."""
    name = F.array_join(F.concat("path", F.array("key")), ".")
    d = found.where("error is null").select(*keys, name.alias("name"), "value").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    get = lambda n: F.try_element_at("m", F.lit(n))
    number = lambda n: get(n).try_cast("double")
    vector = lambda n: F.when(get(n).isNotNull(), F.transform(F.split(F.trim(F.regexp_replace(get(n), r"[()\[\]]", " ")), r"\s+"), lambda x: x.try_cast("double")))
    return d.select(
        *keys, get("source").alias("source"), F.coalesce(get("solid_mask.field"), get("solid_mask")).alias("solid_field"), get("solid_mask.solid_value").alias("solid_value"), get("stress_order").alias("stress_order"),
        get("pressure.convention").alias("pressure"), number("pressure.rho").alias("rho"), number("pressure.p_ref").alias("p_ref"), vector("inflow_dir").alias("inflow_dir"), number("L_ref.value").alias("l_ref_value"), get("L_ref.rule").alias("l_ref_rule"),
        get("origin.rule").alias("origin_rule"), vector("origin.point").alias("origin_point"), get("ground_z").alias("ground"), get("licence").alias("licence"), get("verified_run").alias("verified_run"))
