"""Case pools: union of manifests, fail-closed validation, fingerprints and splits."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F




class PoolError(ValueError):
    """All violations of a pool together."""


#: Columns that every manifest needs.
NEEDED = ("case_id", "source", "split", "shard")


def union(manifests: dict[str, DataFrame]) -> DataFrame:
    """Manifests by name as one table with a column `manifest`; rows with an error are left out. A manifest that lacks a
    needed column, and no manifest at all, raise PoolError."""
    lacking = [f"{n}: no {', '.join(c for c in NEEDED if c not in m.columns)}" for n, m in manifests.items() if not set(NEEDED) <= set(m.columns)]
    if lacking or not manifests:
        raise PoolError("; ".join(lacking) or "no manifests")
    named = [m.withColumn("manifest", F.lit(n)) for n, m in manifests.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return out.where(F.col("error").isNull()) if "error" in out.columns else out


def duplicates(pool: DataFrame) -> DataFrame:
    return pool.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def family_leaks(pool: DataFrame) -> DataFrame:
    """Families with cases in more than one split; cases without a family do not count."""
    return pool.where(F.col("family").isNotNull()).groupBy("family").agg(F.count_distinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n")).where("n_splits > 1")


def absent_sources(pool: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(pool.select("source").distinct(), "source", "left_anti")


def held_out(pool: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows of sources that must not be there."""
    return pool.join(excluded, "source", "left_semi")


def of_sources(pool: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """The rows of the wanted sources, or all."""
    return pool if wanted is None else pool.join(wanted.select("source").distinct(), "source", "left_semi").select(pool.columns)


def violations(pool: DataFrame, wanted: DataFrame, excluded: DataFrame, native: tuple[str, ...] = ()) -> DataFrame:
    """rule, n for every rule, 0 where it holds. Cases, families and sources are counted apart, each from its own columns and
    combined before its shuffle, so only the cases' ids move as rows; the few rows of sources meet the lists of sources."""
    validated = F.coalesce(F.col("validated"), F.lit(False)) if "validated" in pool.columns else F.lit(True)
    cases = pool.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    sources = pool.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("source").isin(list(native)) & ~validated).alias("doubtful"))
    listed = lambda t: t.select("source").distinct()
    found = {
        "duplicate_case": cases.agg(F.count_if(F.col("n") > 1).alias("n")),
        "absent_source": listed(wanted).join(sources, "source", "left_anti").agg(F.count(F.lit(1)).alias("n")),
        "held_out_source": sources.join(listed(excluded), "source", "left_semi").agg(F.sum("n").alias("n")),
    }
    if "family" in pool.columns:
        families = pool.where(F.col("family").isNotNull()).groupBy("family").agg(F.min("split").alias("a"), F.max("split").alias("z"))
        found["family_in_splits"] = families.agg(F.count_if(F.col("a") < F.col("z")).alias("n"))
    else:
        found["family_in_splits"] = cases.limit(0).agg(F.count(F.lit(1)).alias("n"))
    if "validated" in pool.columns:
        found["not_validated"] = sources.agg(F.sum("doubtful").alias("n"))
    return reduce(lambda x, y: x.unionByName(y), [d.select(F.lit(rule).alias("rule"), F.coalesce("n", F.lit(0)).cast("long").alias("n")) for rule, d in found.items()])


def require(pool: DataFrame, wanted: DataFrame, excluded: DataFrame, native: tuple[str, ...] = ()) -> DataFrame:
    """The pool, ordered by shard, or PoolError with every broken rule. The check runs now, not lazily."""
    broken = violations(pool, wanted, excluded, native).where("n > 0").collect()  # one row per rule
    if broken:
        raise PoolError("; ".join(f"{r.rule}: {r.n}" for r in broken))
    return pool.orderBy("shard")


def fingerprint(pool: DataFrame) -> DataFrame:
    """SHA-256 over the pool: cases are digested in 256 buckets by case_id, then the buckets' digests in order. A bucket is one task's
    row, so this is for pools of up to some 25 million cases; fingerprint_tree is for any."""
    line = F.concat_ws(",", "case_id", "source", "split", "shard")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("case_id", line.alias("line")))), lambda x: x["line"])
    parts = pool.groupBy(F.pmod("case_id", F.lit(256)).alias("b")).agg(F.sha2(F.array_join(rows, "\n").cast("binary"), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n").cast("binary"), 256).alias("fingerprint"), F.sum("n").alias("n"))


#: Buckets of the fingerprint's tree, level by level from the root: always the same, so its value does not depend on the pool's size
#: or its partitions. The last level has 16 ** 6 buckets, of some thousand cases each at ten billion.
TREE = (16**2, 16**4, 16**6)


def fingerprint_tree(pool: DataFrame) -> DataFrame:
    """SHA-256 over the pool as a tree: a case's line is digested, cases are dealt to fixed buckets by the digest of their id, a
    bucket's digests in order are digested, and so on over the levels of TREE; buckets without cases count as absent. The digest
    of a part can be kept and merged: a changed case changes its bucket and the three digests above."""
    line = F.concat_ws(",", "case_id", "source", "split", "shard")
    key = F.conv(F.substring(F.md5(F.col("case_id").cast("string")), 1, 6), 16, 10).cast("long")
    level = pool.select(key.alias("b"), F.lit(1).cast("long").alias("n"), F.struct(F.lit(0).cast("long").alias("b"), F.sha2(line, 256).alias("d")).alias("r"))
    digest = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["d"]), "").cast("binary"), 256)
    for _ in TREE:
        level = level.groupBy("b").agg(digest.alias("d"), F.sum("n").alias("n")).select(F.expr("b div 256").alias("b"), "n", F.struct("b", "d").alias("r"))
    return level.agg(digest.alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def next_case(cases: DataFrame, pieces: int = 256) -> DataFrame:
    """case_id, partner: the next larger id, and the smallest for the largest. Ids are cut into ranges, so that no task
    sorts them all; only the ranges' first ids, at most `pieces`, are put in one order."""
    ends = cases.agg(F.min("case_id").cast("double").alias("lo"), F.max("case_id").cast("double").alias("hi"))
    piece = F.floor((F.col("case_id") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * pieces)
    c = cases.select("case_id").distinct().join(F.broadcast(ends)).withColumn("piece", piece)
    firsts = c.groupBy("piece").agg(F.min("case_id").alias("first"))
    whole = Window.orderBy("piece")  # at most `pieces` rows
    after = firsts.select("piece", F.coalesce(F.lead("first").over(whole), F.first("first").over(whole)).alias("after"))
    own = c.withColumn("next", F.lead("case_id").over(Window.partitionBy("piece").orderBy("case_id")))
    return own.join(F.broadcast(after), "piece").select("case_id", F.coalesce("next", "after").alias("partner"))


def assign_splits(cases: DataFrame, seed: str, n_val: int, reused: DataFrame | None = None) -> DataFrame:
    """case_id, split: reused splits where the case is still there, of the others n_val by keyed order are val."""
    known = cases.select("case_id").join(reused, "case_id") if reused is not None else None
    rest = cases.select("case_id") if known is None else cases.select("case_id").join(known, "case_id", "left_anti")
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("case_id").cast("string")))
    val = rest.select("case_id", key.alias("key")).orderBy("key", "case_id").limit(n_val).select("case_id", F.lit("val").alias("split"))
    out = rest.join(val, "case_id", "left").select("case_id", F.coalesce("split", F.lit("train")).alias("split"))
    return out if known is None else out.unionByName(known.select("case_id", "split"))
