"""Keyed sampling: quotas without replacement, ordered by a hash of seed and id instead of a random stream."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cases of a key prefix in a weighted epoch, at most, on average.
PREFIX = 100_000


def key(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def first_by_key(df: DataFrame, keys: list[str], order: list[Column], n: Column | int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group. Spark plans a rank filter as a group limit before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def quota(share: float, n: int) -> int:
    """Half-to-even rounding."""
    return int(round(share * n))


def stratified(df: DataFrame, keys: list[str], n_keep: int, seed: int, indicator: Column, near_band: float = 0.25, share: tuple[float, float, float] = (0.5, 0.2, 0.3)) -> DataFrame:
    """Rows with `stratum`: near-wall rows, then rows of any kind, then wake rows (indicator in its upper
    tenth), each quota without replacement from what the ones before left. Small groups are kept whole. The rows are
    shuffled once; what one quota takes is a flag by which the next one's ranks are told apart."""
    group = Window.partitionBy(*keys)
    rank = lambda flag, what: F.row_number().over(Window.partitionBy(*keys, flag).orderBy(key(seed, what, F.col("point_id")), "point_id"))
    take = lambda flag, what, n: F.col(flag) & (rank(flag, what) <= n)
    near = F.col("wall_dist") < near_band
    d = df.repartition(*keys).withColumn("i_", indicator).withColumns({"n_": F.count(F.lit(1)).over(group), "q_": F.percentile("i_", 0.9).over(group)})
    d = d.withColumns({"small_": F.col("n_") <= n_keep, "f1_": F.coalesce(near, F.lit(False))})
    d = d.withColumn("s1_", take("f1_", "near", quota(share[0], n_keep))).withColumn("f2_", ~F.col("s1_"))
    d = d.withColumn("s2_", take("f2_", "any", quota(share[1], n_keep))).withColumn("f3_", F.coalesce(~F.col("s1_") & ~F.col("s2_") & (F.col("i_") >= F.col("q_")), F.lit(False)))
    d = d.withColumn("s3_", take("f3_", "wake", quota(share[2], n_keep)))
    stratum = F.when(F.col("small_"), F.when(near, 1).otherwise(0)).when(F.col("s1_"), 1).when(F.col("s2_"), 0).when(F.col("s3_"), 2)
    return d.withColumn("stratum", stratum).where(F.col("stratum").isNotNull()).select(*df.columns, "stratum")


def context(df: DataFrame, keys: list[str], n: int, seed: int, near_band: float = 0.25, share: float = 5 / 7) -> DataFrame:
    """At most n rows of each group, `share` of them near walls; the rows are shuffled once."""
    order = lambda what: [key(seed, what, F.col("point_id")), F.col("point_id")]
    d = df.repartition(*keys).withColumn("near_", F.coalesce(F.col("wall_dist") < near_band, F.lit(False)))
    d = d.withColumn("taken_", F.col("near_") & (F.row_number().over(Window.partitionBy(*keys, "near_").orderBy(*order("near"))) <= quota(share, n)))
    d = d.withColumns({"n_": F.count_if("taken_").over(Window.partitionBy(*keys)), "rank_": F.row_number().over(Window.partitionBy(*keys, "taken_").orderBy(*order("rest")))})
    return d.where(F.col("taken_") | (F.col("rank_") <= n - F.col("n_"))).select(*df.columns)


def epoch_order(pool: DataFrame, seed: int, epoch: int, start: int = 0) -> DataFrame:
    """case_id, pos: a permutation by key. Positions come from counts per key prefix and ranks within a prefix, which is
    two digits, and longer as long as one would have more than a million cases, so no task sorts the whole pool; `start`
    resumes an epoch."""
    n, digits = pool.count(), 2
    while n > 16**digits * 1_000_000:
        digits += 1
    k = pool.select("case_id", key(seed, epoch, F.col("case_id")).alias("key")).withColumn("s", F.substring("key", 1, digits))
    counts = k.groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("s", (F.sum("c").over(Window.orderBy("s")) - F.col("c")).alias("base"))  # a row a prefix: 256, or one for about 60,000 cases or more
    out = k.join(F.broadcast(before), "s").withColumn("pos", F.col("base") + F.row_number().over(Window.partitionBy("s").orderBy("key", "case_id")) - 1)
    return out.select("case_id", "pos").where(F.col("pos") >= start)


def weighted_epoch(pool: DataFrame, group: str, weights: dict[str, float], seed: int, epoch: int) -> DataFrame:
    """case_id, draw per group: round(n w / sum w) draws by going through fresh permutations of the group. All rounds of a group
    but its last are whole. Of the last the first by key are taken: counts by key prefix tell which prefixes are in or out, and only the
    one prefix a group that the end falls into is ranked, so no task sorts a group."""
    spark = pool.sparkSession
    total, n, digits = sum(weights.values()), pool.count(), 2
    while n > 16**digits * PREFIX:
        digits += 1
    w = spark.createDataFrame([(g, v / total) for g, v in sorted(weights.items())], f"{group} string, share double")
    sizes = pool.groupBy(group).agg(F.count(F.lit(1)).alias("size")).join(F.broadcast(w), group).withColumn("m", F.bround(F.lit(n) * F.col("share"), 0).cast("long"))
    sizes = sizes.withColumn("last", F.greatest(F.lit(0), F.ceil(F.col("m") / F.col("size")).cast("int") - 1))
    ends = sizes.select(group, "last", (F.col("m") - F.col("last") * F.col("size")).alias("need"))  # a row a group
    k = pool.select("case_id", group).join(F.broadcast(ends), group).withColumn("key", key(seed, epoch, F.col("last"), F.col("case_id"))).withColumn("s", F.substring("key", 1, digits))
    counts = k.groupBy(group, "s").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select(group, "s", "c", (F.sum("c").over(Window.partitionBy(group).orderBy("s")) - F.col("c")).alias("base"))
    placed = k.join(F.broadcast(before), [group, "s"])  # a row a group and prefix: 256, or one for about PREFIX cases or more
    whole = F.col("base") + F.col("c") <= F.col("need")
    rounds = F.filter(F.sequence(F.lit(0), F.col("last")), lambda i: (i < F.col("last")) | whole)
    ranked = placed.where(~whole & (F.col("base") < F.col("need"))).withColumn("r", F.row_number().over(Window.partitionBy(group, "s").orderBy("key", "case_id")))
    rest = ranked.where(F.col("base") + F.col("r") <= F.col("need")).select("case_id", group, F.col("last").alias("round"))
    return placed.select("case_id", group, F.explode(rounds).alias("round")).unionByName(rest)


def point_mask(df: DataFrame, keys: list[str], score: Column, ratio: float) -> DataFrame:
    """masked: score at or above its quantile 1 - ratio in the group; ties may mask more than the ratio."""
    d = df.withColumn("score", score)
    if ratio >= 1:
        return d.withColumn("masked", F.lit(True))
    cut = d.groupBy(*keys).agg(F.percentile("score", 1 - ratio).alias("cut"))
    return d.join(cut, keys).withColumn("masked", F.col("score") >= F.col("cut")).drop("cut")


def unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from a key: eight hexadecimal digits."""
    return F.conv(F.substring(key(*parts), 1, 8), 16, 10).cast("double") / 4294967296.0


def street_probes(points: DataFrame, keys: list[str], height: float, band: float, clear: float, span: tuple[float, float], n: int, seed: int) -> DataFrame:
    """At most n points of each group near a height, clear of walls and within a span of x, by keyed order."""
    near = points.where((F.abs(F.col("z") - height) <= band) & (F.col("wall_dist") > clear) & F.col("x").between(*span))
    return first_by_key(near, keys, [key(seed, F.col("point_id")), F.col("point_id")], n).drop("rank")


def nearest_layer(points: DataFrame, keys: list[str], height: float, digits: int = 2, band: float = 0.01) -> DataFrame:
    """The points within `band` of the group's layer zl (heights rounded to so many digits) that is nearest to a height."""
    layers = points.select(*keys, F.round("z", digits).alias("zl")).distinct()
    chosen = layers.groupBy(*keys).agg(F.min_by("zl", F.struct(F.abs(F.col("zl") - height), "zl")).alias("zl"))
    return points.join(chosen, keys).where(F.abs(F.col("z") - F.col("zl")) < band)
