"""From samples to what a network reads: encoded rows without targets it must not see, padding, and batches."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import encode, masked
from ..schema import CHANNELS, GROUPS


def strip_targets(points: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points without target values, and cases whose presence says so: what a trained model is given. Geometry, mesh,
    conditioning and prior stay."""
    none = F.array(*[F.lit(False)] * len(GROUPS))
    return points.withColumns({c: F.lit(None).cast("double") for c in CHANNELS if c in points.columns}), cases.withColumn("presence", none)


def network_rows(points: DataFrame, cases: DataFrame, use_prior: Column) -> DataFrame:
    """Points with channels and prior channels in encoded space, exactly 0 where their group is absent (whatever stands
    there), cell_size 1 with cs_flag 0 where a mesh has none. cases: case_id, presence, prior_presence (null: no prior);
    use_prior is a condition on them."""
    flags = cases.withColumn("shown", F.coalesce(use_prior & F.col("prior_presence").isNotNull(), F.lit(False))).select("case_id", "presence", "prior_presence", "shown")
    d = points.join(flags, "case_id")
    new: dict[str, Column] = {}
    for i, channels in enumerate(GROUPS.values()):
        for c in channels:
            value = lambda x: encode(F.col(x)) if c in ("k", "eps") else F.col(x)  # noqa: B023, E731
            new[c] = masked(F.coalesce(F.col("presence")[i], F.lit(False)), value(c))
            new[f"p_{c}"] = masked(F.col("shown") & F.coalesce(F.col("prior_presence")[i], F.lit(False)), value(f"p_{c}"))
    new["cs_flag"] = F.col("cell_size").isNotNull().cast("double")
    new["cell_size"] = F.coalesce("cell_size", F.lit(1.0))
    return d.withColumns(new).drop("presence", "prior_presence", "shown")


def pad(rows: DataFrame, keys: list[str], slot: str, n: int, fill: dict[str, object]) -> DataFrame:
    """Rows of each group in exactly n slots 0 .. n - 1, with `valid` false and the fill values in slots that the group lacks.
    A group with a slot beyond n raises an error. Only groups that have a row are padded."""
    checked = rows.withColumn(slot, F.when((F.col(slot) >= 0) & (F.col(slot) < n), F.col(slot)).otherwise(F.raise_error(F.lit(f"a slot lies beyond {n}")).cast("int")))
    slots = rows.select(*keys).distinct().withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = slots.join(checked.withColumn("valid", F.lit(True)), [*keys, slot], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    return out.withColumns({c: F.when(F.col("valid"), F.col(c)).otherwise(F.lit(v)) for c, v in fill.items()})


def collate(order: DataFrame, size: int) -> DataFrame:
    """case_id, batch, row of an epoch's order (case_id, pos): batches of `size` cases in turn, the last one whole or not."""
    return order.select("case_id", F.floor(F.col("pos") / size).alias("batch"), (F.col("pos") % size).cast("int").alias("row"))


def voxel_channels(cached: list[Column], l_ref: Column, l_z: Column) -> list[Column]:
    """Canonical channels of a voxel cache's six: pressure doubled to Cp, k and eps from their logarithm, eps from the cache's
    length to the case's."""
    back = lambda x: F.expm1(F.greatest(x, F.lit(0.0)))
    return [*cached[:3], 2 * cached[3], back(cached[4]), back(cached[5]) * (l_ref / l_z)]
