"""A Merkle manifest of a table: a tree a source over its rows' digests, a tree over the sources, and a proof a row.

Rows get their place in their source's tree from one sort by range, whose partitions' counts are added up, so a source of any
size is dealt over all tasks. A superblock, fanout ** LEVELS neighbouring nodes of a tree, is one group: applyInPandas
collapses its levels at once and gives each node the lower part of its proof. The blocks' roots are a table of the same
form, 2,187 times smaller, and are reduced again until each tree has one node; the trees' roots, in order of the
sources, are reduced likewise. A row's proof is its lower part and its block's upper part in a row.

A proof is two columns: `shape`, a digit a level that says how many siblings stand left and right of the node
(3 * left + right), and `proof`, the siblings' digests, level by level and left to right.

Defined results: a null value is hashed as `-`, so it differs from the empty string and from the text "-"; a null source is a
source of its own before all others; null ids stand first in their source, rows of one id by their leaves, and equal rows
are leaves of their own with equal digests; an empty table has no row and no root; a text of any length is hashed
whole in its scan and never moved; other columns are no part of a leaf.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

#: Children of a node; levels that a superblock collapses; rows that a sorting task gets on average at most.
FANOUT, LEVELS, TASK_ROWS = 3, 7, 2_000_000


def field(value: Column) -> Column:
    """A value as it stands in a leaf: its length in bytes, a colon and itself, or `-` for null."""
    x = value.cast("string")
    return F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def tree_key(source: Column) -> Column:
    """A name of the source's tree that is never null and sorts as the sources do, null first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def ranked(rows: DataFrame, order: list[str], count: int) -> DataFrame:
    """rows, whose trees (column `tree`) are numbered: idx from 0 in the order given, and height, the tree's levels."""
    parts = max(partitions(rows.sparkSession), -(-count // TASK_ROWS))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order).withColumns({"part": F.spark_partition_id(), "at": place}), "placed")
    tree = Window.partitionBy("tree")
    runs = placed.groupBy("part", "tree").agg(F.min("at").alias("begin"), F.count("*").alias("n"))
    runs = runs.withColumns({"before": F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), "size": F.sum("n").over(tree)})
    powers = F.array(*[F.lit(FANOUT**k) for k in range(40) if FANOUT**k < 1 << 63])
    height = F.size(F.filter(powers, lambda p: p < F.col("size")))
    runs = runs.select("part", "tree", (F.coalesce("before", F.lit(0)) - F.col("begin")).alias("shift"), height.alias("height"))
    return placed.join(runs, ["part", "tree"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def parent(nodes: list[bytes]) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def collapse(nodes: list[bytes], levels: int) -> tuple[bytes, list[str], list[bytes]]:
    """The root of a block after `levels` levels, and of each node the shape and the siblings of its way there."""
    shapes, proofs = [[] for _ in nodes], [[] for _ in nodes]
    now, below = nodes, [[i] for i in range(len(nodes))]  # the nodes of a level and the leaves under each
    for _ in range(levels):
        runs = [range(a, min(a + FANOUT, len(now))) for a in range(0, len(now), FANOUT)]
        for run in runs:
            for i in run:
                digit, others = str(3 * (i - run.start) + run.stop - 1 - i), b"".join(now[j] for j in run if j != i)
                for x in below[i]:
                    shapes[x].append(digit)
                    proofs[x].append(others)
        now, below = [parent(now[r.start : r.stop]) for r in runs], [[x for i in r for x in below[i]] for r in runs]
    return now[0], ["".join(s) for s in shapes], [b"".join(p) for p in proofs]


def superblocks(nodes: DataFrame, keep: list[str], levels: int) -> DataFrame:
    """nodes (tree, idx, height, node, and columns to keep, strings or binary) with block, top (the block's root), shape and proof."""
    schema = "tree string, idx long, height int, block long, node binary, top binary, shape string, proof binary" + "".join(f", {k} {nodes.schema[k].dataType.simpleString()}" for k in keep)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        top, shapes, proofs = collapse(group["node"].tolist(), min(levels, int(group["height"].iloc[0])))
        return group.assign(top=[top] * len(group), shape=shapes, proof=proofs)[names]

    blocks = nodes.select("tree", "idx", "height", "node", *keep, F.expr(f"idx div {FANOUT**levels}").alias("block"))
    return blocks.groupBy("tree", "block").applyInPandas(run, schema)


def reduce_up(nodes: DataFrame, keep: list[str], finish: Callable[[DataFrame], DataFrame], tallest: int, levels: int) -> DataFrame:
    """tree, idx, node, what is kept, and shape, proof and further columns of finish, which gets the trees' roots as tree and node and
    returns tree, shape, proof and its own columns."""
    lower = cut(superblocks(nodes, keep, levels), "superblocks")
    tops = lower.where(F.col("idx") % FANOUT**levels == 0).select("tree", F.col("block").alias("idx"), F.greatest(F.col("height") - levels, F.lit(0)).alias("height"), F.col("top").alias("node"))
    if tallest > levels:
        upper = reduce_up(tops, [], finish, tallest - levels, levels).drop("node")
    else:
        upper = finish(tops.select("tree", "node")).withColumn("idx", F.lit(0).cast("long"))
    told = [c for c in upper.columns if c not in ("tree", "idx", "shape", "proof")]
    upper = upper.select(F.col("tree").alias("u_tree"), F.col("idx").alias("u_idx"), F.col("shape").alias("u_shape"), F.col("proof").alias("u_proof"), *told)
    both = lower.join(upper, (F.col("tree") == F.col("u_tree")) & (F.col("block") == F.col("u_idx")))
    return both.select("tree", "idx", "node", *keep, F.concat("shape", "u_shape").alias("shape"), F.concat("proof", "u_proof").alias("proof"), *told)


def _tallest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("height")).first()[0] or 0


def _over_sources(roots: DataFrame, levels: int) -> DataFrame:
    """tree, subroot, root, and shape and proof from the subroot to the root, of the trees' roots (tree, node)."""
    own = roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node")
    nodes = ranked(own, ["of"], 0)
    none = lambda r: r.select("tree", F.lit("").alias("shape"), F.lit(b"").alias("proof"), F.col("node").alias("root"))
    out = reduce_up(nodes, ["of"], none, _tallest(nodes), levels)
    return out.select(F.col("of").alias("tree"), "shape", "proof", F.col("node").alias("subroot"), "root")


def manifest(leaves: DataFrame, order: list[str], keep: list[str], levels: int = LEVELS) -> DataFrame:
    """tree, idx, node, what is kept, shape, proof, subroot and root of leaves (tree, node binary, the columns of order, and
    columns to keep, which are strings or binary). Leaves of a tree stand in the given order, then by their digests."""
    held = cut(leaves, "leaves")
    nodes = ranked(held, [*order, "node"], held.count())
    return reduce_up(nodes, keep, lambda roots: _over_sources(roots, levels), _tallest(nodes), levels)


def siblings(proof: Column) -> Column:
    """The siblings of a proof as the hex text that digests are taken of."""
    return F.lower(F.hex(proof))


def folded(start: Column, shape: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and a proof lead to: the check of a single row, which needs nothing else of the table."""
    levels = F.filter(F.sequence(F.lit(0), F.length(shape)), lambda k: k > 0)

    def step(state: Column, k: Column) -> Column:
        digit = F.substr(shape, k, F.lit(1)).cast("int")
        left, right = F.floor(digit / 3).cast("int") * 64, digit % 3 * 64
        node = F.sha2(F.concat(F.substr(state["rest"], F.lit(1), left), state["node"], F.substr(state["rest"], left + 1, right)).cast("binary"), 256)
        return F.struct(node.alias("node"), F.substr(state["rest"], left + right + 1).alias("rest"))

    return F.aggregate(levels, F.struct(start.alias("node"), siblings(proof).alias("rest")), step)["node"]
