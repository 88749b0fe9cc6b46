"""Pieces of the representation model as relations: rotary positions, attention over sets of any size, masked pooling."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rotary(vector: Column, position: Column, n_freq: int, longest: float = 100.0) -> Column:
    """Pairs (2i, 2i + 1) of the vector's first 2 n_freq values turned by position times a wave number; wave lengths
    spread by logarithm up to `longest`; the rest passes."""
    angle = lambda i: position * F.lit(2 * 3.141592653589793) / F.pow(F.lit(longest), i / F.lit(float(max(1, n_freq - 1))))
    turned = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n_freq - 1)), lambda i: F.array(
        vector[2 * i] * F.cos(angle(i)) - vector[2 * i + 1] * F.sin(angle(i)), vector[2 * i] * F.sin(angle(i)) + vector[2 * i + 1] * F.cos(angle(i)))))
    return F.concat(turned, F.slice(vector, 2 * n_freq + 1, F.greatest(F.lit(0), F.size(vector) - 2 * n_freq)))


def rotary_axes(vector: Column, position: list[Column], size: int, shortest: float, longest: float) -> Column:
    """A vector of `size` values turned by a position of several axes. Each axis has a block of as many pairs as fit all axes alike;
    its i-th pair turns by position times 2 pi over the i-th of wave lengths that are spread by logarithm from the shortest
    to the longest. What is left of the vector passes. Inner products of two turned vectors depend on the positions' difference."""
    n = size // (2 * len(position))
    lengths = [shortest * (longest / shortest) ** (i / max(1, n - 1)) for i in range(n)]
    turned = []
    for k, (axis, length) in enumerate((a, w) for a in position for w in lengths):
        angle, (x, y) = axis * F.lit(2 * math.pi / length), (vector[2 * k], vector[2 * k + 1])
        turned += [x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)]
    return F.array(*turned, *[vector[i] for i in range(len(turned), size)])


#: Queries of a tile, keys that a tile meets, and keys that are multiplied at a time.
TILE_QUERIES, TILE_KEYS, BLOCK = 1024, 65_536, 1024


def attention(queries: DataFrame, memory: DataFrame, group: str, dims: int, tile_queries: int = TILE_QUERIES, tile_keys: int = TILE_KEYS, block: int = BLOCK) -> DataFrame:
    """Scaled dot-product attention within groups: group, query_id, o0, o1, ... queries: group, query_id, q; memory: group,
    key_id, k, v, valid. A query whose group has no valid key has no row.

    Groups are cut into tiles of queries by keys, so neither a large set of queries nor one of keys is one task's work, and no
    table of pairs is made. A tile's queries stand first, then its keys pass in blocks; of each query a state is kept (the
    largest score, the sum of the exponentials and of the weighted values, both relative to it), which a block only updates. States of the
    tiles of one query are brought to the same largest score and added.
    """
    kind = queries.schema[group].dataType.simpleString()
    valid = memory.where("valid")
    tiles = lambda d, size, name: d.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    n = tiles(queries, tile_queries, "nq").join(tiles(valid, tile_keys, "nk"), group)
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vector = lambda c: F.col(c).cast("array<double>")
    q = queries.join(n, group).select(group, spread("query_id", "nq").alias("tq"), every("nk").alias("tk"), F.lit(0).alias("side"), F.col("query_id").cast("long").alias("id"), vector("q").alias("a"), F.lit(None).cast("array<double>").alias("b"))
    k = valid.join(n, group).select(group, every("nq").alias("tq"), spread("key_id", "nk").alias("tk"), F.lit(1).alias("side"), F.col("key_id").cast("long").alias("id"), vector("k").alias("a"), vector("v").alias("b"))
    rows = q.unionByName(k).repartition(group, "tq", "tk").sortWithinPartitions(group, "tq", "tk", "side", "id")
    names = [group, "query_id", "top", "total", *[f"s{i}" for i in range(dims)]]
    states = rows.mapInArrow(_online(group, dims, block), f"{group} {kind}, query_id long, top double, total double, " + ", ".join(f"s{i} double" for i in range(dims)))
    same = states.withColumn("most", F.max("top").over(Window.partitionBy(group, "query_id")))
    share = F.exp(F.col("top") - F.col("most"))
    return same.groupBy(group, "query_id").agg(*[(F.sum(F.col(c) * share) / F.sum(F.col("total") * share)).alias(f"o{i}") for i, c in enumerate(names[4:])])


def _online(group: str, dims: int, block: int):
    """A function over sorted batches of a tile's queries and keys that gives the queries' states."""

    def matrix(column: pa.Array) -> np.ndarray:
        flat = np.asarray(column.flatten(), dtype=float)
        return flat.reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, q, state = None, [], [], None

        def out() -> pa.RecordBatch:
            top, total, sums = state
            columns = [pa.array([now[0]] * len(top), group_type), pa.array(np.concatenate(ids)), pa.array(top), pa.array(total), *[pa.array(np.ascontiguousarray(sums[:, i])) for i in range(dims)]]
            return pa.RecordBatch.from_arrays(columns, [group, "query_id", "top", "total", *[f"s{i}" for i in range(dims)]])

        for b in batches:
            if not b.num_rows:
                continue
            group_type = b.schema.field(0).type
            key = [b.column(i) for i in range(4)]
            code = np.stack([np.asarray(c.dictionary_encode().indices) for c in key], 1)
            edges = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                tile, part = tuple(c[lo].as_py() for c in key[:3]), b.slice(lo, hi - lo)
                if tile != now:
                    if state is not None:
                        yield out()
                    now, ids, q, state = tile, [], [], None
                if key[3][lo].as_py() == 0:
                    ids.append(np.asarray(part.column(4)))
                    q.append(matrix(part.column(5)))
                    continue
                if not q:
                    continue  # a tile of keys that none of the group's queries fell into
                if state is None:
                    q = [np.concatenate(q) / math.sqrt(dims)]
                    state = np.full(len(q[0]), -np.inf), np.zeros(len(q[0])), np.zeros((len(q[0]), dims))
                keys, values = matrix(part.column(5)), matrix(part.column(6))
                for at in range(0, len(keys), block):
                    state = merged(state, q[0] @ keys[at : at + block].T, values[at : at + block])
        if state is not None:
            yield out()

    return run


def merged(state: tuple[np.ndarray, np.ndarray, np.ndarray], scores: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A state (largest score, sum of exponentials, sum of weighted values, relative to it) after more keys."""
    top, total, sums = state
    most = np.maximum(top, scores.max(1))
    old, e = np.exp(top - most), np.exp(scores - most[:, None])
    return most, total * old + e.sum(1), sums * old[:, None] + e @ values


def max_pool(rows: DataFrame, keys: list[str], features: list[str], valid: Column) -> DataFrame:
    """Largest value of each feature over the valid rows of a token; null where none is valid."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(valid, F.col(f))).alias(f) for f in features])
