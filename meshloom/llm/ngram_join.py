"""N-gram Jaccard join: documents whose sets of five-word shingles agree to 0.8 or more.

Equal texts are first counted as one. Each different text gets a MinHash signature by one permutation with
random densification; texts that agree on a band of four values are candidates. Within a band's bucket pairs
are compared by more and more MinHash values, and dropped once the posterior probability that their
similarity reaches the threshold (uniform prior, binomial likelihood) falls below a tolerance. The pairs that
are left tie texts into candidate groups, of which only spanning links leave the tasks. A group says which texts
are put together, once for all bands, in tiles of bounded rows and bytes; within a tile only the pairs that survive
the same pruning are verified exactly on the shingle sets, and only counts and spanning links leave the task.

Defined results: a text of fewer than five words has no shingles and links with nothing but its equal copies;
a null text is the empty text; rows of a null doc_id have a null class and no links; repeated rows get the
same result each; different texts under one doc_id are linked each for itself, as rows of their own; an
empty table gives no row; further columns are ignored; texts of any length are read whole, and a very long one is a tile of its own. n_links is the number of different texts that the
document's text is linked with.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import cut, partitions, text_of
from .components import components

SHINGLE, VALUES, BAND = 5, 128, 4
BANDS = VALUES // BAND
#: Rows of a bucket or group that one task compares with as many others, and bytes of text that a group's rows may have.
TILE_BUCKET, TILE_GROUP, TILE_BYTES = 1024, 1024, 4 << 20
_rng = np.random.Generator(np.random.PCG64(7))
#: Where an empty bin of a signature looks for a value, in this order (the same for every text).
_PROBES = np.argsort(_rng.random((VALUES, VALUES)), axis=1).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, in a row; and the n + 1 places where they begin."""
    starts, ends, first = B.words(data, offsets)
    h = B.windows(B.hash_spans(data, starts, ends), SHINGLE)
    n = np.maximum(np.diff(first) - SHINGLE + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.repeat(first[:-1], n) + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    h = h[at] if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One-permutation MinHash, VALUES bins by the hash's upper bits: the smallest hash in each bin, which in a
    sorted set is the bin's first; an empty bin takes the value of the first filled bin among its probes."""
    n = len(first) - 1
    out = np.zeros((n, VALUES), np.uint64)
    full = np.zeros((n, VALUES), bool)
    doc = np.repeat(np.arange(n), np.diff(first))
    place = (h >> np.uint64(57)).astype(np.int64) if VALUES == 128 else None
    new = np.ones(len(h), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    out[doc[new], place[new]] = h[new]
    full[doc[new], place[new]] = True
    some = full.any(axis=1)
    for k in range(VALUES):  # the k-th probe of every bin that is still empty
        d, b = np.nonzero(~full & some[:, None]) if k == 0 else (d[~ok], b[~ok])
        if not len(d):
            break
        source = _PROBES[b, k]
        ok = full[d, source]
        # Densified values are marked with the bin, so that two empty bins agree only by the same source.
        out[d[ok], b[ok]] = B.mix(out[d[ok], source[ok]] + np.uint64(1))
    return out


def least_matches(threshold: float, tolerance: float, step: int = 16) -> dict[int, int]:
    """For k compared values: the least number of matches at which P(similarity >= threshold | matches) is
    not below the tolerance, under a uniform prior: one less the regularised incomplete beta function, as a
    binomial sum."""
    out = {}
    for k in range(step, VALUES + 1, step):
        m = 0
        # P(s >= t | m of k) = P(Binomial(k + 1, t) <= m)
        while sum(comb(k + 1, i) * threshold**i * (1 - threshold) ** (k + 1 - i) for i in range(m + 1)) < tolerance:
            m += 1
        out[k] = m
    return out


def _survivors(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that are never dropped while more and more values are compared."""
    steps = sorted(least)
    i, j = np.nonzero((a[:, None, : steps[0]] == b[None, :, : steps[0]]).sum(axis=2, dtype=np.uint8) >= least[steps[0]]) if len(a) * len(b) <= 1 << 16 else _tiles(a, b, steps[0], least[steps[0]])
    m = (a[i, : steps[0]] == b[j, : steps[0]]).sum(axis=1)
    for k0, k in zip(steps, steps[1:]):
        if not len(i):
            break
        m = m + (a[i, k0:k] == b[j, k0:k]).sum(axis=1)
        on = m >= least[k]
        i, j, m = i[on], j[on], m[on]
    return i, j


def _tiles(a: np.ndarray, b: np.ndarray, k: int, least: int, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    ii, jj = [], []
    for at in range(0, len(a), rows):
        i, j = np.nonzero((a[at : at + rows, None, :k] == b[None, :, :k]).sum(axis=2, dtype=np.uint8) >= least)
        ii.append(i + at)
        jj.append(j)
    return np.concatenate(ii), np.concatenate(jj)


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that tie the same nodes together as all pairs (i, j) do: at most n - 1."""
    top = list(range(n))
    out = []

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for x, y in zip(i.tolist(), j.tolist()):
        a, b = find(x), find(y)
        if a != b:
            top[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def _tiled(members: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Members of groups of more than one (sizes: key, n, tiles), dealt to pairs of tiles: columns ti <= tj and t. A group
    of one tile is one pair (0, 0); of s tiles each row goes to s pairs, so no task holds more than two tiles."""
    rows = members.join(sizes.where("n > 1"), key)
    rows = rows.withColumn("s", F.col("tiles").cast("int")).withColumn("t", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("s")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    return rows.withColumns({"ti": F.least("t", "o"), "tj": F.greatest("t", "o")}).drop("o", "s", "n", "tiles")


def similar_texts(docs: DataFrame, text: str = "text", threshold: float = 0.8, tolerance: float = 1e-7) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), n_links; one row per row of docs."""
    spark = docs.sparkSession
    parts = partitions(spark)
    least = least_matches(threshold, tolerance)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in B.concat_batches(batches, 4 << 20):
            data, offsets = B.text_buffer(B.column(t, "text"))
            h, first = shingle_sets(data, offsets)
            sig = (signatures(h, first) & np.uint64(0xFFFFFFFF)).astype("<u4")
            n = np.diff(first)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * VALUES), len(n), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([B.column(t, "doc_id"), B.column(t, "digest"), pa.array(n, pa.int64()), pa.array(np.diff(offsets)), raw], ["doc_id", "digest", "n_shingles", "n_bytes", "signature"])

    source = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.xxhash64(text_of(docs, text)).alias("x"), text_of(docs, text).alias("text"))
    source = source.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "text")
    signed = cut(source.mapInArrow(B.lean(sign), "doc_id long, digest binary, n_shingles long, n_bytes long, signature binary"), "signatures")

    # A text is told by a number, and stands in the row of its smallest id.
    copies = cut(signed.groupBy("digest").agg(F.min("doc_id").alias("least")).withColumn("rep", F.monotonically_increasing_id()), "copies")
    own = signed.where("n_shingles > 0").join(copies.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("least")))
    reps = cut(own.groupBy("rep").agg(*[F.first(c).alias(c) for c in ("digest", "least", "n_shingles", "n_bytes", "signature")]), "reps")

    # Bands: texts that agree on four values. Only rows of buckets of two or more go on.
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _matrix(b.column(1))
            keys = np.empty((len(sig), BANDS), np.uint64)
            for k in range(BANDS):
                x = np.full(len(sig), k + 1, np.uint64)
                for v in range(BAND):
                    x = B.mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, k * BAND + v])
                keys[:, k] = x
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(b.column(0)), BANDS))], ["bucket", "rep"])

    keyed = reps.select("rep", "signature").mapInArrow(B.lean(bands), "bucket long, rep long")
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / TILE_BUCKET).alias("tiles"))
    placed = _tiled(keyed, sizes, "bucket").join(reps.select("rep", "n_shingles", "signature"), "rep")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, g in _sorted_groups(batches, ["bucket", "ti", "tj"]):
            sig = _matrix(g["signature"])
            links = _spanning(len(sig), *_between(g["t"], key, lambda a, b: _survivors(sig[a], sig[b], least)))
            if links:
                rep = np.asarray(g["rep"])
                i, j = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], ["a", "b"])

    dealt = placed.select("bucket", "ti", "tj", "t", "rep", "signature").repartition(parts, "bucket", "ti", "tj").sortWithinPartitions("bucket", "ti", "tj")
    groups = cut(components(dealt.mapInArrow(B.lean(candidates), "a long, b long")), "groups")

    # Exact verification within the candidate groups.
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("least"), text_of(docs, text).alias("text"))
    texts = texts.select("least", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    grouped = groups.select(F.col("node").alias("rep"), F.col("component").alias("group")).join(reps.select("rep", "digest", "least", "n_bytes"), "rep")
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / TILE_GROUP, F.sum("n_bytes") / TILE_BYTES))
    members = _tiled(grouped.select("rep", "least", "digest", "group"), grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n"), tiles.alias("tiles")), "group")
    # Texts are far larger than the groups' rows, which grow with the corpus: the rows are the side that is hashed.
    whole = texts.join(members.hint("shuffle_hash"), ["least", "digest"]).repartition(parts, "group", "ti", "tj").sortWithinPartitions("group", "ti", "tj", "rep")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, g in _sorted_groups(batches, ["group", "ti", "tj"]):
            rep = np.asarray(g["rep"])
            new = np.ones(len(rep), bool)
            new[1:] = rep[1:] != rep[:-1]
            if not new.all():  # a repeated row counts once
                g = {k: v.filter(pa.array(new)) for k, v in g.items()}
                rep = rep[new]
            h, first = shingle_sets(*B.text_buffer(g["text"]))
            sig = (signatures(h, first) & np.uint64(0xFFFFFFFF)).astype("<u4")
            i, j = _between(g["t"], key, lambda a, b: _survivors(sig[a], sig[b], least))
            linked = _linked(h, first, i, j, threshold)
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            count = np.bincount(np.concatenate([i, j]), minlength=len(rep))
            links = np.array(_spanning(len(rep), i, j))
            own = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([rep[own], rep[links[:, 0]]])), pa.array(np.concatenate([np.full(len(own), -1), rep[links[:, 1]]])),
                pa.array(np.concatenate([count[own], np.zeros(len(links), np.int64)])), pa.array([True] * len(own) + [False] * len(links)),
            ], ["a", "b", "n", "counted"])

    found = cut(whole.select("group", "ti", "tj", "t", "rep", "text").mapInArrow(B.lean(verify), "a long, b long, n long, counted boolean"), "links")
    tied = components(found.where("not counted").select("a", "b")).select(F.col("node").alias("rep"), "component")
    tied = cut(tied.join(copies.select("rep", "least"), "rep"), "tied")
    classes = tied.join(tied.groupBy("component").agg(F.min("least").alias("class_id")), "component").select("rep", "class_id")
    counts = found.where("counted").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    known = copies.join(classes, "rep", "left").join(counts, "rep", "left").select("digest", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = signed.select("doc_id", "digest").join(known, "digest").select("doc_id", "class_id", "n_links")
    lost = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(lost)


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = B.text_buffer(column)
    return data.view("<u4").reshape(len(column), -1)


def _between(tiles: pa.Array, key: tuple, compare) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a group's piece: within one tile each pair once, between two tiles each row of one with each of the other."""
    t = np.asarray(tiles)
    a, b = np.flatnonzero(t == key[1]), np.flatnonzero(t == key[2])
    i, j = compare(a, b)
    if key[1] == key[2]:
        on = i < j
        i, j = i[on], j[on]
    return a[i], b[j]


def _linked(h: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, columns: int = 8192, rows: int = 512) -> np.ndarray:
    """Which of the pairs (i, j) of sets reach the threshold, from exact counts of common shingles."""
    n = np.diff(first)
    common = np.zeros(len(i), np.int64)
    own = np.unique(np.concatenate([i, j]))
    if len(i) * 20 < len(own) ** 2:  # few pairs: the elements that stand twice among those of a pair
        at = 0
        ends = np.cumsum(n[i] + n[j])
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
            sets = np.stack([i[at:to], j[at:to]], axis=1).ravel()
            pair = np.repeat(np.arange(to - at), n[i[at:to]] + n[j[at:to]])
            size = n[sets]
            values = h[np.repeat(first[sets] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            order = np.lexsort((values, pair))
            v, p = values[order], pair[order]
            twice = (v[1:] == v[:-1]) & (p[1:] == p[:-1])
            common[at:to] = np.bincount(p[1:][twice], minlength=to - at)
            at = to
    else:  # nearly all pairs: products of 0/1 matrices, some shared shingles and some rows at a time
        at = np.concatenate([np.arange(first[d], first[d + 1]) for d in own]) if len(own) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(own)), n[own])
        _, column, times = np.unique(h[at], return_inverse=True, return_counts=True)
        shared = times > 1  # only these can be in common
        name = np.cumsum(shared) - 1
        on = shared[column]
        row, column = row[on], name[column[on]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        ri, rj = np.searchsorted(own, i), np.searchsorted(own, j)
        by_row = np.argsort(ri, kind="stable")
        for lo in range(0, int(shared.sum()), columns):
            x, y = np.searchsorted(column, [lo, lo + columns])
            m = np.zeros((len(own), min(columns, int(shared.sum()) - lo)), np.float32)
            m[row[x:y], column[x:y] - lo] = 1
            for r in range(0, len(own), rows):
                a, b = np.searchsorted(ri[by_row], [r, r + rows])
                if b > a:
                    pick = by_row[a:b]
                    common[pick] += (m[r : r + rows] @ m.T)[ri[pick] - r, rj[pick]].astype(np.int64)
    either = n[i] + n[j] - common
    return common * 1_000_000 >= round(threshold * 1_000_000) * either


def _sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, pa.Array]]]:
    """Groups of rows of equal keys from sorted batches, also across them."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        t = t.combine_chunks()
        ks = [np.asarray(B.column(t, k)) for k in keys]
        edge = np.zeros(max(0, t.num_rows - 1), bool)
        for k in ks:
            edge |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(edge) + 1).tolist()]
        for lo, hi in zip(cuts, cuts[1:]):
            yield tuple(k[lo] for k in ks), {n: B.column(t, n).slice(lo, hi - lo) for n in t.column_names}
        rest = t.slice(cuts[-1]) if t.num_rows else None
    if rest is not None and rest.num_rows:
        rest = rest.combine_chunks()
        yield tuple(B.column(rest, k)[0].as_py() for k in keys), {n: B.column(rest, n) for n in rest.column_names}
