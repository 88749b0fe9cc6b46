"""Substring deduplication by difference-cover anchors.

Words are runs of characters other than ASCII white space. Anchors are windows of LENGTH - PERIOD + 1 words,
hashed only at positions whose residue modulo PERIOD is in a difference cover: for any two residues there is a
shift that takes both into the cover, so two equal windows of LENGTH words always share an anchor at the
same place within them. Anchors that occur in two documents mark the windows that may repeat; these are
extended to LENGTH words, hashed to 96 bits and compared, and the smallest document of each sequence keeps it.

Both questions (is this anchor elsewhere, does a smaller document hold this window) go from blocks of documents to the
hashes and back, see blocks.py: linear in the text, whatever repeats how often. Blocks send each hash once, and only
what is held elsewhere comes back.

Defined results: null and empty texts have no words; rows of a null doc_id neither remove nor lose words;
rows that repeat a doc_id do not remove from each other; an empty table gives no row; a text of any length
is read whole; further columns can be carried by joining on doc_id.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .common import cut, partitions, text_of

#: A perfect difference set modulo 31: every residue is a difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
BLOCK_BYTES = 4 << 20
BLOCKS = "block long, doc_ids array<long>, bytes binary, ends binary"
_SECOND = 0xC2B2AE3D27D4EB4F


def text_blocks(docs: DataFrame, text: str) -> DataFrame:
    """One row per block of documents: their ids and compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t in enumerate(B.concat_batches(batches, BLOCK_BYTES)):
            data, offsets = B.text_buffer(B.column(t, "text"))
            yield pa.RecordBatch.from_arrays([pa.array([B.block_number(k)], pa.int64()), pa.array([B.column(t, "doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([B.squeeze(data, 3)], pa.binary()), pa.array([B.squeeze(offsets[1:])], pa.binary())], ["block", "doc_ids", "bytes", "ends"])

    return cut(docs.select(F.col("doc_id").cast("long"), text_of(docs, text).alias("text")).mapInArrow(B.lean(run), BLOCKS), "texts")


class Block:
    """A block's words, and where windows of a length may start."""

    def __init__(self, row: dict):
        self.data = B.expand(row["bytes"], np.uint8)
        self.offsets = np.concatenate([[0], B.expand(row["ends"], np.int64)])
        self.starts, self.ends, self.first = B.words(self.data, self.offsets)
        self.hashes = B.hash_spans(self.data, self.starts, self.ends)
        ids = row["doc_ids"]
        self.known = np.asarray(ids.is_valid())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n_words)), self.n_words)

    def fits(self, at: np.ndarray, length: int) -> np.ndarray:
        return at + length <= self.first[self.doc[at] + 1]


class Keys:
    """Distinct keys among a block's places, with the smallest doc_id of each and whether two ids hold it."""

    def __init__(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids, low, high))
        h, lo, i = high[order], low[order], ids[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
        group = np.cumsum(new) - 1
        self.of = np.empty(len(order), np.int64)  # the key's number by place
        self.of[order] = group
        self.high, self.low, self.least = h[new], lo[new], i[new]
        last = np.append(np.flatnonzero(new), len(order))[1:] - 1  # none where there is no place
        self.many = i[last] != self.least

    def told(self, places: np.ndarray) -> np.ndarray:
        """By key: is it among the answers."""
        out = np.zeros(len(self.low), bool)
        out[places] = True
        return out


def _anchors(b: Block, length: int) -> np.ndarray:
    """Places (words of the block) of the anchors."""
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    at = np.flatnonzero(cover[(np.arange(len(b.doc)) - b.first[b.doc]) % PERIOD]) if len(b.doc) else np.zeros(0, np.int64)
    return at[b.fits(at, length - PERIOD + 1) & (b.n_words[b.doc[at]] >= length) & b.known[b.doc[at]]]


def _anchor_keys(b: Block, length: int) -> tuple[np.ndarray, Keys]:
    at = _anchors(b, length)
    h = B.windows(b.hashes, length - PERIOD + 1)[at]
    return at, Keys(np.zeros(len(at), np.int32), h, b.ids[b.doc[at]])


def _window_keys(b: Block, length: int, shared_anchors: np.ndarray) -> tuple[np.ndarray, Keys]:
    """Windows of `length` words that hold an anchor which another document has too."""
    at, keys = _anchor_keys(b, length)
    shared = at[(keys.told(shared_anchors) | keys.many)[keys.of]]
    marks = np.zeros(len(b.doc) + 1, np.int32)
    np.add.at(marks, np.maximum(shared - (PERIOD - 1), b.first[b.doc[shared]]), 1)
    np.add.at(marks, shared + 1, -1)
    w = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
    w = w[b.fits(w, length)]
    high = (B.windows(B.mix(b.hashes ^ np.uint64(_SECOND)), length, _SECOND)[w] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return w, Keys(high, B.windows(b.hashes, length)[w], b.ids[b.doc[w]])


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 50, digests: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, and kept_sha256 of the kept words joined by one space or, without
    digests, the kept words themselves (column text), the removed runs of words (column removed) and the whole text's
    digest (text_sha256)."""
    parts = partitions(docs.sparkSession)
    packed = text_blocks(docs, text)
    columns = ["doc_ids", "bytes", "ends"]

    def ask_anchors(row: dict) -> dict:
        keys = _anchor_keys(Block(row), length)[1]
        return {"low": keys.low.view(np.int64), "least": keys.least}

    def ask_windows(row: dict, shared_anchors: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = _window_keys(Block(row), length, shared_anchors)[1]
        n = len(keys.low)
        for lo in range(0, n, 1 << 17):
            own = slice(lo, min(n, lo + (1 << 17)))
            yield pa.RecordBatch.from_arrays([
                pa.array(keys.low[own].view(np.int64)), pa.array(keys.high[own]), pa.array(keys.least[own]),
                pa.array(np.full(own.stop - lo, row["block"], np.int64)), pa.array(np.arange(lo, own.stop, dtype=np.int32))], ["low", "high", "least", "block", "place"])

    def finish(row: dict, shared_anchors: np.ndarray, held_before: np.ndarray) -> Iterator[pa.RecordBatch]:
        b = Block(row)
        w, keys = _window_keys(b, length, shared_anchors)
        gone = w[(b.ids[b.doc[w]] > keys.least[keys.of]) | keys.told(held_before)[keys.of]]
        marks = np.zeros(len(b.doc) + 1, np.int32)
        np.add.at(marks, gone, 1)
        np.add.at(marks, gone + length, -1)
        drop = np.cumsum(marks[:-1]) > 0
        yield from _results(b, row["doc_ids"], drop, digests)

    anchor, window = Window.partitionBy("low"), Window.partitionBy("low", "high")
    asked = B.ask(packed, ask_anchors, columns, "low long, least long").repartition(parts, "low")
    elsewhere = asked.withColumns({"a": F.min("least").over(anchor), "z": F.max("least").over(anchor)}).where("a <> z").select("block", "place")
    elsewhere = cut(elsewhere, "anchors")
    asked = B.meet(packed, columns, [elsewhere], parts, ask_windows, "low long, high int, least long, block long, place int").repartition(parts, "low")
    before = asked.withColumn("a", F.min("least").over(window)).where("least > a").select("block", "place")
    schema = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digests else "text string, removed array<struct<start: long, end: long>>, text_sha256 string")
    return B.meet(packed, columns, [elsewhere, before], parts, finish, schema)


def _results(b: Block, doc_ids: pa.Array, drop: np.ndarray, digests: bool, step: int = 2_000) -> Iterator[pa.RecordBatch]:
    raw = b.data.tobytes()
    removed = np.add.reduceat(np.append(drop, False).astype(np.int64), np.minimum(b.first[:-1], len(drop))) * (b.n_words > 0) if len(b.n_words) else np.zeros(0, np.int64)
    for at in range(0, len(b.n_words), step):
        rows = range(at, min(at + step, len(b.n_words)))
        kept, cuts = [], []
        for d in rows:
            lo, hi = int(b.first[d]), int(b.first[d + 1])
            body = raw[b.offsets[d] : b.offsets[d + 1]]
            if not removed[d]:
                kept.append(b" ".join(body.split()))
                cuts.append([])
                continue
            flags = drop[lo:hi]
            kept.append(b" ".join([x for x, gone in zip(body.split(), flags.tolist()) if not gone]))
            edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
            cuts.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])])
        head = [doc_ids.slice(at, len(rows)), pa.array(b.n_words[rows.start : rows.stop], pa.int64()), pa.array(removed[rows.start : rows.stop], pa.int64())]
        if digests:
            yield pa.RecordBatch.from_arrays([*head, pa.array([hashlib.sha256(k).hexdigest() for k in kept])], ["doc_id", "n_words", "n_removed", "kept_sha256"])
        else:
            whole = pa.array([hashlib.sha256(raw[b.offsets[d] : b.offsets[d + 1]]).hexdigest() for d in rows])
            yield pa.RecordBatch.from_arrays([*head, pa.array([k.decode("utf-8", "replace") for k in kept]), pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), whole], ["doc_id", "n_words", "n_removed", "text", "removed", "text_sha256"])
