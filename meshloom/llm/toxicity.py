"""Toxicity by multiple-instance learning: a document is toxic if some sentence is.

A sentence's probability is a logistic function of the words and word beginnings in it; a document's is the
noisy-or of its sentences, so document labels alone teach which sentences offend. The weights are fitted by
gradient steps on the noisy-or likelihood over a bounded sample of labelled documents, of which only numbered
features reach the driver; scoring reads every whole text once and returns where the offending sentences are.

Defined results: a null or empty text has no sentence and scores the probability of an empty sentence; a null
doc_id is scored like any other and is not held out; labels of unknown ids and null labels are ignored, of
several labels of one id the largest counts, of several texts of one id the greatest is learned from; repeated rows get equal results; without labels of both kinds every
score is the base rate; an empty table gives no row; further columns are ignored.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import cut, fold, text_of

#: Labelled documents of each kind that the weights are fitted on, at most.
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 2_500, 4_000
LEAST_DOCS = 4
PREFIXES = (4, 5)
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—"


@dataclass
class Model:
    """Weights by word (key "w:") and by beginning of a word ("p:"), and the bias of a sentence."""

    weights: dict[str, float]
    bias: float

    def word(self, word: str) -> float:
        core = word.strip(_STRIP).lower()
        if not core:
            return 0.0
        w = self.weights.get
        return w("w:" + core, 0.0) + sum(w("p:" + core[:k], 0.0) for k in PREFIXES if len(core) > k)


class _Cache(dict):
    """Weight by word as written; emptied when it grows."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
        out = self[word] = self.model.word(word)
        return out


def _features(word: str) -> list[str]:
    core = word.strip(_STRIP).lower()
    return ["w:" + core, *("p:" + core[:k] for k in PREFIXES if len(core) > k)] if core else []


_END = re.compile(r"(?<=[.!?…])\s+|\n+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Where sentences begin and end: after signs of an end before white space, and at line breaks."""
    out, begin = [], 0
    for m in _END.finditer(text):
        if m.start() > begin:
            out.append((begin, m.start()))
        begin = m.end()
    if begin < len(text):
        out.append((begin, len(text)))
    return out


def sampled(docs: DataFrame, labels: DataFrame, text: str, label: str, positive: int, negative: int) -> DataFrame:
    """doc_id, y, text of at most so many labelled documents of each kind from outside the held-out third, chosen by hash."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64(F.col("doc_id"), F.lit(91))
    chosen = marks.where("y = 1").orderBy(order).limit(positive).union(marks.where("y <> 1").orderBy(order).limit(negative))
    # One text per id; at most positive + negative ids are sent to the executors.
    return docs.select(F.col("doc_id"), text_of(docs, text).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.max("text").alias("text"))


def in_order(rows: DataFrame) -> list:
    """Rows of a bounded sample, in the order of a hash of doc_id."""
    return rows.orderBy(F.xxhash64(F.col("doc_id"), F.lit(91)), "doc_id").collect()


def sample(docs: DataFrame, labels: DataFrame, text: str, label: str, positive: int, negative: int) -> list:
    """The sampled documents with their texts, on the driver."""
    return in_order(sampled(docs, labels, text, label, positive, negative))


def _bags(text: str) -> list[list[str]]:
    """The features of each sentence's different words; words that begin alike count that beginning each."""
    return [[f for word in set(text[a:b].split()) for f in _features(word)] for a, b in sentences(text)]


def learn(rows: DataFrame) -> Model:
    """A model of rows (doc_id, y, text): features are counted and numbered in Spark, and those of fewer than LEAST_DOCS
    documents never leave it."""
    rows = cut(rows, "labelled")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(sorted(set().union(*_bags(text))), pa.string())], ["feature"])

    counted = rows.select("text").mapInArrow(B.lean(seen), "feature string").groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCS)
    vocabulary = {r.feature: k for k, r in enumerate(counted.select("feature").orderBy("feature").collect())}  # bounded by the sample
    handle = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = handle.value
        for b in batches:
            sizes, held = [], []
            for text in b.column("text").to_pylist():
                bags = [sorted(known[f] for f in bag if f in known) for bag in _bags(text)] or [[]]
                sizes.append(np.array([len(x) for x in bags], "<i4").tobytes())
                held.append(np.array([k for x in bags for k in x], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(sizes, pa.binary()), pa.array(held, pa.binary())], ["doc_id", "y", "sizes", "held"])

    got = in_order(rows.select(F.col("doc_id").cast("long"), "y", "text").mapInArrow(B.lean(numbered), "doc_id long, y int, sizes binary, held binary"))
    y = np.array([r.y == 1 for r in got], float)
    parts = [np.frombuffer(r.sizes, "<i4") for r in got]
    if not len(y) or y.min() == y.max():
        return _base_rate(int(y.sum()), len(y))
    return _descend(y, np.array([len(x) for x in parts]), np.concatenate(parts), np.concatenate([np.frombuffer(r.held, "<i4") for r in got]), vocabulary)


def _base_rate(n_pos: int, n: int) -> Model:
    p = (n_pos + 0.5) / (n + 1)
    return Model({}, float(np.log(-np.log1p(-p)) if p < 0.5 else 2.0))


def fit(rows: list, **how) -> Model:
    """A model of a list of rows (y, 0 or 1, and text), in this process."""
    n_pos = sum(r["y"] == 1 for r in rows)
    if not n_pos or n_pos == len(rows):
        return _base_rate(n_pos, len(rows))
    docs = [_bags(r["text"]) or [[]] for r in rows]
    n = Counter(f for bags in docs for f in set().union(*bags))
    vocabulary = {f: k for k, f in enumerate(sorted(f for f, c in n.items() if c >= LEAST_DOCS))}
    held = [sorted(vocabulary[f] for f in bag if f in vocabulary) for bags in docs for bag in bags]
    return _descend(np.array([r["y"] == 1 for r in rows], float), np.array([len(b) for b in docs]), np.array([len(x) for x in held]), np.array([k for x in held for k in x], np.int32), vocabulary, **how)


def _descend(y: np.ndarray, n_sent: np.ndarray, bag_sizes: np.ndarray, feat: np.ndarray, vocabulary: dict[str, int], rounds: int = 160, rate: float = 0.15, shrink: float = 2e-4) -> Model:
    """Full-batch Adam on the noisy-or likelihood, with a small ridge penalty. y by document, the number of its sentences,
    the number of features by sentence, and the features in a row."""
    doc = np.repeat(np.arange(len(n_sent)), n_sent)
    n_bags = len(bag_sizes)
    sent = np.repeat(np.arange(n_bags, dtype=np.int32), bag_sizes)
    w, bias = np.zeros(len(vocabulary)), float(np.log(max(1e-6, y.mean() / n_sent.mean())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    learns = np.arange(len(y)) % 5 != 4  # rows come in the order of a hash
    weight = np.where(learns, balance, 0.0)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(sent, w[feat], minlength=n_bags)
        soft = np.logaddexp(0, z)  # -log(1 - p) of a sentence
        s = np.bincount(doc, soft, minlength=len(y))
        pull = np.where(y == 1, -np.exp(-s) / np.maximum(1e-12, -np.expm1(-s)), 1.0) * weight
        gz = pull[doc] / (1 + np.exp(-z))
        g = np.bincount(feat, gz[sent], minlength=len(w)) + shrink * w / 100
        gb = gz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        step = rate * min(1.0, 3 * (1 - t / (rounds + 1)))
        w -= step * (m / a) / (np.sqrt(v / c) + 1e-8)
        bias -= step * (mb / a) / (np.sqrt(vb / c) + 1e-8)
        # A weight that a penalty would hold at zero stays there: features in few documents need more evidence.
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * 0.02)
    # Scale and bias are set once more on the part that taught no weight: a bias that is a little too high adds
    # up to a false alarm over many sentences, and weights that fit their own documents are too sure.
    z = np.bincount(sent, w[feat], minlength=n_bags)
    rest = np.flatnonzero(~learns[doc])

    def loss(scale: float, b: float) -> float:
        s = np.bincount(doc[rest], np.logaddexp(0, scale * z[rest] + b), minlength=len(y))
        return float((balance * np.where(y == 1, -np.log(np.maximum(1e-9, -np.expm1(-s))), s))[~learns].sum())

    if len({*y[~learns].tolist()}) == 2:
        scale, bias = min(((a, bias + d) for a in (0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0) for d in np.arange(-12, 2.01, 0.5)), key=lambda x: loss(*x))
        w = w * scale
    return Model({f: float(w[k]) for f, k in vocabulary.items() if abs(w[k]) > 1e-3}, float(bias))


def score(docs: DataFrame, model: Model, text: str = "text", offends: float = 0.5) -> DataFrame:
    """doc_id, score, n_sentences, and offending: array<struct<begin, end, score>> of the sentences of
    probability `offends` or more, as character places in the text."""
    spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    handle = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # bounded by the sample's vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*handle.value)
        cache = _Cache(own)
        for t in B.concat_batches(batches, 4 << 20):
            texts = B.column(t, "text").to_pylist()
            sums: list[float] = []
            sizes = []
            for x in texts:
                n = len(sums)
                sums.extend([sum([cache[w] for w in set(part.split())]) for part in _END.split(x) if part])
                sizes.append(len(sums) - n)
            n_sent = np.array(sizes, np.int64)
            z, doc = own.bias + np.array(sums, float), np.repeat(np.arange(len(texts)), n_sent)
            s = np.bincount(doc, np.logaddexp(0, z), minlength=len(texts)) + (n_sent == 0) * np.logaddexp(0, own.bias)
            risky = np.zeros(len(texts), bool)
            risky[doc[z >= np.log(offends / (1 - offends))]] = True
            found = [_offending(x, cache, own.bias, offends) if r else [] for x, r in zip(texts, risky.tolist())]
            yield pa.RecordBatch.from_arrays([B.column(t, "doc_id"), pa.array(-np.expm1(-s)), pa.array(n_sent, pa.int64()), pa.array(found, spans)], ["doc_id", "score", "n_sentences", "offending"])

    return docs.select(F.col("doc_id").cast("long"), text_of(docs, text).alias("text")).mapInArrow(B.lean(run), "doc_id long, score double, n_sentences long, offending array<struct<begin: long, end: long, score: double>>")


def _offending(text: str, cache: _Cache, bias: float, offends: float) -> list[dict]:
    out = []
    for a, b in sentences(text):
        p = 1 / (1 + np.exp(-(bias + sum(cache[w] for w in set(text[a:b].split())))))
        if p >= offends:
            out.append({"begin": a, "end": b, "score": float(p)})
    return out
