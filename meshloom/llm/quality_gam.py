"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, learned by cyclic boosting of shallow trees; then the pairs of
features that explain most of what is left get two-way tables, boosted the same way. A score is the sum of the
looked-up bins through the logistic function, so it can be read feature by feature. The tables are learned
from a bounded sample of labelled documents; scoring adds bins for whole batches at once.

Defined results: a null or empty text has the features of no words and is scored by them; a null doc_id is
scored and not held out; of several labels of one id the largest counts, of several texts of one id the greatest is learned from; repeated rows get equal results;
without labels of both kinds every score is the base rate; an empty table gives no row; further columns are
ignored; texts are read whole.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import text_of
from .toxicity import in_order

#: Labelled documents of each kind that the tables are learned from, at most.
SAMPLE_GOOD, SAMPLE_POOR = 10_000, 6_000
BINS, PAIR_BINS, PAIRS = 48, 12, 8
NAMES = ["words", "word_length", "long_words", "short_words", "capitals", "digits", "symbols", "stops", "exclamations", "bars", "other_signs", "beyond_ascii", "lines", "words_a_line", "sentence_words", "repeated_words", "repeated_pairs", "repeated_triples", "repeated_lines", "commas", "top_word"]


def _counts(data: np.ndarray, offsets: np.ndarray, members: bytes) -> np.ndarray:
    table = np.zeros(256, np.int8)
    table[list(members)] = 1
    total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    return np.diff(total[offsets])


def _repeats(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By document: values that occur before, and how often the most frequent occurs."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(d)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[at], size)
    return np.bincount(d[~new], minlength=n), top


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES per text, from whole texts."""
    n = len(offsets) - 1
    starts, ends, first = B.words(data, offsets)
    words = np.diff(first)
    size = ends - starts
    h = B.hash_spans(data, starts, ends)
    doc = np.repeat(np.arange(n), words)
    per = lambda x: np.bincount(doc, x, minlength=n)
    w = np.maximum(words, 1)
    upper, digits = _counts(data, offsets, bytes(range(65, 91))), _counts(data, offsets, b"0123456789")
    symbols, stops, bangs = _counts(data, offsets, b"#*$%&<>@^~_=+\\/{}[]"), _counts(data, offsets, b".?"), _counts(data, offsets, b"!")
    bars, commas = _counts(data, offsets, b"|"), _counts(data, offsets, b",")
    other, beyond = _counts(data, offsets, b"\"'();:-`"), _counts(data, offsets, bytes(range(192, 256)))
    inked = np.maximum(per(size), 1)
    lines = _counts(data, offsets, b"\n") + 1
    pair, triple = B.windows(h, 2), B.windows(h, 3)
    p2, p3 = doc[: len(pair)] == doc[1:][: len(pair)], doc[: len(triple)] == doc[2:][: len(triple)]
    again, top = _repeats(doc, h, n)
    again2, _ = _repeats(doc[: len(pair)][p2], pair[p2], n)
    again3, _ = _repeats(doc[: len(triple)][p3], triple[p3], n)
    # Lines as runs of words between line breaks: equal lines have equal sums of word hashes, in order.
    breaks = np.concatenate([[0], np.cumsum(data == 10)]) if len(data) else np.zeros(1, np.int64)
    line = breaks[starts] if len(starts) else np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])) if len(starts) else np.zeros(0, np.int64)
    line_hash = B.hash_spans(data, starts[edge], ends[np.append(edge[1:], len(starts)) - 1]) if len(edge) else np.zeros(0, np.uint64)
    again_lines, _ = _repeats(doc[edge], line_hash, n)
    full = np.maximum(np.bincount(doc[edge], minlength=n), 1)
    out = [
        np.log1p(words), inked / w, per(size > 12) / w, per(size < 3) / w, upper / inked, digits / inked, symbols / w, stops / w, bangs / w, bars / w, other / w, beyond / inked,
        np.log1p(full), words / full, words / np.maximum(stops + bangs, 1), again / w, again2 / w, again3 / w, again_lines / full, commas / w, top / w,
    ]
    return np.stack(out, axis=1).astype(np.float64)


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)  # cut points by feature
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)  # coarser cut points by feature
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, k], "right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.pair_edges)]
            for (a, b), t in zip(self.pairs, self.pair_tables):
                out += t[coarse[a], coarse[b]]
        return out


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """A shallow regression tree over a feature's bins: the Newton step of each leaf, by bin."""
    out = np.zeros(len(g))

    def grow(lo: int, hi: int, d: int) -> None:
        gs, hs = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        if d and hi - lo > 1:
            gain = gs[:-1] ** 2 / (hs[:-1] + ridge) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + ridge)
            gain[(hs[:-1] < least) | (hs[-1] - hs[:-1] < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > gs[-1] ** 2 / (hs[-1] + ridge) + 1e-9:
                grow(lo, lo + k + 1, d - 1)
                grow(lo + k + 1, hi, d - 1)
                return
        out[lo:hi] = gs[-1] / (hs[-1] + ridge)

    grow(0, len(g), depth)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of two features at once: four quadrants' Newton steps over the table, and their gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for c in (cg, ch):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        parts.append((a, b, d, c[-1, -1] - a - b - d))
    gain = sum(x * x / (y + ridge) for x, y in zip(*parts))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    steps = [x[i, j] / (y[i, j] + ridge) for x, y in zip(*parts)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = steps
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.12, ridge: float = 2.0, least: float = 2.0, bins: int = BINS, pair_bins: int = PAIR_BINS, pairs: int = PAIRS) -> Gam:
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(p / (1 - p))))
    if len(y) == 0 or y.min() == y.max():
        return model
    n = x.shape[1]
    model.edges = [_cuts(x[:, k], bins) for k in range(n)]
    binned = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    out = np.full(len(y), model.base)
    for _ in range(rounds):
        for k in range(n):  # one feature after the other: cyclic boosting
            if len(model.edges[k]) == 0:
                continue
            q = 1 / (1 + np.exp(-out))
            m = len(model.tables[k])
            step = rate * _tree(np.bincount(binned[k], y - q, minlength=m), np.bincount(binned[k], q * (1 - q), minlength=m), 2, ridge, least)
            model.tables[k] += step
            out += step[binned[k]]
    model.pair_edges = [_cuts(x[:, k], pair_bins) for k in range(n)]
    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.pair_edges)]
    q = 1 / (1 + np.exp(-out))

    def table(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], v, minlength=shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_cross(table(a, b, y - q), table(a, b, q * (1 - q)), ridge)[0], a, b) for a in range(n) for b in range(a + 1, n)), reverse=True)
    model.pairs = [(a, b) for g, a, b in gains[:pairs] if g > 1]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            q = 1 / (1 + np.exp(-out))
            step = rate * _cross(table(a, b, y - q), table(a, b, q * (1 - q)), ridge)[1]
            model.pair_tables[k] += step
            out += step[coarse[a], coarse[b]]
    return model


def fit_rows(rows: list) -> Gam:
    """rows: y (0 or 1) and text."""
    if not rows:
        return Gam(0.0)
    parts = [features(*B.text_buffer(pa.array([r["text"] for r in rows[at : at + 500]], pa.large_string()))) for at in range(0, len(rows), 500)]
    return fit(np.concatenate(parts), np.array([float(r["y"] == 1) for r in rows]))


def learn(rows: DataFrame) -> Gam:
    """A model of rows (doc_id, y, text): features are taken in Spark, so that NAMES numbers a document reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in B.concat_batches(batches, 3 << 20):
            x = features(*B.text_buffer(B.column(t, "text")))
            yield pa.RecordBatch.from_arrays([B.column(t, "doc_id"), B.column(t, "y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = in_order(rows.select(F.col("doc_id").cast("long"), "y", "text").mapInArrow(B.lean(run), "doc_id long, y int, x array<double>"))
    return fit(np.array([r.x for r in got]), np.array([float(r.y == 1) for r in got])) if got else Gam(0.0)


def score(docs: DataFrame, model: Gam, text: str = "text") -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in B.concat_batches(batches, 3 << 20):
            x = features(*B.text_buffer(B.column(t, "text")))
            yield pa.RecordBatch.from_arrays([B.column(t, "doc_id"), pa.array(1 / (1 + np.exp(-model.logit(x))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), text_of(docs, text).alias("text")).mapInArrow(B.lean(run), "doc_id long, score double")
