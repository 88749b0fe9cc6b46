"""Packing of tokenised documents into sequences of a fixed length, by best fit with exact complements.

Documents become pieces: a task cuts its texts into words in the JVM, encodes each distinct word of a block of texts once, if its worker does not know it yet,
and keeps of a piece its place, length and checksum. What is to be packed is then a histogram, the number of pieces of
each length, which has at most as many entries as a sequence has tokens, whatever the corpus. The plan is made of it on
the driver: for each length, longest first, single, pair and triple sums of the lengths that are still available are
looked up for what is exactly missing, and a combination found is used as often as its lengths are available; what is
left is packed by best fit, which looks for such sums in the gaps it leaves. The plan is a list of patterns (how often, which lengths) of a size bound by the
sequence's length. Pieces of a length are numbered across all tasks (by adding up the tasks' counts), and a number finds its
sequence and offset in the plan's intervals.

Defined results: a null or empty text is one piece of the end token alone; a null doc_id and repeated rows are packed as they
are; an empty table gives no row; texts of any length are encoded whole, in a task's memory of some 10 bytes a token;
only documents of more tokens than a sequence are cut; pieces of equal length are interchangeable, and which of them
stand in which sequence is not defined; other columns are ignored.
"""
from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .bpe import _checked, _take_spans, _tokenizer, split_words
from .common import cut, text_of

#: Tokens of a sequence, the id that ends a document, and the text of a block of documents.
CAPACITY, END_ID, BLOCK_BYTES = 1024, 2, 6 << 20
#: Ways to take exact fillings: passes over all lengths before best fit, each with the numbers of pieces it looks for, and the
#: numbers of pieces that best fit itself looks for to fill a gap together with the piece it places.
ORDERS = ((((1,), (2,), (3,)), (1,)), (((1, 2, 3),), (1,)), (((1,),), (1, 2, 3)), (((1,),), ()))
#: Words whose ids are put together at a time.
STEP = 1 << 18
#: Words that are encoded in one call where that is safe.
TOGETHER = 1000

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, at long"


def pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, with ids also the ids; part and at number the pieces of a length in a task."""
    spec = json.load(open(tokenizer_path, encoding="utf-8"))
    added, source = _checked(spec), json.dumps(spec)
    end = np.array([end_id], "<u4").tobytes()

    def encoded(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the distinct words in a row, and where each word's ids begin and how many they are."""
        texts = words.to_pylist()
        known = _known.setdefault(hash(source), {})
        if len(known) > KNOWN:
            known.clear()
        new = [w for w in texts if w not in known]
        _encode(_tokenizer(source), new, known)
        ids = [known[w] for w in texts]
        sizes = np.array([len(x) for x in ids], np.int64) // 4
        return np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes, sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would wait for others
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for t in B.concat_batches(batches, 2 * BLOCK_BYTES):
            lists = B.column(t, "words")
            doc_ids = B.column(t, "doc_id").to_pylist()
            word_at = np.asarray(lists.offsets).astype(np.int64)
            word_at -= word_at[0]
            coded = lists.flatten().dictionary_encode()
            order = np.asarray(coded.indices).astype(np.int64)
            word_ids, starts, sizes = encoded(coded.dictionary)
            k = 0
            while k < len(doc_ids):
                j = max(k + 1, int(np.searchsorted(word_at, word_at[k] + STEP, "right")) - 1)
                own = order[word_at[k] : word_at[j]]
                lengths = sizes[own]
                raw = _take_spans(word_ids, starts[own], lengths).tobytes()
                edges = np.concatenate([[0], np.cumsum(lengths)])[word_at[k : j + 1] - word_at[k]].tolist()
                rows: list[tuple] = []
                for doc_id, a, b in zip(doc_ids[k:j], edges, edges[1:]):
                    body = raw[4 * a : 4 * b] + end
                    n = b - a + 1
                    ends = range(n % capacity or capacity, n + 1, capacity) if n > capacity else [n]
                    for p, (lo, hi) in enumerate(zip([0, *ends], ends)):
                        mine = body[4 * lo : 4 * hi]
                        rows.append((doc_id, p, lo, hi - lo, zlib.crc32(mine), part, int(seen[hi - lo]), *([np.frombuffer(mine, "<u4").astype(np.int32)] if ids else [])))
                        seen[hi - lo] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names)
                k = j

    names = [f.split()[0] for f in PIECES.split(", ")] + ["ids"] * ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * ids]
    rows = docs.select(F.col("doc_id").cast("long"), split_words(text_of(docs, text), added).alias("words"))
    return rows.mapInArrow(B.lean(run), PIECES + ", ids array<int>" * ids)


def _encode(tokenizer, words: list[str], known: dict[str, bytes]) -> None:
    """Put the ids of words into the table. Words of a space and letters are words again when they stand in a row, and a row costs
    one call."""
    plain = [w for w in words if w[0] == " " and w[1:].isalpha()]
    alone = [w for w in words if not (w[0] == " " and w[1:].isalpha())]
    rows = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
    for k in range(0, len(rows), 64):
        for row, e in zip(rows[k : k + 64], tokenizer.encode_batch(["".join(r) for r in rows[k : k + 64]], add_special_tokens=False)):
            n = np.bincount(np.array(e.word_ids, np.int64))
            if len(n) != len(row):  # a letter that the library does not take for one
                alone += row
                continue
            raw, ends = np.array(e.ids, "<u4").tobytes(), (4 * np.cumsum(n)).tolist()
            known.update(zip(row, [raw[a:b] for a, b in zip([0, *ends], ends)]))
    for k in range(0, len(alone), 4_000):
        for w, e in zip(alone[k : k + 4_000], tokenizer.encode_batch_fast(alone[k : k + 4_000], add_special_tokens=False)):
            known[w] = np.array(e.ids, "<u4").tobytes()


#: Ids of words by tokenizer, kept in a worker from block to block and task to task, and the words from which on it starts anew.
_known: dict[int, dict[str, bytes]] = {}
KNOWN = 400_000


class _Available:
    """Counts by length, and the index of the sums of two available lengths."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] += n
        self._sums: np.ndarray | None = None

    def take(self, pattern: dict[int, int], times: int) -> None:
        for length, m in pattern.items():
            self.left[length] -= m * times
            if not self.left[length]:
                self._sums = None  # a length has gone, and sums with it

    def times(self, pattern: dict[int, int]) -> int:
        return min(int(self.left[x]) // m for x, m in pattern.items())

    @property
    def sums(self) -> np.ndarray:
        """Whether a length is the sum of two available ones (of one twice, too)."""
        if self._sums is None:
            here = self.left > 0
            self._sums = np.zeros(len(here), bool)
            for x in np.flatnonzero(here).tolist():
                self._sums[x:] |= here[: len(here) - x]
        return self._sums

    def below(self, most: int) -> np.ndarray:
        """Available lengths up to `most`, longest first."""
        return np.flatnonzero(self.left[: most + 1] > 0)[::-1]

    def pair(self, total: int, first: list[int]) -> list[int] | None:
        """Two lengths of this sum, as equal as possible, that are available beside those in `first`."""
        if total < 2 or not self.sums[total]:
            return None
        longer = self.below(total - 1)
        longer = longer[2 * longer >= total][::-1]
        for x in longer[self.left[total - longer] > 0].tolist():
            if self.times(_pattern([*first, x, total - x])):
                return [x, total - x]
        return None

    def filling(self, first: list[int], gap: int, many: int) -> list[int] | None:
        """`many` (one, two or three) available lengths of the sum `gap`, beside those in `first`."""
        if many == 1:
            return [gap] if self.left[gap] and self.times(_pattern([*first, gap])) else None
        if many == 2:
            return self.pair(gap, first)
        third = self.below(gap - 2)
        for x in third[self.sums[gap - third]].tolist():
            if self.times(_pattern([*first, x])) and (two := self.pair(gap - x, [*first, x])):
                return [x, *two]
        return None


def _pattern(lengths: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for x in lengths:
        out[x] = out.get(x, 0) + 1
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns (how often, {length: how many of it in a sequence}) that hold every piece of the histogram once.

    Short pieces that fill a gap exactly are missed where only they fit, so the plan is made with the sums taken in several
    orders (ORDERS), and the one of fewest sequences is kept.
    """
    plans = [_plan(counts, capacity, *order) for order in ORDERS]
    return min(plans, key=lambda p: sum(times for times, _ in p))


def _plan(counts: dict[int, int], capacity: int, order: tuple[tuple[int, ...], ...], late: tuple[int, ...]) -> list[tuple[int, dict[int, int]]]:
    free, out = _Available(counts, capacity), []
    for sums in order:
        for length in range(capacity, 0, -1):
            gap = capacity - length
            while free.left[length]:
                rest = next((r for many in sums if (r := free.filling([length], gap, many))), None) if gap else []
                if rest is None:
                    break
                pattern = _pattern([length, *rest])
                out.append((free.times(pattern), pattern))
                free.take(*out[-1][::-1])
    # Best fit, longest first: sequences of one content and gap are a group. A gap that the length and one or two shorter
    # pieces fill exactly comes before the closest one.
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for length in range(capacity, 0, -1):
        while free.left[length]:
            gaps, rest = sorted(g for g in open_ if g >= length), None
            gap, many = gaps[0] if gaps else capacity, 1
            if gap > length:
                gap, rest = next(((g, r) for k in late for g in gaps if g > length and (r := free.filling([length], g - length, k))), (gap, None))
            if rest:
                add = _pattern([length, *rest])
                n, pattern = open_[gap].pop()
                used = min(n, free.times(add))
            else:
                n, pattern = open_[gap].pop() if gaps else (0, {})
                left = int(free.left[length])
                many = min(gap // length, left if not gaps else -(-left // n))
                add, used = {length: many}, left // many if not gaps else min(n, left // many)
            if gaps and not open_[gap]:
                del open_[gap]
            if n > used:
                open_.setdefault(gap, []).append((n - used, pattern))
            free.take(add, used)
            new = {x: pattern.get(x, 0) + add.get(x, 0) for x in [*pattern, *(x for x in add if x not in pattern)]}
            open_.setdefault(gap - sum(x * m for x, m in add.items()), []).append((used, new))
    return out + [x for groups in open_.values() for x in groups]


def intervals(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Of each length, sorted: the first number of its pieces that stand in a pattern, the first sequence of the pattern, how
    many of them a sequence holds, and the offset of the first."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, pattern in patterns:
        offset = 0
        for length, m in pattern.items():
            rows.setdefault(length, []).append((used.get(length, 0), sequence, m, offset))
            used[length] = used.get(length, 0) + times * m
            offset += m * length
        sequence += times
    return {length: np.array(r, np.int64).T for length, r in rows.items()}


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (a written table: it is read three times) with sequence_id and offset."""
    runs = cut_pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = intervals(plan(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = cut_pieces.join(runs, ["part", "length"]).withColumn("number", F.col("at") + F.col("before")).drop("part", "at", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = np.asarray(b.column("length")), np.asarray(b.column("number"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                own = length == x
                first, base, many, at = places[x]
                k = np.searchsorted(first, number[own], "right") - 1
                beyond = number[own] - first[k]
                sequence[own], offset[own] = base[k] + beyond // many[k], at[k] + beyond % many[k] * x
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = [c for c in numbered.columns if c != "number"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number")
    return numbered.mapInArrow(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row a piece, and with ids its ids."""
    return pack(cut(pieces(docs, tokenizer_path, text, capacity, end_id, ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, lengths: the sequences to train on, of pieces with ids; a sequence is at most `capacity` ids."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("rows")).select("sequence_id", F.flatten("rows.ids").alias("ids"), F.transform("rows.ids", lambda x: F.size(x)).alias("lengths"))
