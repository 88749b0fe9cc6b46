"""Word hashing over whole Arrow batches, and the exchange between blocks of documents and the keys they ask about.

Documents are packed into blocks of a bounded size, written once to the shared folder. A block asks about each of its
distinct keys (words, windows) with one row; the rows are shuffled by key, where each key is answered in a sorted stream,
and what was answered is shuffled back by block. A key that many documents share is asked once per block, so no key
makes a group as large as the rows that hold it; no task holds more than a block or a key at a time, and the number of
rows is that of the blocks' distinct keys, whatever the number of blocks and tasks.
"""
from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Random values by byte, odd bases, and their inverses modulo 2**64.
_BYTE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = int(_rng.integers(2**60, 2**62)) * 2 + 1
_SPAN = 1 << 20
#: Bytes of a span up to which sums of powers hash it, and the key of the digest of longer ones.
LONG, _KEY = 256, b"words"
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> U64(32))
    x = x * U64(0x9FB21C651E98DF25)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _SPAN + 1)
        _powers[:] = [np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64), dtype=U64)]) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and its n + 1 offsets into them, without a copy."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the place of its first word (n + 1 places)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~_BLANK[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = ink[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = ink[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by prefix sums over pieces of bounded size; a span of more than LONG bytes is hashed by
    itself with a keyed digest, because long texts can be made that agree modulo 2**64 for every base."""
    out = np.empty(len(starts), U64)
    k = 0
    while k < len(starts):
        j = max(k + 1, int(np.searchsorted(ends, starts[k] + _SPAN, "right")))
        lo, hi = int(starts[k]), int(ends[j - 1])
        up, down = _power(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        out[k:j] = (sums[ends[k:j] - lo] - sums[starts[k:j] - lo]) * down[starts[k:j] - lo]
        k = j
    out = mix(out)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=_KEY).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def windows(h: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of `length` consecutive values (len(h) - length + 1 of them), by doubling."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, power = None, 0, base
    part, size = h, 1  # hashes of runs of `size` values
    left = length
    while left:
        if left & 1:
            if out is None:
                out, done = part, size
            else:  # the run so far, then `size` more
                m = len(h) - done - size + 1
                out = out[:m] * U64(pow(base, size, 2**64)) + part[done : done + m]
                done += size
        left >>= 1
        if left:
            m = len(h) - 2 * size + 1
            part = part[:m] * U64(power) + part[size : size + m]
            size, power = 2 * size, power * power % 2**64
    return mix(out[:n])


def lean(run: Callable) -> Callable:
    """A function over batches that gives the memory of its work back when it ends: workers are used again for other work,
    and would keep it."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library; it keeps what it keeps
                pass

    return wrapped


def squeeze(data: bytes | np.ndarray, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())


def expand(data: bytes, dtype: type | str | None = None) -> np.ndarray | bytes:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if dtype is None else np.frombuffer(raw, dtype)


def concat_batches(batches: Iterator[pa.RecordBatch], bytes_wanted: int) -> Iterator[pa.Table]:
    """Batches put together until they hold bytes_wanted, and cut if one holds far more."""
    held, size = [], 0
    for b in batches:
        step = max(1, int(b.num_rows * min(1, 2 * bytes_wanted / max(1, b.nbytes))))
        for at in range(0, b.num_rows, step):
            piece = b.slice(at, step)
            held.append(piece)
            size += piece.nbytes
            if size >= bytes_wanted:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks == 1 else (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c)


def block_number(k: int) -> int:
    """A number for the k-th block of this task; blocks are written once, so it need not be repeatable."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 24 | k


def ask(blocks: DataFrame, fn: Callable, columns: list[str], schema: str) -> DataFrame:
    """fn takes a dict of a block's columns and gives the columns (a dict of arrays) of its questions, one row a key; they
    are returned with their `block` and `place`, the key's number in the block."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                asked = fn(row)
                n = len(asked[names[0]])
                for lo in range(0, n, 1 << 17):
                    hi = min(n, lo + (1 << 17))
                    place = pa.array(np.arange(lo, hi, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([*[pa.array(asked[c][lo:hi]) for c in names], pa.array(np.full(hi - lo, row["block"], np.int64)), place], [*names, "block", "place"])

    return blocks.select("block", *columns).mapInArrow(lean(run), f"{schema}, block long, place int")


def _packed(answers: DataFrame, rows: int = 1 << 19) -> DataFrame:
    """Rows (block, place) as rows (block, data), each with the places of one block among so many rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            block, place = (np.concatenate([h[k] for h in held]) for k in range(2))
            held.clear()
            order = np.lexsort((place, block))
            block, place = block[order], place[order]
            edges = np.flatnonzero(np.diff(block)) + 1
            starts, ends = [0, *edges.tolist()], [*edges.tolist(), len(block)]
            data = [squeeze(np.diff(place[a:b], prepend=0).astype("<i4")) for a, b in zip(starts, ends)]
            return pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(data, pa.binary())], ["block", "data"])

        for b in batches:
            if b.num_rows:
                held.append((np.asarray(b.column(0)), np.asarray(b.column(1))))
            if sum(len(h[0]) for h in held) >= rows:
                yield flush()
        if held:
            yield flush()

    return answers.select("block", "place").mapInArrow(lean(run), "block long, data binary")


def meet(blocks: DataFrame, columns: list[str], answers: list[DataFrame], parts: int, fn: Callable, schema: str) -> DataFrame:
    """Each block meets its answers again (rows of block and place). fn takes the block's columns and, for each of
    `answers`, the places, and yields RecordBatches of `schema`. Blocks are streamed, one at a time."""
    n = len(answers)
    every = blocks.select("block", F.lit(n).alias("kind"), F.lit(None).cast("binary").alias("data"), *columns)
    for k, a in enumerate(answers):
        every = every.unionByName(_packed(a).withColumn("kind", F.lit(k)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[] for _ in range(n)]
        for b in batches:
            for row in rows_of(b):
                if row["kind"] < n:
                    got[row["kind"]].append(np.cumsum(expand(row["data"], "<i4")))
                    continue
                told = [np.concatenate(g) if g else np.zeros(0, np.int64) for g in got]
                yield from fn({c: row[c] for c in ["block", *columns]}, *told)
                got = [[] for _ in range(n)]

    return every.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(lean(run), schema)


def rows_of(b: pa.RecordBatch) -> Iterator[dict]:
    for i in range(b.num_rows):
        yield {name: b.column(k)[i].as_py() if not pa.types.is_list(b.schema.field(k).type) else b.column(k)[i].values for k, name in enumerate(b.schema.names)}


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple]:
    """Runs of rows of the same key from sorted batches, also across them."""
    now, held = None, []
    for b in batches:
        for row in rows_of(b):
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held
