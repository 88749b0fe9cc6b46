"""BPE encoding and decoding by a distinct-word table.

Spark splits the texts into the words of the tokenizer's own pattern. Blocks of documents keep each document
as positions into the block's distinct words; the words are dealt to buckets by their hash, where each distinct
word is encoded once by the tokenizers library, and its ids are joined back by position. There are so many buckets that
one of them is small whatever the size of the corpus; a task takes its buckets one after another. A block sends a
bucket one packed row, so there are never more rows than distinct words of blocks. Decoding joins the ids to the
vocabulary's pieces, a table of a size fixed by the tokenizer, not by the corpus.

A tokenizer file of another kind than byte-level BPE with this pattern (a normaliser, another pre-tokenizer, flags that
change how its added tokens are found) is refused.

Defined results: a null or empty text has no ids and decodes to the empty text; a null doc_id and repeated
rows are returned as they are; an empty table gives no row; further columns are ignored. A text that holds
the tokenizer's added token gets that token's id, as the library does.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import cut, partitions, text_of

#: The byte-level pattern, with Unicode classes for \s as in the library.
PATTERN = r"""(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text of a block, and text of the corpus for each bucket: more than the distinct words that reach it.
BLOCK_BYTES, BUCKET_BYTES = 24 << 20, 64 << 20


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pieces(path: str) -> list[bytes]:
    """The bytes of each id."""
    spec = json.load(open(path, encoding="utf-8"))
    letters = byte_letters()
    table = {i: bytes(letters[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    table |= {a["id"]: a["content"].encode() for a in spec["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def split_words(text: Column, added: list[str]) -> Column:
    """The array of words; added tokens are words of their own, and the pattern sees only what lies between them."""
    plain = lambda x: F.regexp_extract_all(x, F.lit(PATTERN), F.lit(0))
    if not added:
        return plain(text)
    special = "|".join(re.escape(a) for a in sorted(added, key=len, reverse=True))
    found = F.regexp_extract_all(text, F.lit(f"({special})"), F.lit(1))
    gaps = F.split(text, special, -1)
    parts = F.flatten(F.transform(gaps, lambda x, k: F.concat(plain(x), F.filter(F.array(F.get(found, k)), lambda y: y.isNotNull()))))
    has = F.lit(False)
    for a in added:
        has = has | F.contains(text, F.lit(a))
    return F.when(has, parts).otherwise(plain(text))


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by byte place, which compresses better than in a row."""
    return B.squeeze(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T), 3)


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(B.expand(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _ranked(x: np.ndarray) -> bytes:
    """Positions, of which small ones are frequent: one byte up to 254, two more up to 65,534 beyond that, else four more."""
    few = np.minimum(x, 255).astype(np.uint8)
    rest = x[x >= 255] - 255
    more = np.minimum(rest, 65_535).astype("<u2")
    parts = [B.squeeze(few, 3), B.squeeze(np.ascontiguousarray(more.view(np.uint8).reshape(-1, 2).T), 3), _planes(rest[rest >= 65_535])]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unranked(data: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    out = B.expand(parts[0], np.uint8).astype(np.int64)
    more = np.ascontiguousarray(B.expand(parts[1], np.uint8).reshape(2, -1).T).view("<u2").ravel().astype(np.int64)
    more[more == 65_535] = _numbers(parts[2])
    out[out == 255] = more + 255
    return out


BLOCKS = "block long, doc_ids array<long>, n_words binary, positions binary, word_bytes binary, word_lengths binary, dealt binary"


def word_blocks(docs: DataFrame, text: str, added: list[str], buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of documents: positions into the block's distinct words, these words, and the bucket
    of each, from which a block knows the order of its answers without the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t in enumerate(B.concat_batches(batches, 2 * block_bytes)):
            lists = B.column(t, "words")
            n_words = np.diff(np.asarray(lists.offsets)).astype(np.uint32)
            coded = lists.flatten().dictionary_encode()
            order = np.asarray(coded.indices).astype(np.int64)
            rank = np.argsort(-np.bincount(order, minlength=len(coded.dictionary)), kind="stable")  # frequent words get small positions
            place = np.empty_like(rank)
            place[rank] = np.arange(len(rank))
            data, offsets = B.text_buffer(coded.dictionary.take(pa.array(rank)))
            dealt = B.hash_spans(data, offsets[:-1], offsets[1:]) % np.uint64(buckets)
            yield pa.RecordBatch.from_arrays([
                pa.array([B.block_number(k)], pa.int64()), pa.array([B.column(t, "doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([_planes(n_words)], pa.binary()), pa.array([_ranked(place[order])], pa.binary()),
                pa.array([B.squeeze(data, 3)], pa.binary()), pa.array([_planes(np.diff(offsets))], pa.binary()), pa.array([_planes(dealt)], pa.binary()),
            ], ["block", "doc_ids", "n_words", "positions", "word_bytes", "word_lengths", "dealt"])

    rows = docs.select(F.col("doc_id").cast("long"), split_words(text_of(docs, text), added).alias("words"))
    return cut(rows.mapInArrow(B.lean(run), BLOCKS), "words")


def _dealt(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a block's words sorted by bucket, and the bucket of each."""
    bucket = _numbers(row["dealt"]).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _take_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans data[starts : starts + lengths] in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def _checked(spec: dict) -> list[str]:
    """The added tokens of a tokenizer file that this operator reads as the library does; an error for any other."""
    before, after, model = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}, spec["model"]
    plain = lambda x: x.get("type") == "ByteLevel" and not x.get("add_prefix_space", False) and x.get("use_regex", True)
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or not plain(before) or after.get("type") != "ByteLevel" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        raise ValueError("not a byte-level BPE tokenizer with the byte-level pattern and no normaliser")
    if any(a.get(k) for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that are found by other rules than their own text")
    return [a["content"] for a in spec["added_tokens"]]


def encode_decode(docs: DataFrame, tokenizer_path: str, text: str = "text", digests: bool = True) -> DataFrame:
    """doc_id, n_tokens and, with digests, ids_sha256 and decoded_sha256; without, ids array<int> and decoded string."""
    parts = partitions(docs.sparkSession)
    spec = json.load(open(tokenizer_path, encoding="utf-8"))
    added, source = _checked(spec), json.dumps(spec)
    size = docs.agg(F.sum(F.octet_length(text_of(docs, text)))).first()[0] or 0
    buckets = max(parts, -(-size // BUCKET_BYTES))
    packed = word_blocks(docs, text, added, buckets)

    def asked(row: dict) -> Iterator[tuple[int, bytes]]:
        data, offsets = B.expand(row["word_bytes"], np.uint8), np.concatenate([[0], np.cumsum(_numbers(row["word_lengths"]).astype(np.int64))])
        order, bucket = _dealt(row)
        for lo, hi in _runs(bucket):
            own = order[lo:hi]
            lengths = offsets[own + 1] - offsets[own]
            yield int(bucket[lo]), B.squeeze(len(own).to_bytes(4, "little") + lengths.astype("<u4").tobytes() + _take_spans(data, offsets[own], lengths).tobytes(), 3)

    def encoded(requests: list[bytes]) -> Iterator[bytes]:
        """Every distinct word of the bucket is encoded once, however many blocks ask for it."""
        tokenizer = _tokenizer(source)
        table: dict[bytes, bytes] = {}
        for r in requests:
            raw = B.expand(r)
            n = int.from_bytes(raw[:4], "little")
            ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)).tolist()
            body = raw[4 + 4 * n :]
            wanted = [body[a:b] for a, b in zip([0, *ends], ends)]
            new = [w for w in wanted if w not in table]
            for at in range(0, len(new), 4_000):
                part = new[at : at + 4_000]
                for w, e in zip(part, tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False)):
                    table[w] = np.array(e.ids, "<u4").tobytes()
            ids = [table[w] for w in wanted]
            yield _pair(np.array([len(x) // 4 for x in ids], np.uint32), np.frombuffer(b"".join(ids), "<u4"))

    table = pieces(tokenizer_path)

    def joined(row: dict, got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        order, bucket = _dealt(row)
        n_ids = np.zeros(len(order), np.int64)
        held, starts, size = [], np.zeros(len(order), np.int64), 0
        for lo, hi in _runs(bucket):
            lengths, ids = _unpair(got[int(bucket[lo])])
            own = order[lo:hi]
            if len(lengths) != len(own):
                raise ValueError(f"block {row['block']}: a bucket answered {len(lengths)} of {len(own)} words")
            n_ids[own] = lengths
            starts[own] = size + np.cumsum(lengths) - lengths
            held.append(ids)
            size += len(ids)
        word_ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
        positions, n_words = _unranked(row["positions"]), _numbers(row["n_words"]).astype(np.int64)
        yield from _finish(row["doc_ids"], n_words, positions, starts, n_ids, word_ids, table, digests)

    columns = ["doc_ids", "n_words", "positions", "dealt"]
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return _meet(packed, columns, _answer(_ask(packed, asked, ["word_bytes", "word_lengths", "dealt"]), parts, encoded), parts, joined, schema)


# The exchange. Asking rows: (bucket, block, data); an answer goes back under the same bucket and block.
ASK = "bucket int, block long, data binary"


def _batch(buckets: list[int], blocks: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blocks, pa.int64()), pa.array(data, pa.binary())], ["bucket", "block", "data"])


def _ask(blocks: DataFrame, fn: Callable, columns: list[str]) -> DataFrame:
    """fn takes a dict of a block's columns and yields (bucket, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in B.rows_of(b):
                out = list(fn(row))
                for at in range(0, len(out), 10_000):
                    part = out[at : at + 10_000]
                    yield _batch([k for k, _ in part], [row["block"]] * len(part), [d for _, d in part])

    return blocks.select("block", *columns).mapInArrow(B.lean(run), ASK)


def _answer(asked: DataFrame, parts: int, fn: Callable) -> DataFrame:
    """fn takes the list of a bucket's data and yields the answers in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in B.groups(batches, "bucket"):
            held: list[bytes] = []
            done = 0
            for out in fn([r["data"] for r in rows]):
                held.append(out)
                if len(held) >= 1_000:
                    yield _batch([bucket] * len(held), [r["block"] for r in rows[done : done + len(held)]], held)
                    done, held = done + len(held), []
            if held:
                yield _batch([bucket] * len(held), [r["block"] for r in rows[done:]], held)

    return asked.repartition(parts, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(B.lean(run), ASK)


def _meet(blocks: DataFrame, columns: list[str], answers: DataFrame, parts: int, fn: Callable, schema: str) -> DataFrame:
    """Each block meets its answers again. fn takes the block's columns and a dict bucket -> data, and yields RecordBatches
    of `schema`. Blocks are streamed, one at a time."""
    own = blocks.select("block", F.lit(True).alias("own"), F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("data"), *columns)
    every = own.unionByName(answers.select("block", F.lit(False).alias("own"), "bucket", "data"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, bytes] = {}
        for b in batches:
            for row in B.rows_of(b):
                if not row["own"]:
                    got[row["bucket"]] = row["data"]
                    continue
                yield from fn({c: row[c] for c in ["block", *columns]}, got)
                got = {}

    return every.repartition(parts, "block").sortWithinPartitions("block", "own").mapInArrow(B.lean(run), schema)


_held: dict = {}


def _tokenizer(source: str):
    """The tokenizer, made once per worker."""
    from tokenizers import Tokenizer

    key = hash(source)
    if key not in _held:
        t = Tokenizer.from_str(source)
        t.no_truncation()
        t.no_padding()
        _held[key] = t
    return _held[key]


def _pair(a: np.ndarray, b: np.ndarray) -> bytes:
    first = _planes(a)
    return len(first).to_bytes(4, "little") + first + _planes(b)


def _unpair(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    return _numbers(data[4 : 4 + n]).astype(np.int64), _numbers(data[4 + n :])


def _runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(sorted_keys):
        edges = np.flatnonzero(np.diff(sorted_keys)) + 1
        yield from zip([0, *edges.tolist()], [*edges.tolist(), len(sorted_keys)])


def _finish(doc_ids: pa.Array, n_words: np.ndarray, positions: np.ndarray, starts: np.ndarray, n_ids: np.ndarray, word_ids: np.ndarray, table: list[bytes], digests: bool, step: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Documents' ids and decoded texts from word positions, some documents at a time."""
    piece_data = np.frombuffer(b"".join(table), np.uint8)
    piece_len = np.array([len(p) for p in table], np.int64)
    piece_at = np.cumsum(piece_len) - piece_len
    word_at = np.concatenate([[0], np.cumsum(n_words)])
    k = 0
    while k < len(n_words):
        j = max(k + 1, int(np.searchsorted(word_at, word_at[k] + step, "right")) - 1)
        own = positions[word_at[k] : word_at[j]]
        lengths = n_ids[own]
        ids = _take_spans(word_ids, starts[own], lengths)
        at = np.concatenate([[0], np.cumsum(lengths)])[word_at[k : j + 1] - word_at[k]]
        sizes = piece_len[ids]
        decoded = _take_spans(piece_data, piece_at[ids], sizes).tobytes()
        byte_at = np.concatenate([[0], np.cumsum(sizes)])[at].tolist()
        raw = ids.astype("<u4").tobytes()
        texts = [decoded[a:b].decode("utf-8", "replace") for a, b in zip(byte_at, byte_at[1:])]
        columns = [doc_ids.slice(k, j - k), pa.array(np.diff(at), pa.int64())]
        if digests:
            columns += [pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at.tolist(), at.tolist()[1:])]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        else:
            columns += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(texts)]
            names = ["doc_id", "n_tokens", "ids", "decoded"]
        yield pa.RecordBatch.from_arrays(columns, names)
        k = j
