"""Packing: every piece once and whole, sequences no longer than they may be, and no more of them than plain best fit needs."""
import bisect
import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshloom.llm import packing, queries

SCHEMA = "doc_id long, text string, piece int, length string, part int, at int, number int, sequence_id string"


def best_fit_decreasing(counts, capacity):
    gaps, n = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            i = bisect.bisect_left(gaps, length)
            gap = gaps.pop(i) if i < len(gaps) else capacity
            n += gap == capacity
            bisect.insort(gaps, gap - length)
    return n


def fewest(lengths, capacity):
    """The least number of sequences, by trying all."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, gaps):
        if len(gaps) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(gaps)
            return
        for g in {g for g in gaps if g >= lengths[k]}:
            rest = list(gaps)
            rest.remove(g)
            place(k + 1, [*rest, g - lengths[k]])
        place(k + 1, [*gaps, capacity - lengths[k]])

    place(0, [])
    return best[0]


def held(patterns, capacity):
    got = collections.Counter()
    for times, pattern in patterns:
        assert times > 0 and sum(x * m for x, m in pattern.items()) <= capacity
        for x, m in pattern.items():
            got[x] += times * m
    return got


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 24), st.lists(st.integers(1, 24), max_size=10))
def test_small_plans_are_nearly_the_fewest(capacity, lengths):
    counts = collections.Counter(min(x, capacity) for x in lengths)
    patterns = packing.plan(counts, capacity)
    assert held(patterns, capacity) == counts
    n, least = sum(t for t, _ in patterns), fewest(list(counts.elements()), capacity)
    assert least <= n <= least + 1


@pytest.mark.parametrize("n", [50, 1_000, 20_000])
@pytest.mark.parametrize("spread", [0.4, 1.2])
def test_no_more_sequences_than_plain_best_fit(n, spread):
    x = np.minimum(1024, np.random.default_rng(n).lognormal(6, spread, n).astype(int) + 1)
    counts = collections.Counter(x.tolist())
    patterns = packing.plan(counts)
    assert held(patterns, 1024) == counts
    assert sum(t for t, _ in patterns) <= best_fit_decreasing(counts, 1024)


def test_a_plan_does_not_grow_with_the_corpus():
    counts = {x: 10**9 + 17 * x for x in range(1, 1025)}
    patterns = packing.plan(counts)
    assert held(patterns, 1024) == counts and len(patterns) < 4 * 1024
    assert sum(t for t, _ in patterns) - -(-sum(x * n for x, n in counts.items()) // 1024) < 1e-6 * sum(counts.values())


def test_places_of_an_interval():
    at = packing.intervals([(2, {5: 2, 3: 1}), (1, {3: 3})])
    assert at[5].tolist() == [[0], [0], [2], [0]] and at[3].tolist() == [[0, 2], [0, 2], [1, 3], [10, 0]]


def verify(rows, docs, tokenizer, capacity, end_id):
    """rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Documents are told by id and content."""
    want = collections.Counter()
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        first = len(ids) % capacity or capacity
        cuts = [len(ids)] if len(ids) <= capacity else [*range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip([0, *cuts], cuts)):
            want[doc_id, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter(tuple(r[:5]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r[5], []).append((r[6], r[3]))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) <= capacity
    return by


def test_documents_of_any_kind(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = [(i, f"some words {i} " * (i * 7 % 90)) for i in range(150)] + [(200, None), (201, ""), (None, "x y z"), (202, "long text " * 30_000), (203, "a" * 60_000), (204, "<|endoftext|> é 😀\n\n ʰ ᾳ ׳ ª² 𞤀𞤁 ꟲ ǅa  b don't I'll x's  tail "), (5, "another text of 5")]
    docs += [docs[3], docs[3], docs[150], (205, " word" * 1023), (206, " word" * 1024)]
    table = spark.createDataFrame([(i, t, 9, "l", 8, 7, 6, "s") for i, t in docs], SCHEMA).repartition(5)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op13_packing(spark, str(tmp_path)).collect()
    by = verify([tuple(r) for r in rows], docs, tokenizer, 1024, 2)
    assert len(by) <= best_fit_decreasing(collections.Counter(r.length for r in rows), 1024)
    packed = packing.pack_documents(table, path, capacity=100, end_id=7, ids=True).cache()
    by = verify([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in packed.collect()], docs, tokenizer, 100, 7)
    whole = packing.sequences(packed).collect()
    assert len(whole) == len(by) and all(len(s.ids) == sum(s.lengths) <= 100 for s in whole)
    ids = collections.Counter(i for s in whole for i in s.ids)
    assert ids == sum((collections.Counter(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in docs), collections.Counter({7: len(docs)}))
    packed.unpersist()
    assert packing.pack_documents(table.where("false"), path).collect() == []
