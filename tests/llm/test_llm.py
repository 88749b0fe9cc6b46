"""The training-data operators against brute force, exact round trips and defined results for odd tables."""
import collections
import hashlib
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.llm import bpe, chat, common, components, decontaminate, html, ngram_join, quality_gam, quality_rules, substring, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, bucket int, block long, rank int, rep string, h string, n long"
random.seed(5)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(random.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, near copies, shared passages."""
    base, passage, long = prose(80), prose(70), prose(20_000)
    near = base.split()
    near[40] = "zzz"
    texts = {1: base, 2: base, 3: " ".join(near), 4: None, 5: "", 6: " \n\t ", 7: "a b c", 8: f"{prose(30)} {passage} {prose(30)}", 9: f"{passage} {prose(10)}", 10: f"{prose(5)}\n{passage}",
             11: long, 12: long, 13: "x " * 120, 14: "é　ö <|endoftext|> 's 12ab\r\n\r\n  tail ", 15: prose(49), 16: prose(50), 17: "word" * 5000}
    rows = [(i, t, i, i, i, "r", "h", 1) for i, t in texts.items()]
    return [*rows, rows[0], rows[7], (None, base, 0, 0, 0, "", "", 0), (None, None, 0, 0, 0, "", "", 0)]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


# --- blocks' hashing ---------------------------------------------------------------------------------------------
def test_word_hashes_follow_words_only():
    import pyarrow as pa

    from meshloom.llm import blocks as B

    texts = ["a bb  a", "", None, "bb", "\x0ba b a", "x" * 3_000_000 + " a"]
    data, offsets = B.text_buffer(pa.array(texts))
    s, e, first = B.words(data, offsets)
    raw = data.tobytes()
    want = [w for t in texts for w in (t or "").encode().split()]
    assert [raw[a:b] for a, b in zip(s, e)] == want
    h = B.hash_spans(data, s, e).tolist()
    assert all((h[i] == h[j]) == (want[i] == want[j]) for i in range(len(want)) for j in range(len(want)))
    assert list(np.diff(first)) == [3, 0, 0, 1, 2, 2]
    for length in (1, 2, 3, 7, 20, 50):
        a = np.array([1, 2, 3] * 40, np.uint64)
        w = B.windows(a, length)
        assert len(w) == 121 - length and w[0] == w[3] and (length % 3 == 0 or w[0] != w[1] or length == 0)


# --- 1 toxicity --------------------------------------------------------------------------------------------------
def test_toxicity_learns_words_from_document_labels(spark):
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        s = [prose(8) + "." for _ in range(random.randint(1, 12))]
        if bad:
            s[len(s) // 2] = f"{prose(3)} {random.choice(['vileword', 'Nastything', 'grimterm'])} {prose(3)}."
        rows.append({"y": int(bad), "text": " ".join(s)})
    model = toxicity.fit(rows)
    docs = [(1, f"{prose(40)}. You are a VILEWORD indeed. {prose(40)}."), (2, f"{prose(60)}."), (3, None), (None, "grimterm!")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert got[1].score > 0.7 and got[2].score < 0.3 and got[3].score < 0.3 and got[None].score > 0.7
    span = got[1].offending[0]
    assert docs[0][1][span.begin : span.end] == "You are a VILEWORD indeed."
    assert toxicity.score(nothing(spark), model).count() == 0


def test_toxicity_without_labels_gives_the_base_rate(spark, odd):
    rows = toxicity.sample(odd, spark.createDataFrame([], "doc_id long, toxic int"), "text", "toxic", 5, 5)
    assert rows == [] and len({round(r.score, 9) for r in toxicity.score(odd.where("text = 'a b c'"), toxicity.fit(rows)).collect()}) == 1


def test_held_out_third_is_not_sampled(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    import zlib

    got = {r.doc_id for r in toxicity.sample(docs, labels, "text", "toxic", 100, 100)}
    assert got == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}


# --- 2 tokens ----------------------------------------------------------------------------------------------------
def test_bpe_equals_the_library(spark, odd, odd_rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = collections.Counter()
    for row in odd_rows:
        ids = t.encode(row[1] or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want[row[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in bpe.encode_decode(odd, path).collect()) == want
    assert all(r.decoded == (dict((a, b) for a, b, *_ in odd_rows)[r.doc_id] or "") for r in bpe.encode_decode(odd.where("doc_id is not null"), path, digests=False).collect())
    assert bpe.encode_decode(nothing(spark), path).count() == 0


# --- 3 archives --------------------------------------------------------------------------------------------------
def test_warc_round_trip_and_revisits(spark, tmp_path):
    big, small = b"<html>" + b"x" * 200, b"tiny"
    rows = [(3, "http://a/b c", big), (1, None, big), (2, "u", big), (4, "u", small), (5, "u", small), (6, "u", None), (None, "u", big), (2, "u", big)] + [(100 + i, "u", f"page {i} ".encode() * 60) for i in range(300)]
    pages = spark.createDataFrame(rows, "id long, uri string, payload binary").repartition(2)
    folder = warc.make_folder(f"file://{tmp_path}/w")
    assert warc.write_archives(warc.mark_revisits(pages), folder, 20_000).agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(set)
    for r in got:
        by[r.id].add((r.record_type, r.refers_to, r.payload_bytes, r.payload_digest))
    d = hashlib.sha256(big).hexdigest()
    assert by[1] == {("response", None, 206, d)} and by[2] == by[3] == {("revisit", 1, 206, d)} and by[None] == {("response", None, 206, d)}
    assert by[4] == by[5] == {("response", None, 4, hashlib.sha256(small).hexdigest())} and by[6] == {("response", None, 0, hashlib.sha256(b"").hexdigest())}
    empty = warc.make_folder(f"file://{tmp_path}/e")
    assert warc.write_archives(warc.mark_revisits(pages.where("id = -1")), empty).count() == 0 and warc.read_archives(spark, empty).count() == 0


def test_broken_archives_are_refused():
    records = [warc.record(i, "u", b"p%d" % i * 900, hashlib.sha256(b"p%d" % i * 900).hexdigest(), None) for i in range(200)]
    good = warc.pack(records)
    assert good[:4] == b"\x5d\x2a\x4d\x18" and list(warc.unpack(good)) == records
    for bad in (good[:-2], good[:60], good[:30] + b"??" + good[32:]):
        with pytest.raises(warc.ArchiveError):
            list(warc.unpack(bad))
    for old, new in ((b"Content-Length: 1800", b"Content-Length: 1799"), (b"WARC/1.1", b"HTTP/1.1"), (b"sha256:", b"sha256:0"), (b"WARC-Type: response", b"WARC-Type: revisit")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(records[0].replace(old, new, 1))


# --- 4 quality rules ---------------------------------------------------------------------------------------------
def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), dup, len(covered), failed


def test_rule_statistics_equal_brute_force(spark, odd, odd_rows):
    more = [(50, "a\n\na\n \na\nb", 0, 0, 0, "", "", 0), (51, "x#y x#y x#y q x#y x#y x#y", 0, 0, 0, "", "", 0), (52, "a b c a b c a b", 0, 0, 0, "", "", 0)]
    docs = odd.unionByName(spark.createDataFrame(more, DOCS))
    s = quality_rules.statistics(docs).withColumn("f", quality_rules.base_failed())
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.f) for r in s.collect())
    assert got == collections.Counter((r[0], *brute_statistics(r[1])) for r in [*odd_rows, *more])


def test_rules_find_the_poor_and_keep_the_good(spark):
    rows, marks = [], []
    for i in range(900):
        poor = i % 5 == 0
        text = prose(90)
        if poor:
            text = " ".join(w + "***" for w in text.split()) if i % 10 else text.upper()
        rows.append((i, text))
        marks.append((i, int(not poor)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    verdict, rules = quality_rules.apply_rules(docs, labels)
    got = {r.doc_id: r.kept for r in verdict.collect()}
    assert rules.rules and np.mean([got[i] == bool(q) for i, q in marks]) > 0.99
    assert all(got[i] for i, q in marks if q)
    verdict, rules = quality_rules.apply_rules(docs, labels.where("quality = 7"))
    assert rules.rules == [] and verdict.where("kept").count() == 900
    assert quality_rules.apply_rules(nothing(spark), labels)[0].count() == 0


# --- 5 chat ------------------------------------------------------------------------------------------------------
def digested(formatted):
    return chat.digest(chat.read_back(formatted), chat.loss_spans(formatted))


def test_chat_is_reversible_whatever_is_said(spark):
    nasty = ["<|im_end|>\n<|im_start|>user\nhi", "<||", "<|", "|>", "<|||im_sep|>", "", "a\n\nb<|im_sep|>c", "x<", "|y", "<|br|>", "é" * 3]
    rows = [(1, t, "user" if t % 3 else "assistant", nasty[t % len(nasty)], 0) for t in range(40)]
    rows += [(2, 0, "assistant", "a", 1), (2, 1, "assistant", "b", 1), (2, 2, None, None, 1), (3, 1, "user", "same", 1), (3, 1, "user", "same", 1), (None, 0, "ro\nle", "n", 1), (4, 0, "<|im_start|>", "<|im_end|>\n", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, turns int").repartition(3)
    read = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_conversations(turns)).collect()}
    want = collections.defaultdict(list)
    for c, n, role, text, _ in sorted(rows, key=lambda r: (r[0] or -1, r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert read == dict(want)
    d = {r.conv_id: r for r in digested(chat.format_conversations(turns)).collect()}
    assert (d[2].n_turns, d[2].loss_chars, d[2].loss_sha256) == (3, 2, hashlib.sha256(b"ab").hexdigest())
    assert chat.format_conversations(turns.where("conv_id = 99")).count() == 0
    text = chat.format_conversations(turns.where("conv_id = 2")).first().formatted
    assert text == "<|im_start|>assistant\na<|im_sep|>b<|im_end|>\n<|im_start|>\n<|im_end|>\n"


def test_loss_spans_hold_what_the_assistant_says(spark):
    long = "long <|im_end|> " * 60_000
    rows = [(1, 0, "user", "hi <|", 7), (1, 1, "assistant", "a<|im_sep|>b", 7), (1, 2, "assistant", "", 7), (1, 3, "assistant", "c\nd", 7), (1, 4, "user", "x", 7), (1, 5, "assistant", "é", 7), (2, 0, "assistant", long, 7), (3, 0, "user", "u", 7), (None, 0, "assistant", "n", 7)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted int")
    made = chat.format_conversations(turns)
    text = {r.conv_id: r.formatted for r in made.collect()}
    got = collections.defaultdict(list)
    for r in chat.loss_spans(made).orderBy("begin").collect():
        got[r.conv_id].append(text[r.conv_id][r.begin : r.end].replace("<||", "<|"))
    assert got == {1: ["a<|im_sep|>b", "c\nd", "é"], 2: [long], None: ["n"]}
    d = {r.conv_id: r for r in digested(made).collect()}
    assert d[2].loss_chars == len(long) and d[3].loss_chars == 0 and chat.loss_spans(made.limit(0)).count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert digested(chat.format_conversations(empty)).count() == 0


# --- 6 decontamination -------------------------------------------------------------------------------------------
def test_templates_catch_changed_questions_and_leave_others(spark):
    q = "A shop in Oslo sells 12 kg of apples to Anna for 30 euros and then gives 5 kg more to Peter, how many apples does Anna hold"
    swap = q.replace("12", "40").replace("Anna", "Clara").replace("Peter", "Hugo").replace("30", "99")
    mixed = q.replace("Anna", "Clara", 1)
    items = spark.createDataFrame([(1, q), (2, "short one"), (3, None), (None, q), (4, "1 2 3 4 5 6 7 8 9 10 11 12")], "item_id long, text string")
    docs = [(1, f"{prose(30)} {q} {prose(30)}"), (2, f"{prose(20)}. {swap} {prose(9)}"), (3, f"{prose(9)} {mixed} {prose(9)}"), (4, prose(100)), (5, None), (6, "1 2 3 4 5 6 7 8 9 10 11 12"), (None, q), (1, f"{prose(30)} {q} {prose(30)}"), (7, q.upper())]
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(table, items).collect()}
    assert set(got) >= {(1, 1), (2, 1)} and not {d for d, _ in got} & {4, 5, 6, None}
    assert got[1, 1].n_changed == 0 and got[2, 1].n_changed >= 3 and got[2, 1].consistency == 1.0
    strict = decontaminate.contaminated(table, items, consistency=1.0)
    assert 3 not in {r.doc_id for r in strict.collect()}  # Anna became Clara once and stayed Anna once
    assert decontaminate.contaminated(table.limit(0), items).count() == 0 and decontaminate.contaminated(table, items.limit(0)).count() == 0


def test_templates_without_the_broadcasts(spark, monkeypatch):
    docs, items = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    want = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "HELD", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == want
    inside = {(d.doc_id, b.item_id) for d in docs.collect() for b in items.collect() if b.text in d.text}
    assert {(r[0], r[1]) for r in want} == inside


# --- 7 passages --------------------------------------------------------------------------------------------------
def brute_passages(rows, length=50):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in split:
        for k in range(len(w) - length + 1 if i is not None else 0):
            key = tuple(w[k : k + length])
            first[key] = min(i, first.get(key, i))
    out = collections.Counter()
    for i, w in split:
        drop = [False] * len(w)
        for k in range(len(w) - length + 1 if i is not None else 0):
            if first[tuple(w[k : k + length])] < i:
                drop[k : k + length] = [True] * length
        kept = b" ".join(x for x, d in zip(w, drop) if not d)
        out[i, len(w), sum(drop), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeated_passages_equal_brute_force(spark, odd, odd_rows):
    assert collections.Counter(tuple(r) for r in substring.remove_repeats(odd).collect()) == brute_passages(odd_rows)
    assert substring.remove_repeats(nothing(spark)).count() == 0


def test_difference_cover_and_every_offset(spark):
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))
    passage = prose(50)
    rows = [(i, f"{prose(i)} {passage} {prose(3)}") for i in range(40)] + [(100 + i, f"{prose(i)} {' '.join(passage.split()[:49])} {prose(3)}") for i in range(5)]
    got = collections.Counter(tuple(r) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_passages(rows)
    assert all((r[2] >= 50) == (0 < r[0] < 100) for r in got)


def test_passages_with_texts_and_spans(spark):
    p = prose(60)
    r = {x.doc_id: x for x in substring.remove_repeats(spark.createDataFrame([(1, p), (2, f"one {p} two")], "doc_id long, text string"), digests=False).collect()}
    assert r[2].text == "one two" and [(s.start, s.end) for s in r[2].removed] == [(1, 61)] and r[1].text == p


@pytest.mark.parametrize("repeated", [0, 2])
def test_blocks_in_which_no_passage_repeats(spark, repeated):
    """A document a block: long ones of their own, short, blank and null ones, alone and beside blocks that share a passage."""
    some = random.Random(repeated)
    texts = [" ".join(some.choices(WORDS, k=n)) for n in (90, 49, 50, 70, 20, 21)]
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[2]), (4, "word" * 5000), (5, ""), (6, None), (None, texts[3]), *[(10 + i, f"{texts[4 + i]} {texts[3]}") for i in range(repeated)]]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    assert substring.text_blocks(docs, "text").count() == len(rows)
    assert collections.Counter(tuple(r) for r in substring.remove_repeats(docs).collect()) == brute_passages(rows)
    kept = {r.doc_id: (r.text, r.n_removed) for r in substring.remove_repeats(docs, digests=False).collect()}
    assert kept[1] == (texts[0], 0) and kept[2] == (texts[1], 0) and sum(n for _, n in kept.values()) == 70 * (repeated > 1)


# --- 8 quality model ---------------------------------------------------------------------------------------------
def test_gam_learns_and_scores_odd_texts(spark, odd):
    rows = [{"y": int(i % 3 > 0), "text": prose(60) if i % 3 else " ".join([random.choice(WORDS) + "!!"] * 60)} for i in range(300)]
    model = quality_gam.fit_rows(rows)
    test = spark.createDataFrame([(1, prose(70)), (2, "spam!! " * 70)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality_gam.score(test, model).collect()}
    assert got[1] > 0.5 > got[2]
    scores = [r.score for r in quality_gam.score(odd, model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert quality_gam.score(nothing(spark), quality_gam.fit_rows([])).count() == 0


def test_gam_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fit(x, y)
    assert (0, 1) in model.pairs and ((model.logit(x) > 0) == (y == 1)).mean() > 0.95


# --- 9 near copies -----------------------------------------------------------------------------------------------
def brute_classes(rows, threshold=0.8):
    texts = collections.defaultdict(list)
    for i, t, *_ in rows:
        if i is not None:
            texts[t or ""].append(i)
    reps = [(min(v), frozenset(zip(*[t.encode().split()[k:] for k in range(5)]))) for t, v in texts.items()]
    top, links = list(range(len(reps))), collections.Counter()

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(reps)):
        for b in range(a):
            c = len(reps[a][1] & reps[b][1])
            if c and c >= threshold * (len(reps[a][1]) + len(reps[b][1]) - c) - 1e-12:
                links[a] += 1
                links[b] += 1
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(reps):
        least[find(k)] = min(i, least.get(find(k), i))
    place = {t: k for k, t in enumerate(texts)}
    return collections.Counter((i, None if i is None else least[find(place[t or ""])], 0 if i is None else links[place[t or ""]]) for i, t, *_ in rows)


def test_similar_texts_equal_brute_force(spark, odd, odd_rows):
    assert collections.Counter(tuple(r) for r in ngram_join.similar_texts(odd).collect()) == brute_classes(odd_rows)
    assert ngram_join.similar_texts(nothing(spark)).count() == 0


def test_large_group_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_BUCKET", 16)
    monkeypatch.setattr(ngram_join, "TILE_GROUP", 8)
    base = prose(60).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(i % 3):
            w[random.randrange(60)] = random.choice(WORDS)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in ngram_join.similar_texts(docs).collect()) == brute_classes(rows)


def test_posterior_bounds_drop_only_the_improbable():
    least = ngram_join.least_matches(0.8, 1e-7)
    assert all(a <= b for a, b in zip(list(least.values()), list(least.values())[1:])) and least[128] < 0.8 * 128
    rng = np.random.default_rng(0)
    m = rng.binomial(1, 0.8, (20_000, 128)).cumsum(1)
    assert all((m[:, k - 1] >= v).all() for k, v in least.items())


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (7, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 130)) and 200 not in got


def test_pairs_near_the_threshold_are_all_found(spark):
    """400 pairs whose sets agree to between 0.75 and 0.9, against exact counts: none at 0.8 or more is missed, none below linked."""
    rows, want = [], {}
    for k in range(400):
        own = [f"w{k}x{i}" for i in range(60)]
        other = list(own)
        for at in range(5, 5 + 9 * (1 + k % 2), 9):
            other[at] = "changed"
        cut = 60 - k % 9
        a, b = own[:cut], other[: cut - k % 4]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        want[2 * k + 1] = 2 * k if 5 * len(x & y) >= 4 * len(x | y) else 2 * k + 1
    got = {r.doc_id: r.class_id for r in ngram_join.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in want} == want and 50 < sum(v < k for k, v in want.items()) < 350


def test_both_ways_of_counting_common_shingles_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 40)).astype(np.uint64)) for _ in range(40)]
    h, first = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    i, j = np.triu_indices(40, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.3 for a, b in zip(i, j)]
    assert ngram_join._linked(h, first, i, j, 0.3, columns=7, rows=6).tolist() == want
    some = np.arange(0, len(i), 97)
    assert ngram_join._linked(h, first, i[some], j[some], 0.3).tolist() == [want[k] for k in some]


def test_different_texts_of_one_id_keep_their_own_links(spark):
    a, b, c = prose(60), prose(60), prose(60)
    rows = spark.createDataFrame([(5, a), (5, b), (7, a), (8, b), (9, c)], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.similar_texts(rows).collect()) == [(5, 5, 0), (5, 5, 0), (7, 5, 0), (8, 5, 0), (9, 9, 0)]
    w, v = prose(80), prose(80)
    rows = spark.createDataFrame([(1, w), (1, v), (2, w + " more"), (3, v + " more"), (4, w + " most"), (4, w)], "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in ngram_join.similar_texts(rows).collect()) == [(1, 1, 1), (1, 1, 2), (2, 1, 2), (3, 1, 1), (4, 1, 2), (4, 1, 2)]


def thue_morse(n: int) -> tuple[str, str]:
    """Words that agree under every sum of powers modulo 2**64 when they are long enough."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_long_words_made_to_collide_are_told_apart(spark, n):
    import pyarrow as pa

    from meshloom.llm import blocks as B

    one, two = thue_morse(n)
    data, offsets = B.text_buffer(pa.array([one, two, one]))
    h = B.hash_spans(data, offsets[:-1], offsets[1:])
    assert h[0] == h[2] != h[1]
    rest = prose(49)
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring.remove_repeats(docs).collect()) == [(1, 0), (2, 0), (3, 50)]


# --- 10 pages ----------------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/a">Menu %(k)s</a><li>More</ul></nav>
<div class="ad">Buy %(k)s</div><article><h1>Head %(k)s &amp; co</h1><p class="share">Share this story with friends</p><p>First&nbsp;%(k)s  <b>bold</b>
text<p>Second &lt;%(k)s&gt; %(body)s</p><div class="comments"><p>reader %(k)s</p></div></article><aside>side</aside><form><p>mail</p></form><footer>&copy; x</footer></body></html>"""


def test_wrapper_drops_template_and_page_parts(spark):
    pages = [(i, f"http://h.example/{i}", PAGE % {"k": f"k{i}", "body": prose(20)}) for i in range(8)] + [(20, None, None), (21, "bad url", ""), (22, "http://one.example/", "<p>Only <b>this"), (23, "http://one.example/", "<body><div>a<br>b</div>c &am")]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")).collect()}
    body = pages[3][2].split("&gt; ")[1].split("</p>")[0]
    assert got[3].text == f"Head k3 & co\nFirst k3 bold text\nSecond <k3> {body}" and got[3].n_chars == len(got[3].text)
    assert got[20].text == got[21].text == "" and got[22].text == "Only this" and got[23].text == "a b\nc &am"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_of_one_article_are_no_template():
    same = [PAGE % {"k": "k", "body": "always the same body of text"} for _ in range(6)]
    w = html.induce(same)
    assert w["constant"] == [] and "always the same body of text" in "\n".join(html.blocks(html.parse(same[0]), w))


def test_tree_matching_aligns_the_common_part():
    a, b = html.parse("<div><p>1</p><ul><li>x</ul><p>2</p></div>"), html.parse("<div><ul><li>y</ul><p>3</p></div>")
    found = {}
    assert html.match(a, b, found) == 5
    assert {x.tag: html.own_text(y) for x, y in found.items() if x.tag in ("li", "p")} == {"li": "y", "p": "3"}


BY_ID = '<html><body><article><div id="%s"><p>%s</p></div><div id="%s"><p>%s</p></div></article></body></html>'


@pytest.mark.parametrize("first", ["body", "comments"])
def test_parts_told_by_their_id_alone(spark, first):
    pages, want = [], {}
    for i in range(8):
        want[i] = f"story {i} {prose(12)}"
        parts = [("body", want[i]), ("comments", f"reader {i} {prose(9)}")]
        a, b = parts if first == "body" else parts[::-1]
        pages.append((i, f"http://ids.example/{i}", BY_ID % (*a, *b)))
    got = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_templates_with_amounts_in_other_words_and_shifts(spark):
    plain = iter(f"w{c}{d}" for c in "abcdefgh" for d in "abcdefgh")
    q = [next(plain) for _ in range(15)] + ["12kg"] + [next(plain) for _ in range(14)]
    where = lambda *new: " ".join([*q[:15], *new, *q[16:]])
    long = [f"v{c}{d}" for c in "abcdef" for d in "abcdefghij"]
    shifted = [*long[:20], "added", *long[20:40], "added", *long[40:]]
    docs = [where("12kg"), where("12", "kg"), where("twenty", "five", "kg"), where("twenty-five"), where("12%"), where("12", "percent"), where("12kg", "once", "more"), where(), " ".join(shifted), " ".join(q[:15])]
    table = spark.createDataFrame([(i, f"{prose(12)} {t} {prose(12)}") for i, t in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(table, spark.createDataFrame([(1, " ".join(q)), (2, " ".join(long))], "item_id long, text string")).collect()}
    assert set(got) == set(range(9))  # the last one holds 8 of 23 windows
    assert all(got[i].n_windows == 23 for i in range(6)) and got[7].n_windows == 15 and got[8].n_windows == 39
    assert got[0].n_changed == got[1].n_changed == 0 and got[2].n_changed == got[3].n_changed == 1


def test_amounts_have_one_value_in_figures_and_words():
    want = {"five": "5", "twenty five": "25", "three hundred two kg": "302 kg", "two thousand one hundred": "2100", "12 million": "12 million", "hundred": "100"}
    assert {k: decontaminate.amount(k.split()) for k in want} == want
    assert decontaminate.canonical("Twenty-five,")[4] == "25" and decontaminate.canonical("(12%)")[4] == "12 percent" and decontaminate.canonical("12kg")[4] == "12 kg"


def test_amounts_of_any_length_have_a_value(spark):
    many = ["hundred"] * 3000
    assert decontaminate.amount([*many, "kg"]) == " ".join([*many, "kg"]) != decontaminate.amount([*many, "hundred", "kg"])
    assert decontaminate.amount(many[:2000]) == str(100**2000) and decontaminate.canonical("-".join(many))[1] == decontaminate.NUMBER
    texts = {1: " ".join(many), 2: f"two {'-'.join(many)} kg", 3: "Anna gave seven of the old books to her sister in the spring"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(7, "Paul gave nine of the old books to her sister in the spring")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, items).collect()] == [(3, 7)]


def test_short_items_are_found_where_they_stand_whole(spark):
    items = {1: "Convert 12 kg to grams", 2: "Anna Peter Clara Hugo Jon", 3: "Paris hosts seven old bridges over cold rivers", 4: "What is 7 + 12?", 5: "7 + 12 = 19", 6: "", 7: "Anna 1 Peter 2 Hugo 3 Clara 4 Jon 5 Lisa 6 Max 7"}
    docs = {i: f"{prose(9)} and {t} {prose(9)}" for i, t in items.items()} | {20: f"{prose(9)} Convert 13 kg to grams", 21: f"{prose(9)} Anna Peter Clara Hugo", 22: "convert 12 kg"}
    docs[8], docs[9] = f"See Lyon Paris hosts seven old bridges over cold rivers", items[2]
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(table, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (7, 7), (8, 3), (9, 2)}
    assert all(r.n_windows == r.item_windows == 1 and r.consistency == 1.0 for r in got.values())
    assert got[1, 1].begin == 10 and got[9, 2].begin == 0
