"""Benchmark decontamination by template canonicalisation.

Words are lower-cased without the punctuation around them; names and amounts become typed placeholders, whose values
are kept as slots. An amount is one placeholder however it is written: 12kg, 12 kg, 12%, 25, twenty-five, twenty five
kg. Windows of WINDOW template words are hashed and joined with the benchmark's; matches of one document, item
and offset are put together, and so are those of nearby offsets (no further from the next than the item has windows), as
inserted and dropped words shift what follows. The slots must be consistent: one value of the item stands for one value
of its type in the document, and no two names of the item for one name. So a question is caught with its numbers and
names changed. A capitalised word is a name wherever it stands, as a sentence may begin with one; a name of several
words is one slot with all of them as its value.

Defined results: a null text is empty; rows of a null doc_id or item_id are never reported; items with
less than two usable windows (fewer words than WINDOW + 1, or windows that are mostly placeholders) are also found where
their words stand whole and unchanged, as one window of the item's own length; an item of figures and signs only
cannot be told from chance and matches nothing; repeated rows are reported once; empty tables give no row; further columns are ignored; texts are read whole.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .common import cut, partitions, text_of

WINDOW, LITERALS = 8, 4
#: Hashes of the benchmark's windows that every task may hold to drop what cannot match before the join;
#: beyond this number the join alone decides.
HELD = 4_000_000
BROADCAST_ROWS = 200_000

# Measuring units, number words, and the signs around words that are not part of them.
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mile miles g kg mg lb lbs pound pounds oz ounce ounces ton tons tonne tonnes s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years ml cl l liter liters litre litres gallon gallons m2 km2 m3 c f k celsius fahrenheit kelvin degree degrees percent cent cents dollar dollars euro euros usd eur gbp yen hz khz mhz w kw mw kwh v mv a ma j kj cal kcal pa kpa bar n kn kb mb gb tb kph mph".split())
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’‚…–—·•§¶"
END = (".", "!", "?", ":", "…")
TENS = {w: 10 * (i + 2) for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
ONES = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
POWERS = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9}
#: Python refuses to write out numbers of more than 4,300 digits, and each further hundred would take longer than the one before.
MOST = 10**4000
PLAIN, NUMBER, NAME = range(3)
_NUMBER = re.compile(r"[\d.,:/]*\d[\d.,:/]*")
_QUANTITY = re.compile(r"([\d.,:/]*\d[\d.,:/]*)([^\W\d_]{1,10}\d?)")


def amount(words: list[str]) -> str:
    """The value of a run of number words, perhaps after figures and before a unit: digits and the unit; where hundreds of hundreds
    go beyond MOST, the words themselves."""
    unit = [words.pop()] if len(words) > 1 and words[-1] in UNITS else []
    if words[0] not in NUMBER_WORDS:
        return " ".join([*words, *unit])
    whole = part = 0
    for w in words:
        if (n := POWERS.get(w)) == 100:
            part = (part or 1) * 100
            if part > MOST:
                return " ".join([*words, *unit])
        elif n:
            whole, part = whole + (part or 1) * n, 0
        else:
            part += TENS.get(w, 0) or ONES.get(w, 0)
    return " ".join([str(whole + part), *unit])


def canonical(word: str) -> tuple[str, int, bool, bool, str]:
    """The word without signs and capitals, its type (NUMBER or PLAIN), whether it looks like a name, whether it ends
    a sentence, and its value. Words that go on with a number or a name depend on the words before and are
    decided later."""
    core = word.strip(PUNCTUATION)
    if not core:
        return "", PLAIN, False, word.endswith(END), ""
    low = core.lower()
    kind, value = PLAIN, low
    if not core.isalpha():
        if _NUMBER.fullmatch(core):
            kind, value = NUMBER, f"{low} percent" if word.rstrip(".,;:!?)\"'").endswith("%") else low
        elif (m := _QUANTITY.fullmatch(low)) and m[2] in UNITS:
            kind, value = NUMBER, f"{m[1]} {m[2]}"
        elif "-" in low and NUMBER_WORDS.issuperset(parts := low.split("-")):
            kind, value = NUMBER, amount(parts)
    elif low in NUMBER_WORDS:
        kind, value = NUMBER, amount([low])
    return low, kind, kind == PLAIN and len(core) > 1 and core[0].isupper() and core[1:].islower(), word.rstrip("\"')]»”’").endswith(END), value


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    sizes = np.array([len(x) for x in raw], np.int64)
    spans = np.cumsum(sizes)
    return B.hash_spans(np.frombuffer(b"".join(raw), np.uint8), spans - sizes, spans) if len(raw) else np.zeros(0, np.uint64)


class Templates:
    """The template words of some texts: hash, type and value by word, and each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = B.words(data, offsets)
        raw = B.hash_spans(data, starts, ends)
        distinct, at, back = np.unique(raw, return_index=True, return_inverse=True)
        body = data.tobytes()
        known = [canonical(body[a:b].decode("utf-8", "replace")) for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        sizes = np.array([len(k[0]) for k in known], np.int64)
        value_hash = _hashes([k[4] for k in known])
        kinds, capital = (np.array([k[c] for k in known], t) for c, t in ((1, np.int8), (2, bool)))
        unit, spoken = (np.array([k[0] in names for k in known], bool) for names in (UNITS, NUMBER_WORDS))
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        keep = sizes[back] > 0  # words of signs only are left out
        kind = kinds[back].copy()
        kind[capital[back]] = NAME
        kind, back, doc = kind[keep], back[keep], doc[keep]
        self.words, self.back, self.low_doc = [k[0] for k in known], back, doc
        same = np.zeros(len(kind), bool)  # the word before is of the same text
        same[1:] = doc[1:] == doc[:-1]
        after = np.zeros(len(kind), bool)  # the word before is a number without a unit in it
        bare = np.array([" " not in k[4] for k in known], bool)
        after[1:] = same[1:] & (kind[:-1] == NUMBER) & bare[back[:-1]]
        more = after & (unit | spoken)[back]  # goes on with the amount before it
        value = value_hash[back]
        heads = np.flatnonzero(~more & np.append(more[1:], False))
        if len(heads):  # amounts of several words
            stops = np.append(np.flatnonzero(~more), len(more))
            stops = stops[np.searchsorted(stops, heads, "right")]
            written = [amount([w for k in back[a:b].tolist() for w in known[k][0].split("-")]) for a, b in zip(heads.tolist(), stops.tolist())]
            value[heads] = _hashes(written)
        kind[more] = NUMBER
        before = np.full(len(kind), -1, np.int8)
        before[1:] = np.where(same[1:], kind[:-1], -1)
        on = ~more & ~((kind == NAME) & (before == NAME))  # an amount or a name of several words is one slot
        name = kind == NAME
        if name.any():  # a name's value is that of all its words, in order
            run = np.cumsum(on)[name] - 1
            nth = np.arange(len(run)) - np.searchsorted(run, run)
            whole = np.zeros(int(on.sum()), np.uint64)
            np.add.at(whole, run, B.mix(value[name] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            heads = np.flatnonzero(on & name)
            value = value.copy()
            value[heads] = whole[np.cumsum(on)[heads] - 1]
        self.kind, self.value, self.doc = kind[on], value[on], doc[on]
        self.hash = np.where(self.kind == PLAIN, self.value, B.mix(self.kind.astype(np.uint64) + np.uint64(77)))
        self.first = np.searchsorted(self.doc, np.arange(len(first)))
        self.low_first, self.place = np.searchsorted(doc, np.arange(len(first))), np.cumsum(on) - 1

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows that lie in one text and have LITERALS plain words at least."""
        h = B.windows(self.hash, WINDOW)
        at = np.arange(len(h))
        plain = np.concatenate([[0], np.cumsum(self.kind == PLAIN)])
        on = (at + WINDOW <= self.first[self.doc[at] + 1]) & (plain[at + WINDOW] - plain[at] >= LITERALS)
        return at[on], h[on]

    def whole(self, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, places and hashes of all runs of so many words of one text, whatever their types: these do not depend
        on the words around. Of equal runs of a text the first counts."""
        low = _hashes(self.words)[self.back]
        for n in lengths:
            h = B.mix(B.windows(low, n) + np.uint64(n))
            at = np.arange(len(h))
            on = at + n <= self.low_first[self.low_doc[at] + 1]
            yield n, at[on], h[on]

    def whole_items(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The same for texts of less than two windows that have a letter, as one run each."""
        n = np.bincount(self.doc[self.windows()[0]], minlength=len(self.first) - 1)
        letters = np.array([any(c.isalpha() for c in w) for w in self.words], bool)[self.back]
        spoken = np.bincount(self.low_doc[letters], minlength=len(n)) > 0
        size = np.diff(self.low_first)
        short = np.flatnonzero((n < 2) & spoken)
        for length, at, h in self.whole(sorted(set(size[short].tolist()))):
            on = np.isin(at, self.low_first[short[size[short] == length]])
            yield length, at[on], h[on]

    def whole_rows(self, ids: pa.Array, length: int, at: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        doc = self.low_doc[at]
        pos, one = self.place[at] - self.first[doc], np.ones(len(at), np.int64)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(h.view(np.int64)), pa.array(pos, pa.int64()), pa.array(one), pa.array([[]] * len(at), pa.list_(pa.int64())), pa.array(one * length)], NAMES)

    def rows(self, ids: pa.Array, at: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        typed = (self.value & ~np.uint64(1) | (self.kind == NAME)).view(np.int64)  # the last bit tells names
        values = [typed[a : a + WINDOW][self.kind[a : a + WINDOW] != PLAIN].tolist() for a in at.tolist()]
        n = np.bincount(self.doc[self.windows()[0]], minlength=len(ids)) if len(at) else np.zeros(len(ids), np.int64)
        doc = self.doc[at]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(h.view(np.int64)), pa.array(at - self.first[doc], pa.int64()), pa.array(n[doc], pa.int64()), pa.array(values, pa.list_(pa.int64())), pa.array(np.zeros(len(at), np.int64))], NAMES)


ROWS = "id long, h long, pos long, n long, slots array<long>, length long"
NAMES = ["id", "h", "pos", "n", "slots", "length"]


def template_windows(rows: DataFrame, only: np.ndarray | None = None, lengths: list[int] | None = None) -> DataFrame:
    """id, h, pos, n (windows of the text), slots of every window, with length 0, and the runs of words of the given
    lengths, with their length, or (None) those that stand for a whole item; with `only` (sorted hashes), of those in it."""

    def held(h: np.ndarray) -> np.ndarray:
        if only is None or not len(only):
            return np.full(len(h), only is None)
        return only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in B.concat_batches(batches, 3 << 20):
            x = Templates(*B.text_buffer(B.column(t, "text")))
            at, h = x.windows()
            hit = held(h)
            at, h = at[hit], h[hit]
            for k in range(0, len(at), 50_000):
                yield x.rows(B.column(t, "id"), at[k : k + 50_000], h[k : k + 50_000])
            for length, at, h in x.whole_items() if lengths is None else x.whole(lengths) if lengths else ():
                hit = held(h)
                at, h = at[hit], h[hit]
                first = np.sort(np.unique(np.stack([x.low_doc[at].astype(np.uint64), h]), axis=1, return_index=True)[1]) if len(at) else at
                at, h = at[first], h[first]
                for k in range(0, len(at), 50_000):
                    yield x.whole_rows(B.column(t, "id"), length, at[k : k + 50_000], h[k : k + 50_000])

    return rows.mapInArrow(B.lean(run), ROWS)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = 0.5, consistency: float = 0.8) -> DataFrame:
    """doc_id, item_id of documents that hold a benchmark item's template: n_windows matched of item_windows,
    n_slots, n_changed (slots whose value differs), consistent share and begin (first matched template word)."""
    spark = docs.sparkSession
    # Every text of an item is searched; a number of its own stands for it until the end.
    texts = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item"), text_of(benchmark).alias("text")).distinct()
    texts = cut(texts.withColumn("id", F.monotonically_increasing_id()), "benchmark")
    items = cut(template_windows(texts.select("id", "text")), "items")
    n_items = items.count()
    only = None
    if n_items <= HELD:  # a size that is checked: 8 bytes a window
        only = np.unique(np.array([r.h for r in items.select("h").distinct().toLocalIterator()], np.int64).view(np.uint64))
    lengths = sorted(r.length for r in items.where("length > 0").select("length").distinct().collect())
    found = template_windows(docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), text_of(docs, text).alias("text")), only, lengths)
    item = items.select(F.col("id").alias("item_id"), "h", F.when(F.col("length") > 0, 0).otherwise(F.col("pos")).alias("item_pos"), F.col("n").alias("item_windows"), F.col("slots").alias("item_slots"))
    pairs = found.select(F.col("id").alias("doc_id"), "h", "pos", "slots").join(F.broadcast(item) if n_items <= BROADCAST_ROWS else item, "h")
    # A slot is (its place in the item's windows, item's value, document's value); windows that overlap repeat it.
    pairs = pairs.withColumn("pair", F.explode_outer(F.when(F.size("slots") > 0, F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")))))
    item_key = ["doc_id", "item_id", "item_windows"]
    slots = pairs.groupBy(*item_key, (F.col("pos") - F.col("item_pos")).alias("offset"), "pair").agg(F.collect_set("item_pos").alias("places"), F.min("pos").alias("begin"))
    # Every offset stands for itself, and once more in the run of nearby offsets that it belongs to.
    order = Window.partitionBy("doc_id", "item_id").orderBy("offset")
    jump = F.coalesce(F.col("offset") - F.lag("offset").over(order) > F.col("item_windows"), F.lit(False))
    runs = slots.withColumn("jump", jump.cast("long")).withColumn("run", F.sum("jump").over(order))
    runs = runs.withColumn("of", F.explode(F.array(F.struct(F.lit(False).alias("merged"), F.col("offset").alias("k")), F.struct(F.lit(True).alias("merged"), F.col("run").alias("k")))))
    runs = runs.groupBy(*item_key, "of", "pair").agg(F.flatten(F.collect_list("places")).alias("places"), F.min("begin").alias("begin"), F.min("offset").alias("offset"))
    name = F.col("pair.a").bitwiseAND(1) == 1
    offsets = runs.groupBy(*item_key, "of").agg(
        F.least(F.size(F.array_distinct(F.flatten(F.collect_list("places")))), "item_windows").alias("n_windows"),
        F.min("begin").alias("begin"),
        F.min("offset").alias("offset"),
        F.count("pair").alias("n_slots"),
        F.count_if(F.col("pair.a") != F.col("pair.b")).alias("n_changed"),
        F.size(F.collect_set("pair.a")).alias("n_values"),
        F.count_if(name).alias("n_names"),
        F.size(F.collect_set(F.when(name, F.col("pair.b")))).alias("n_written"),
    )
    # Of an item's value, one value; of a written name, one name of the item. Two numbers may be the same by chance.
    kept = F.least(F.col("n_values"), F.col("n_slots") - F.col("n_names") + F.col("n_written"))
    whole = offsets.withColumn("consistency", F.when(F.col("n_slots") == 0, 1.0).otherwise(kept / F.col("n_slots")))
    good = whole.where((F.col("n_windows") >= coverage * F.col("item_windows")) & (F.col("consistency") >= consistency))
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", -F.col("offset"), "item_windows", "begin", "n_slots", "n_changed", "consistency")).alias("x"))
    # Of an item's texts the one that the document holds best.
    best = best.join(texts.select(F.col("id").alias("item_id"), "item"), "item_id").groupBy("doc_id", F.col("item").alias("item_id")).agg(F.max("x").alias("x"))
    return best.select("doc_id", "item_id", *[F.col(f"x.{c}").cast("double" if c == "consistency" else "long").alias(c) for c in ("n_windows", "item_windows", "n_slots", "n_changed", "consistency", "begin")])
