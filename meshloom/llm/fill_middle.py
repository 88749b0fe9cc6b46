"""Fill-in-the-middle: texts cut at unit ends into prefix, middle and suffix, and written in the order a model learns them in.

The cuts are relational. Each text's units are exploded to their places and lengths (the texts stay behind), running sums
of the lengths over a text give the place where each unit ends, and the two cut requests of a text, which name a number of
units, are joined to them. The two places of a text are aggregated into one row and joined back to it, where
the parts are substrings. Only the last join moves texts, once; the units of a text follow the text's key, so the window,
the join with the requests and the aggregate share one shuffle of (key, place, length).

Defined results: a null text is the empty text and stays plain, as does a text that holds one of the marks; a null doc_id is
hashed as the empty string; repeated rows are cut alike and all stay; an empty table gives no row; a
text of any length is cut whole, one row in the last join and one row a unit before it; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: A line with its end, or the last one without.
LINES = r"[^\n]*\n|[^\n]+"
#: What stands before prefix, suffix and middle in the output. No mark may be a part of another.
MARKS = ("<P>", "<S>", "<M>")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from seed and id: the first four groups of eight digits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def requests(docs: DataFrame, text: str, unit: str, seed: int, share: int, spm: int, marks: tuple[str, str, str]) -> DataFrame:
    """key, doc_id, text, n (units), form, first and second (units before the two cuts) of each row."""
    h = draws(F.col("doc_id"), seed)
    body = text_of(docs, text)
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("text", F.lit(m))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(unit)).cast("long"))
    cuts = [h[k] % (F.col("n") + 1) for k in range(2)]
    plain = (F.length("text") == 0) | marked | (h[2] % 100 >= share)
    # The same id and text have the same cuts, so they may share a key.
    key = F.substring(F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text")).cast("binary"), 256)), 1, 16)
    return rows.select(
        key.alias("key"), "doc_id", "text", "n", F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm").alias("form"),
        F.least(*cuts).alias("first"), F.greatest(*cuts).alias("second"))


def unit_ends(asked: DataFrame, unit: str) -> DataFrame:
    """key, ordinal, end: the characters that the first `ordinal` units of a text hold together."""
    sizes = F.transform(F.regexp_extract_all("text", F.lit(unit), F.lit(0)), lambda u: F.length(u))
    units = asked.select("key", F.posexplode(sizes).alias("place", "size"))
    upto = Window.partitionBy("key").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    copies = F.sum(F.when(F.col("place") == 0, 1).otherwise(0)).over(upto)  # rows of one key: each unit stands there as often
    return units.select("key", (F.col("place") + 1).alias("ordinal"), (F.sum("size").over(upto) / copies).cast("long").alias("end"))


def cut_places(asked: DataFrame, unit: str) -> DataFrame:
    """key, a, b: the characters before the first and the second cut, one row a key."""
    ends = unit_ends(asked, unit)
    wanted = asked.groupBy("key").agg(F.max("first").alias("first"), F.max("second").alias("second"))
    wanted = wanted.select(F.col("key").alias("own"), F.explode(F.array(F.struct(F.lit(0).alias("cut"), F.col("first").alias("ordinal")), F.struct(F.lit(1).alias("cut"), F.col("second").alias("ordinal")))).alias("want"))
    # A difference, not an equation: the two sides stay as they are dealt, by key. A key has two requests, so this is linear in its units.
    found = wanted.join(ends, (F.col("own") == F.col("key")) & (F.col("ordinal") - F.col("want.ordinal") == 0), "left")
    place = lambda k: F.coalesce(F.max(F.when(F.col("want.cut") == k, F.col("end"))), F.lit(0))  # noqa: E731  no unit ends before ordinal 1
    return found.groupBy("own").agg(place(0).alias("a"), place(1).alias("b"))


def transform(docs: DataFrame, text: str = "text", unit: str = LINES, seed: int = 7, share: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (null if plain), output, one row a row of docs.

    Of a hundred texts `share` are cut, of these `spm` in the order suffix, prefix, middle and the rest in the order prefix,
    suffix, middle.
    """
    asked = requests(docs, text, unit, seed, share, spm, marks)
    places = cut_places(asked.where("form <> 'plain'"), unit)
    rows = asked.drop("first", "second").join(places.hint("shuffle_hash"), F.col("key") == F.col("own"), "left")
    prefix, middle, suffix = F.substr("text", F.lit(1), F.col("a").cast("int")), F.substr("text", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")), F.substr("text", (F.col("b") + 1).cast("int"))
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again, from output and form alone."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
