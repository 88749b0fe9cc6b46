"""Chat formatting: turns to one marked text per conversation and back, in Spark expressions only.

Turns are collected as structs and sorted; runs of turns of the same role become one block, its texts
parted by a control string; blocks are joined by array functions, so the work is linear in the
conversation's length. A control string inside a text has its bar doubled ("<|" becomes "<||"), which is undone
when reading back, so the format is reversible whatever a text says.

Defined results: a null text is the empty text, a null role the role "" ; turns of equal number keep the
order of role, then text, and repeated rows are repeated turns; rows of a null conv_id are one conversation;
an empty table gives an empty result; further columns are ignored. A role is escaped like a text, its line breaks too.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's marks; "<|" never occurs elsewhere, because texts have it as "<||".
START, END, SEP, BREAK = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "<|br|>"


def escape(x: Column) -> Column:
    return F.replace(x, F.lit("<|"), F.lit("<||"))


def unescape(x: Column) -> Column:
    return F.replace(x, F.lit("<||"), F.lit("<|"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: the conversation under the template."""
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    # Where a run of the same role begins, as positions from 1; then the runs themselves.
    rows = rows.withColumn("begins", F.expr("filter(sequence(1, size(turns)), i -> i = 1 or turns[i - 1].role <> turns[i - 2].role)"))
    rows = rows.withColumn("runs", F.expr("transform(begins, (b, k) -> slice(turns, b, coalesce(get(begins, k + 1), size(turns) + 1) - b))"))
    block = lambda run: F.concat(F.lit(START), F.replace(escape(run[0]["role"]), F.lit("\n"), F.lit(BREAK)), F.lit("\n"), F.array_join(F.transform(run, lambda x: escape(x["text"])), SEP), F.lit(END))
    return rows.select("conv_id", F.array_join(F.transform("runs", block), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: array<struct<role, text>>, from the formatted text alone."""
    out = formatted.withColumn("blocks", F.expr(rf"filter(split(formatted, '\\Q{START}\\E'), (x, k) -> k > 0)"))
    body = lambda b: F.substr(b, F.instr(b, "\n") + F.lit(1), F.length(b) - F.instr(b, "\n") - F.lit(len(END)))
    parts = F.transform("blocks", lambda b: F.struct(
        unescape(F.replace(F.substring_index(b, "\n", 1), F.lit(BREAK), F.lit("\n"))).alias("role"),
        F.split(body(b), r"\Q" + SEP + r"\E").alias("texts"),
    ))
    turns = F.flatten(F.transform("parts", lambda p: F.transform(p["texts"], lambda t: F.struct(p["role"].alias("role"), unescape(t).alias("text")))))
    return out.withColumn("parts", parts).select("conv_id", "formatted", turns.alias("turns"))


def loss_spans(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """conv_id, begin, end, masked: the places in the formatted text, as characters, that a trainer's loss counts, and what
    stands there: every text of the role, escaped, and nothing of the template."""
    blocks = formatted.select("conv_id", F.posexplode(F.split("formatted", rf"\Q{START}\E")).alias("b", "block")).where("b > 0")
    order = Window.partitionBy("conv_id").orderBy("b")
    before = F.sum(F.length("block") + len(START)).over(order) - F.length("block")  # the marks count, the block's own text does not
    line = F.instr("block", "\n")
    texts = F.split(F.substr("block", line + 1, F.length("block") - line - F.lit(len(END))), rf"\Q{SEP}\E")
    said = blocks.withColumns({"at": before + line, "role": F.substring_index("block", "\n", 1)}).where(F.col("role") == role)
    pieces = said.select("conv_id", "b", "at", F.posexplode(texts).alias("t", "text"))
    place = F.col("at") + F.sum(F.length("text") + len(SEP)).over(Window.partitionBy("conv_id", "b").orderBy("t")) - F.length("text") - len(SEP)
    return pieces.select("conv_id", place.alias("begin"), (place + F.length("text")).alias("end"), F.col("text").alias("masked")).where("end > begin")


def digest(read: DataFrame, spans: DataFrame) -> DataFrame:
    """Per conversation: its turns' count and digest, and the text under the loss mask (of loss_spans), unescaped."""
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("begin", "masked"))), lambda p: unescape(p["masked"]))
    said = spans.groupBy(F.col("conv_id").alias("own")).agg(F.array_join(pieces, "").alias("said"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.join(said, F.col("conv_id").eqNullSafe(F.col("own")), "left").withColumn("said", F.coalesce("said", F.lit(""))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2(F.col("said").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
