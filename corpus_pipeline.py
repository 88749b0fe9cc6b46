"""The corpus pipeline: documents through quality rules, near-copy removal, repeated-passage removal,
decontamination and tokenisation.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined results: a null or empty text has no words and is rejected by the base filter, and a document that loses all its
words goes; empty tables pass through every stage; rows of a null doc_id go at the first stage; rows that repeat a
doc_id are decided together (if their texts differ, one that is rejected takes the others with it, one of them speaks for
the document in the search for copies, and each keeps its own text); further columns of documents are kept whatever
they are called; missing labels leave the base filter alone to decide, and an empty benchmark rejects nothing.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import bpe, decontaminate, ngram_join, quality_rules, substring
from meshloom.llm.common import new_path, table, text_of
from meshloom.llm.queries import tokenizer_path


def _only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs with (left_semi) or without (left_anti) an id in the table's column `own_id`, with their columns as they are."""
    return docs.join(ids, docs["doc_id"] == ids["own_id"], how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base filter or a learned rule rejects go."""
    verdict, _ = quality_rules.apply_rules(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _only(docs, verdict.groupBy(F.col("doc_id").alias("own_id")).agg(F.bool_and("kept").alias("kept")).where("kept").select("own_id"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar texts the document of the smallest id stays."""
    classes = ngram_join.similar_texts(docs.select("doc_id", "text"))
    return _only(docs, classes.where("doc_id = class_id").select(F.col("doc_id").alias("own_id")).distinct())


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a smaller document holds go; a text that loses none stays as it is, of the others
    the kept words stay, joined by one space, and a document that loses all its words goes."""
    own = docs.select(F.col("doc_id").alias("own_id"), F.sha2(text_of(docs).cast("binary"), 256).alias("own_text"), F.struct("*").alias("doc"))
    # Only texts that lose words are joined back. Of rows of one id with different texts each finds its own.
    found = substring.remove_repeats(docs.select("doc_id", "text"), digests=False).where("n_removed > 0")
    found = found.select(F.col("doc_id").alias("own_id"), F.col("text_sha256").alias("own_text"), F.col("text").alias("rest"), "n_words", "n_removed").dropDuplicates(["own_id", "own_text"])
    out = own.join(found, ["own_id", "own_text"], "left").where(F.coalesce(F.col("n_removed") < F.col("n_words"), F.lit(True)))
    new = {"text": F.coalesce("rest", "doc.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("rest").isNotNull(), F.length("rest").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's template go."""
    held = decontaminate.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _only(docs, held.select(F.col("doc_id").alias("own_id")).distinct(), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return bpe.encode_decode(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [("quality", quality), ("near_copies", near_copies), ("passages", passages), ("benchmark_free", benchmark_free), ("tokens", tokens)]

#: SQL cannot say the learned rules, the classes' closure or the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
