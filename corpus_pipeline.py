"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. All but
the last return the columns of `documents`. What each does with nulls, empty and
repeated rows is stated at its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import chunks, decontaminate, ngram_join, packing, toxicity
from tablewright.llm.queries import held_out, table, tokenizer_path
from tablewright.sources.workspace import staged


#: Rows that a task hands to Python at once, at most. Documents are long, so Spark's usual 10,000 take much memory.
BATCH_ROWS = 2_000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _in_small_batches(spark: SparkSession) -> None:
    """A setting of the session, as the data is read after a stage has returned; a smaller one is left as it is."""
    if not 0 < int(spark.conf.get(_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_SETTING, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go; the model learns from labels that are not held out."""
    _in_small_batches(spark)
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    model = toxicity.learn(docs.filter(~held_out("doc_id")), labels, "doc_id", "text")
    return model.below(docs, "text", toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles, the one with the smallest doc_id stays."""
    _in_small_batches(spark)
    return ngram_join.first_of_each(docs, "doc_id", "text", n=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id holds are taken out; documents that this leaves without any text go."""
    _in_small_batches(spark)
    cut = "_".join(["cut", *docs.columns])  # a name that no column has
    left = chunks.without_spans(docs, "doc_id", "text", chunks.repeated_spans(docs, "doc_id", "text"), into=cut)
    return left.filter(F.col(cut).isNull() | F.col("text").rlike(r"\S")).select(*docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that belong to benchmark items are taken out; documents left without a word go."""
    _in_small_batches(spark)
    return decontaminate.removed(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence, place and ids (unsigned 32-bit, little-endian)."""
    _in_small_batches(spark)
    return packing.pack(docs, "doc_id", "text", tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", cut_benchmark),
    ("packing", pack_sequences),
]

#: A learned model, a rolling hash and a tokenizer are no SQL. Tests hold each stage's operator against plain versions, not yet the whole run.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
