"""The registered query of each operator, with production parameters on its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import ann, chunks, decontaminate, divergence, embeddings, langid, ngram_join, packing, reputation, sharding, toxicity, warc, whitening
from tablewright.llm.sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]

SHARDS = 40
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(key: str) -> Column:
    """Rows that nothing may be learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = langid.learn(docs.filter(~held_out("doc_id")), "doc_id", "text", "lang")
    return filters.predict(docs, "doc_id", "text").select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload"))
    return warc.deduplicate(pages).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number ends its path, so that document's labels are its outcome: bad if toxic or of no quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.expr("try_cast(regexp_extract(url, '^[^:]*://[^/?#]*/[a-z]+/([0-9]+)', 1) as long)")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    outcomes = pages.select("page_id", number.alias("doc_id")).join(labels, "doc_id").select("page_id", "bad")
    return reputation.judge(pages, outcomes, RULES)


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = chunks.repeated_spans(docs, "doc_id", "text")
    left = chunks.without_spans(docs, "doc_id", "text", spans, into="spans")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return left.select("doc_id", "text", F.coalesce(removed, F.lit(0)).alias("repeated_bytes"), "spans")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs.filter(~held_out("doc_id")), labels.filter(~held_out("doc_id")), "doc_id", "text")
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return model.score(docs, "doc_id", "text").select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted)


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(docs, "doc_id", "text", tokenizer_path(), ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.linked(table(spark, sf_dir, "documents"), "doc_id", "text", n=3, percent=90)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def op8_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", (F.octet_length(text) + 16).alias("bytes"), F.crc32(text).alias("text_crc32")
    )
    dealt = sharding.shard(docs, "doc_id", "text", "bytes", SHARDS, carry=("text_crc32",))
    return dealt.select(
        F.col("key").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.report(decontaminate.find(docs, items, "doc_id", "text", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


def op11_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "vec_id % 50 = 0")


def op12_divergence_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), "text", "lang", "source")


def op13_bit_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.learn(rows, "embedding").transform(rows, "vec_id", "embedding")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_language_masks,
        op2_warc_revisits,
        op3_host_reputation,
        op4_chunk_dedup,
        op5_toxicity,
        op6_harmonic_packing,
        op7_ngram_join,
        op8_lpt_shards,
        op9_decontaminate,
        op10_embedding_dedup,
        op11_kmeans_tree,
        op12_divergence_cube,
        op13_bit_whitening,
        pipeline,
    )
}
