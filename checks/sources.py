"""CSV scan, type inference, encodings and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.profiling import dtypes
from tablewright.plans.preprocess import clean_file, preprocess
from tablewright.sources.csv import detect_encoding, infer_types, scan_csv
from tablewright.sources.sink import write_clean
from tablewright.sources.workspace import scratch_path

from . import outlier_steps, query, rounded, table


def _as_csv(spark, df) -> str:
    path = scratch_path(spark, "csv")
    write_clean(df, path, "csv")
    return path


@query(
    """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
       FROM customer"""
)
def scan_csv_customer(spark, sf):
    return scan_csv(spark, _as_csv(spark, table(spark, sf, "customer")))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_csv_multiline(spark, sf):
    return scan_csv(spark, _as_csv(spark, table(spark, sf, "documents")))


@query(
    """SELECT o_orderkey,
              CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS DOUBLE) END AS o_custkey,
              CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice,
              nullif(o_orderpriority, '5-LOW') AS o_orderpriority,
              o_orderstatus = 'F' AS filled,
              CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END END
                AS filled_or_open
       FROM orders"""
)
def infer_types_orders(spark, sf):
    texts = table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS o_orderkey",
        "CASE WHEN o_orderstatus = 'P' THEN 'None' ELSE CAST(o_custkey AS STRING) END AS o_custkey",
        "CASE WHEN o_orderstatus = 'P' THEN 'NA' ELSE CAST(o_totalprice AS STRING) END AS o_totalprice",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a' ELSE o_orderpriority END AS o_orderpriority",
        "CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS filled",
        "CASE o_orderstatus WHEN 'P' THEN '' WHEN 'F' THEN 'true' ELSE 'false' END AS filled_or_open",
    )
    return infer_types(texts)


@query("SELECT c_custkey, c_name, '€ ' || c_mktsegment AS segment FROM customer")
def scan_csv_windows1252(spark, sf):
    """Written as windows-1252, whose euro sign is the one byte 0x80."""
    texts = table(spark, sf, "customer").select("c_custkey", "c_name", F.concat(F.lit("\x80 "), "c_mktsegment").alias("segment"))
    path = scratch_path(spark, "csv")
    texts.write.csv(path, header=True, encoding="ISO-8859-1")
    return scan_csv(spark, path)


@query(
    """SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'),
              (3, 'o_totalprice', 'double'), (4, 'o_orderdate', 'string'), (5, 'o_orderpriority', 'string'))
       AS t(position, "column", dtype)"""
)
def dtypes_csv(spark, sf):
    return dtypes(scan_csv(spark, _as_csv(spark, table(spark, sf, "orders"))))


@query(
    r"""SELECT lang, written,
               CASE WHEN written = 'ISO-8859-1' AND bool_or(regexp_matches(text, '[\x{80}-\x{FF}]'))
                    THEN 'ISO-8859-1' ELSE 'UTF-8' END AS encoding
        FROM documents, (VALUES ('UTF-8'), ('ISO-8859-1')) AS w(written) GROUP BY lang, written"""
)
def detect_encodings(spark, sf):
    texts = table(spark, sf, "documents").select("lang", "text")
    parts = []
    for written in ("UTF-8", "ISO-8859-1"):
        path = scratch_path(spark, "encoded")
        texts.write.partitionBy("lang").csv(path, header=True, encoding=written, escape='"')
        files = detect_encoding(spark, path).select(
            F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang"),
            F.lit(written).alias("written"),
            # Of several files of one language, some may hold only ASCII.
            F.col("encoding"),
        )
        parts.append(files.groupBy("lang", "written").agg(F.min("encoding").alias("encoding")))
    return parts[0].unionByName(parts[1])


@query(
    f"""WITH {outlier_steps("events", ["event_id", "user_id", "value"])}
        SELECT event_id, ts, user_id, event_type, value, props FROM step3"""
)
def write_clean_parquet(spark, sf):
    path = scratch_path(spark, "clean")
    write_clean(preprocess(table(spark, sf, "events")), path)
    return spark.read.parquet(path)


@query(
    f"""WITH {outlier_steps("documents", ["doc_id", "n_chars"])}
        SELECT doc_id, text, lang, source, n_chars FROM step2"""
)
def write_clean_csv(spark, sf):
    path = scratch_path(spark, "clean")
    write_clean(preprocess(table(spark, sf, "documents")), path, "csv")
    return scan_csv(spark, path)


@query(
    f"""WITH filled AS (
          SELECT p_partkey, p_name,
                 coalesce(nullif(p_brand, 'Brand#1'),
                          (SELECT p_brand FROM part WHERE p_brand <> 'Brand#1'
                           GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1)) AS p_brand,
                 coalesce(nullif(p_size, 7)::DOUBLE, (SELECT avg(nullif(p_size, 7)) FROM part)) AS p_size,
                 p_retailprice FROM part),
        {outlier_steps("filled", ["p_partkey", "p_size", "p_retailprice"])}
        SELECT p_partkey, p_name, p_brand, round(p_size, 6) AS p_size, p_retailprice FROM step3"""
)
def clean_file_part(spark, sf):
    gaps = table(spark, sf, "part").selectExpr(
        "p_partkey",
        "p_name",
        "CASE WHEN p_brand = 'Brand#1' THEN '#N/A' ELSE p_brand END AS p_brand",
        "nullif(p_size, 7) AS p_size",
        "CAST(NULL AS STRING) AS nothing",
        "p_retailprice",
    )
    clean = clean_file(spark, _as_csv(spark, gaps), scratch_path(spark, "clean"))
    return clean.withColumn("p_size", rounded("p_size"))
