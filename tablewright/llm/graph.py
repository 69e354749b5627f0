"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.sources.workspace import scratch_path


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each end of the links (a, b); component is the smallest node that links reach.

    Nodes are of any type that has an order, structs included; whole numbers become long.
    Alternates two steps until nothing changes: every node's larger neighbours,
    then every node's smaller ones, are tied to the smallest neighbour. Rounds grow
    with the logarithm of the longest chain. Each round is written to the shared
    folder, so lineage stays short and a lost executor costs one round.
    """
    spark = links.sparkSession
    kind = links.schema["a"].dataType
    kind = T.LongType() if isinstance(kind, T.IntegralType) else kind
    edges = links.select(F.col("a").cast(kind), F.col("b").cast(kind)).filter("a <> b")
    edges = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        near = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = _written(near.union(least).distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    if not state[0]:
        return spark.createDataFrame([], T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "links")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
