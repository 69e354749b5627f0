"""Shards of near-equal bytes by longest-processing-time scheduling of groups that stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Schedulable units for each shard: groups above this share of a shard are scheduled one by one,
#: smaller ones in bundles. So many numbers a shard reach the heap on the driver, however many rows there are.
UNITS_PER_SHARD = 500
#: Rows are numbered in pieces of about this many, side by side.
ROWS_PER_PIECE = 200_000


def schedule(units: list[tuple[int, int, int]], shards: int) -> dict[tuple[int, int], int]:
    """Shard of each unit (kind, id) of the list (size, kind, id): largest first, to the least-loaded shard.

    Ties go to the smaller kind, id and shard.
    """
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, kind, number in sorted(units, key=lambda u: (-u[0], u[1], u[2])):
        load, shard = heapq.heappop(heap)
        placed[kind, number] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard(rows: DataFrame, key: str, group: str, size: str, shards: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, size, shard, slot) and the columns `carry` of all rows; rows of one `group` share a shard, null being a group too.

    A group above 1/500 of a shard's fair share is a unit of the heap; the rest form
    bundles by a hash of `group`, 500 a shard, each a unit. So a shard exceeds the
    least one by about a bundle at most, unless a single group is larger than that. Slots
    number a shard's rows from 0 by hash piece and `key`; repeated rows each get one.
    Null sizes count as 0; without rows the result is empty.

    Sizes are summed by group with partial aggregation; both lists that are collected
    have at most 500 entries a shard, and so has the map that is broadcast.
    """
    spark = rows.sparkSession
    bundles = shards * UNITS_PER_SHARD
    # Numbers of a group: the whole hash names it, its remainder the bundle.
    own = rows.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"),
        *carry,
        F.xxhash64(F.coalesce(F.col(group), F.lit("")), F.col(group).isNull()).alias("g"),
    ).withColumn("bundle", F.pmod("g", F.lit(bundles)))
    sums = own.groupBy("g", "bundle").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    total = sums.agg(F.sum("size").alias("size"), F.sum("n").alias("n")).first()
    least = (total["size"] or 0) / bundles
    large = sums.filter(F.col("size") > least)
    small = sums.filter(F.col("size") <= least).groupBy("bundle").agg(F.sum("size").alias("size"))
    units = [(r["size"], 0, r["g"]) for r in large.select("g", "size").collect()]
    units += [(r["size"], 1, r["bundle"]) for r in small.collect()]
    placed = schedule(units, shards)
    table = spark.createDataFrame([(k, n, s) for (k, n), s in placed.items()], "kind int, number long, shard int")
    alone = table.filter("kind = 0").select(F.col("number").alias("g"), F.col("shard").alias("own_shard"))
    together = table.filter("kind = 1").select(F.col("number").alias("bundle"), F.col("shard").alias("bundle_shard"))
    dealt = own.join(F.broadcast(alone), "g", "left").join(F.broadcast(together), "bundle", "left")
    dealt = dealt.withColumn("shard", F.coalesce("own_shard", "bundle_shard"))
    pieces = max(1, (total["n"] or 0) // (shards * ROWS_PER_PIECE) + 1)
    return numbered(dealt.select("key", "size", *carry, "shard"), pieces)


def numbered(dealt: DataFrame, pieces: int) -> DataFrame:
    """Adds `slot`: 0, 1, 2, ... within each shard, in `pieces` parts that are numbered side by side."""
    cut = dealt.withColumn("piece", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(pieces)))
    counts = cut.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("key")) - 1
    ranked = cut.withColumn("place", place).join(offsets, ["shard", "piece"])
    return ranked.select(*dealt.columns, (F.col("offset") + F.col("place")).alias("slot"))
