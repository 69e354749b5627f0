"""Jaccard self-join of shingle sets with a token-group matrix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.graph import components
from tablewright.llm.text import BETWEEN_SPACES, blocks, flat, shingles, tidy, words
from tablewright.sources.workspace import staged

#: Sets of one group, about.
GROUP_SETS = 16
#: Texts that tell which shingles are common: a bounded sample. It decides in which order shingles are
#: looked at, and so the cost, never the result.
ORDER_SAMPLE = 8000
#: Shingles that come first, as a multiple of the share of a set that may differ.
AHEAD = 1.5
#: Times a shingle occurs in the sample to count as common, and common shingles at most.
COMMON_TIMES, COMMON_MOST = 4, 400_000


def linked(docs: DataFrame, key: str, text: str, n: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component): documents linked when 100 * shared >= percent * all of their shingles.

    A document is its set of distinct `n`-word shingles (words between ASCII white
    space, A-Z lower-cased); fewer words make one shingle. Null, empty and blank
    texts have no shingle and are linked with nothing. `component` is the smallest
    key that links reach, its own included. One row for each row of `docs`; rows of one
    key count as one document, rows without a key are linked with nothing. `percent`
    is from 1 to 100.

    1. Equal sets become one, by digest, with partial aggregation.
    2. A pair that is similar enough shares a shingle among the first few of either
       set, in any order that is the same for all sets. The order puts a share of all
       shingles, by their hashes, before the others, and within it those of fewest sets;
       so only that share is shuffled, and a set with enough shingles of its own needs
       no comparison. Shingles that a sample finds common come last.
    3. Of the sets that share such a shingle each is compared with the smallest one;
       sets found similar form groups. So thousands of near copies cost
       one comparison each, not one for each pair.
    4. Sets whose first shingles lead to another group go on, unless the union of all other
       such sets holds too few of their shingles: then no link is possible.
    5. Of those, sets that met the same smallest set are dealt into blocks of about 16, large
       groups into blocks of their own. A block's column of the token-group matrix is the union of
       its sets' shingles. Where two blocks share a first shingle, each set of the one must share
       enough of its shingles with the union of the other; only then is that block opened,
       and its sets that are not linked yet are compared.
    6. Components of all links.
    """
    common = _common(docs, key, text, n)
    described = staged(_described(docs, key, text, n, percent, common), "sets")
    full = described.filter("n > 0 and key is not null")
    same = full.groupBy("d1", "d2").agg(F.min("key").alias("rep"))
    reps = same.select("rep").distinct()
    first = _first(full.join(reps, full["key"] == reps["rep"]), percent)
    least = F.min(F.struct("rep", "n")).alias("least")
    shared = first.groupBy("token").agg(least, F.max("rep").alias("last")).filter("least.rep < last")
    shared = shared.select("token", F.col("least.rep").alias("leader"), F.col("least.n").alias("leader_n"))
    postings = staged(first.join(shared, "token"), "postings")
    arrays = staged(_arrays(docs, key, text, n, postings.select(F.col("rep").alias("key")).distinct()), "shingles")

    near = postings.filter((F.col("rep") != F.col("leader")) & _close(F.col("n"), F.col("leader_n"), percent))
    pairs = near.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("leader").alias("b"), F.col("leader_n").alias("nb")).distinct()
    links = staged(_similar(pairs, arrays, percent), "links")
    group = components(links).withColumnsRenamed({"node": "rep", "component": "grp"})
    grouped = postings.join(group, "rep", "left").withColumn("grp", F.coalesce("grp", "rep"))
    placed = staged(_blocks(staged(_linkable(staged(grouped, "grouped"), arrays, percent), "linkable")), "placed")
    links = links.unionByName(staged(_opened(placed, arrays, percent), "links"))
    found = components(links).withColumnsRenamed({"node": "rep", "component": "component"})

    owner = same.join(found, "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    own = described.select("key", F.col("n").alias("n_shingles"), "d1", "d2")
    linkable = own.filter("n_shingles > 0 and key is not null").join(owner, ["d1", "d2"])
    alone = own.filter("n_shingles = 0 or key is null").withColumn("component", F.col("key"))
    out = linkable.unionByName(alone).select("key", "n_shingles", "component")
    return out.withColumnRenamed("key", key)


def _first(sets: DataFrame, percent: int) -> DataFrame:
    """(token, rep, n): the first shingles of each set that other sets have too."""
    rows = sets.select("rep", "n", "ahead", F.posexplode("tokens").alias("place", "token"))
    # One row for each set and shingle of the share; common shingles are not among them, so no list is a large part of all sets.
    rows = rows.withColumn("sets", F.count("*").over(Window.partitionBy("token"))).filter("sets > 1")
    # At most the shingles of one set: those of the share by rarity, then the others, which are few.
    inside = F.col("place") < F.col("ahead")
    each = rows.groupBy("rep", "n", "ahead").agg(
        F.array_sort(F.collect_set(F.when(inside, F.struct("sets", "token")))).alias("rare"),
        F.collect_set(F.when(~inside, F.col("token"))).alias("rest"),
    )
    need = F.col("n") + F.floor(-percent * F.col("n") / 100) + 1
    alone = F.col("ahead") - F.size("rare")
    room = F.when(F.col("ahead") >= need, F.greatest(F.lit(0), F.least(F.size("rare").cast("long"), need - alone))).otherwise(F.size("rare"))
    rare = F.transform(F.slice("rare", 1, room.cast("int")), lambda x: x["token"])
    return each.select(F.explode(F.concat(rare, "rest")).alias("token"), "rep", "n")


def first_of_each(docs: DataFrame, key: str, text: str, n: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each component, the one with the smallest key; rows without a key stay."""
    kept = linked(docs, key, text, n, percent).filter(F.col(key) == F.col("component")).select(key).distinct()
    order = Window.partitionBy(key).orderBy(key)
    once = docs.join(kept, key, "left_semi").withColumn("__row", F.row_number().over(order)).filter("__row = 1").drop("__row")
    return once.select(*docs.columns).unionByName(docs.filter(F.col(key).isNull()))


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    data, at = flat(batch.column(1))
    for lo, hi in blocks(at):
        _, _, h, first = words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], BETWEEN_SPACES)
        for i in range(hi - lo):
            yield shingles(h, first[i], first[i + 1], n)


def _common(docs: DataFrame, key: str, text: str, n: int) -> np.ndarray:
    """Shingles that several texts of the sample hold, sorted."""
    total = docs.count()
    share = min(1.0, ORDER_SAMPLE / max(1, total))
    sample = docs.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x for x in _sets(batch, n) if len(x)]
            if sets:
                token, times = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(times)], ["token", "times"])

    counted = sample.select(F.col(key), F.col(text)).mapInArrow(tidy(run), "token long, times long")
    often = counted.groupBy("token").agg(F.sum("times").alias("times")).filter(F.col("times") >= COMMON_TIMES)
    got = often.orderBy(F.desc("times"), "token").limit(COMMON_MOST).select("token").toPandas()
    return np.sort(got["token"].to_numpy(np.int64).view(np.uint64))


def _described(docs: DataFrame, key: str, text: str, n: int, percent: int, common: np.ndarray) -> DataFrame:
    """(key, n, d1, d2, ahead, tokens): size and digest of each set and the shingles that can be among its first.

    Those are the `ahead` shingles whose hashes are in the share that comes first, then, if
    they are too few, others by hash, common ones last.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON_MOST numbers
    kind = docs.schema[key].dataType.simpleString()
    limit = np.uint64(min(1.0, AHEAD * (100 - percent) / 100) * ((1 << 64) - 1025))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            sizes, digests, ahead, kept = [], [], [], []
            for own in _sets(batch, n):
                size = len(own)
                sizes.append(size)
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                need = size + (-percent * size // 100) + 1 if size else 0
                known = np.zeros(size, bool)
                if len(often):
                    known = often[np.minimum(np.searchsorted(often, own), len(often) - 1)] == own
                rare = own[~known]
                cut = int(np.searchsorted(rare, limit))
                ahead.append(cut)
                more = max(0, need - cut)
                kept += [rare[: cut + more], own[known][: max(0, need - len(rare))]]
            halves = np.frombuffer(b"".join(digests), np.int64)
            lengths = np.array([len(x) for x in kept], np.int64).reshape(-1, 2).sum(axis=1)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            values = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(halves[::2]), pa.array(halves[1::2]), pa.array(ahead, pa.int64())]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*columns, lists], ["key", "n", "d1", "d2", "ahead", "tokens"])

    rows = docs.select(F.col(key).alias("key"), F.col(text))
    return rows.mapInArrow(tidy(run), f"key {kind}, n long, d1 long, d2 long, ahead long, tokens array<long>")


def _arrays(docs: DataFrame, key: str, text: str, n: int, wanted: DataFrame) -> DataFrame:
    """(key, n, tokens): the whole sets of the wanted documents."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch, n))
            sizes = [len(x) for x in sets]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["key", "n", "tokens"]
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(wanted, "key", "left_semi")
    order = Window.partitionBy("key").orderBy("key")
    once = rows.withColumn("r", F.row_number().over(order)).filter("r = 1").select("key", "text")
    return once.mapInArrow(tidy(run), f"key {kind}, n long, tokens array<long>")


def _close(n: Column, m: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return (100 * F.least(n, m)) >= (percent * F.greatest(n, m))


def _similar(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, na, b, nb) those that are similar enough, by their whole sets."""
    x = arrays.select(F.col("key").alias("a"), F.col("tokens").alias("ta"))
    y = arrays.select(F.col("key").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    met = pairs.join(x, "a").join(y, "b")
    return met.filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _linkable(grouped: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The rows of `grouped` that can lead to a link between groups.

    Only sets that meet another group at a first shingle can have one, and its partner is such a
    set too. A shingle that just one of these sets holds is shared with none of them, so what
    is left bounds the overlap with every other set.
    """
    mixed = grouped.groupBy("token").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).filter("x <> y").select("token")
    rows = grouped.join(mixed, "token")
    sets = rows.select(F.col("rep").alias("key")).distinct()
    held = arrays.join(sets, "key", "left_semi").select("key", F.explode("tokens").alias("token"))
    single = held.groupBy("token").agg(F.min("key").alias("rep"), F.max("key").alias("last")).filter("rep = last")
    rows = rows.join(single.groupBy("rep").agg(F.count("*").alias("single")), "rep", "left")
    return rows.filter(100 * (F.col("n") - F.coalesce("single", F.lit(0))) >= percent * F.col("n")).drop("single")


def _blocks(placed: DataFrame) -> DataFrame:
    """Adds the block (home, block) of each set: sets with the same smallest leader, dealt out by a hash; large groups apart."""
    homes = placed.groupBy("rep", "grp").agg(F.min("leader").alias("home"))
    size = homes.groupBy("home", "grp").agg(F.count("*").alias("sets"))
    small = size.filter(F.col("sets") < GROUP_SETS).groupBy("home").agg(F.sum("sets").alias("rest"))
    apart = F.xxhash64("grp", F.pmod(F.xxhash64("rep"), F.ceil(F.col("sets") / GROUP_SETS).cast("long")))
    mixed = F.pmod(F.xxhash64("grp"), F.ceil(F.col("rest") / GROUP_SETS).cast("long"))
    number = F.when(F.col("sets") < GROUP_SETS, mixed).otherwise(apart)
    sized = homes.join(size.join(small, "home", "left"), ["home", "grp"])
    return placed.join(sized.select("rep", "home", number.alias("block")), "rep")


def _opened(placed: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Links between sets of different groups."""
    range_of = [F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("grp").alias("x"), F.max("grp").alias("y")]
    column = placed.groupBy("token", F.col("home").alias("home2"), F.col("block").alias("block2")).agg(*range_of)
    asking = column.select("token", F.col("home2").alias("home"), F.col("block2").alias("block"), *[F.col(c).alias(f"{c}1") for c in ("lo", "hi", "x", "y")])
    # The query is the larger set of a pair, so each pair is compared once. Blocks meet first, then their sets ask.
    meet = (F.col("lo") <= F.col("hi1")) & (100 * F.col("hi") >= percent * F.col("lo1"))
    differ = (F.col("x") != F.col("y")) | (F.col("x1") != F.col("y1")) | (F.col("x") != F.col("x1"))
    range_of = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("x").alias("x"), F.max("y").alias("y")]
    met = asking.join(column, "token").filter(meet & differ).groupBy("home", "block", "home2", "block2").agg(*range_of)
    query = placed.select("home", "block", F.col("rep").alias("q"), F.col("n").alias("nq"), F.col("grp").alias("own")).distinct()
    fits = (F.col("lo") <= F.col("nq")) & (100 * F.col("hi") >= percent * F.col("nq")) & ((F.col("x") != F.col("own")) | (F.col("y") != F.col("own")))
    asked = staged(met.join(query, ["home", "block"]).filter(fits).select("q", "nq", "own", "home2", "block2"), "asked")
    members = placed.select(F.col("home").alias("home2"), F.col("block").alias("block2"), "rep", "n", "grp").distinct()
    # About GROUP_SETS sets a block.
    used = asked.select("home2", "block2").distinct()
    sets = members.join(used, ["home2", "block2"]).join(arrays.select(F.col("key").alias("rep"), "tokens"), "rep")
    matrix = sets.groupBy("home2", "block2").agg(
        F.collect_list(F.struct("rep", "n", "grp", "tokens")).alias("sets"), F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union")
    )
    asked = asked.join(arrays.select(F.col("key").alias("q"), F.col("tokens").alias("tq")), "q")
    bound = F.size(F.array_intersect("tq", "union")) * 100 >= percent * F.col("nq")

    def similar(s: Column) -> Column:
        both = F.size(F.array_intersect(F.col("tq"), s["tokens"]))
        smaller = (s["n"] < F.col("nq")) | ((s["n"] == F.col("nq")) & (s["rep"] < F.col("q")))
        return smaller & (s["grp"] != F.col("own")) & _close(s["n"], F.col("nq"), percent) & (100 * both >= percent * (s["n"] + F.col("nq") - both))

    opened = asked.join(matrix, ["home2", "block2"]).filter(bound)
    found = opened.select(F.col("q").alias("a"), F.transform(F.filter("sets", similar), lambda s: s["rep"]).alias("b"))
    return found.select("a", F.explode("b").alias("b"))
