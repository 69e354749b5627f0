"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first until calibrated recall is reached."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.sources.workspace import staged

NEAREST = 5
#: Values (rows times dimension) of the sample that the tree is fitted on; the index holds every row.
FIT_VALUES = 1 << 22
#: Children of a node, and vectors of a leaf, about; at least so many of them from the sample.
BRANCHES, LEAF, LEAF_SAMPLE = 8, 128, 4
#: Queries that recall is calibrated with, and the recall that they have to reach.
CALIBRATORS, RECALL = 400, 0.97
#: Rows that a task compares with, of one large or many small leaves, and queries that it takes.
BLOCK, ASKS = 4096, 16_384
#: Queries multiplied at once, and pairs whose cosine is taken at once.
STEP, PAIRS = 1024, 1 << 16
#: Cells whose numbers of queries may be sent to all executors.
BROADCAST_CELLS = 100_000


@dataclass
class Tree:
    """Node k has the children `first[k]` up to `first[k] + count[k]`; a leaf has none. Bounded by the sample."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.count == 0)

    def home(self, unit: np.ndarray) -> np.ndarray:
        """The leaf that each vector descends to."""
        node = np.zeros(len(unit), np.int64)
        while len(inner := np.flatnonzero(self.count[node] > 0)):
            order = inner[np.argsort(node[inner], kind="stable")]
            for rows in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                k = node[rows[0]]
                children = slice(self.first[k], self.first[k] + self.count[k])
                node[rows] = self.first[k] + np.argmax(unit[rows] @ self.centres[children].T, axis=1)
        return node

    def visits(self, unit: np.ndarray, least: int, size: np.ndarray, rows: int) -> list[list[int]]:
        """For each vector the leaves of a best-bin-first traversal, until there are `least` of them that hold `rows` vectors.

        The queue holds all branches seen and not entered, nearest centre first. A walk
        from a branch goes down to the nearest child and queues its siblings.
        """
        out = []
        first, count, size = self.first.tolist(), self.count.tolist(), size.tolist()
        for lo in range(0, len(unit), 256):
            near = unit[lo : lo + 256] @ self.centres.T
            for to in near:
                queue, found, held = [(0.0, 0)], [], 0
                while queue and (len(found) < least or held < rows):
                    node = heapq.heappop(queue)[1]
                    while count[node]:
                        a, n = first[node], count[node]
                        own = to[a : a + n]
                        best = a + int(np.argmax(own))
                        for k, score in enumerate(own.tolist(), a):
                            if k != best:
                                heapq.heappush(queue, (-score, k))
                        node = best
                    found.append(node)
                    held += size[node]
                out.append(found)
        return out


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True, initial=0)  # no overflow or underflow in the squares
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of paired rows of the original vectors."""
    dot = np.einsum("ij,ij->i", q, v)
    with np.errstate(all="ignore"):
        out = dot / (np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", v, v)))
    odd = ~np.isfinite(out) | (out == 0)
    if odd.any():  # squares beyond the range of doubles
        out[odd] = np.einsum("ij,ij->i", unit(q[odd]), unit(v[odd]))
    return np.clip(out, -1.0, 1.0)


def _leading(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all that may be among the `k` largest of their row, rounding allowed for."""
    if near.shape[1] <= k:
        i, j = np.indices(near.shape)
        return i.ravel(), j.ravel()
    return np.nonzero(near >= -np.partition(-near, k - 1, axis=1)[:, k - 1 : k] - 1e-9)


def _decided(q: np.ndarray, v: np.ndarray, names: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (row of q, row of v), each query's `k` nearest by the measure itself, and by the smaller name where equal."""
    score = np.concatenate([np.zeros(0), *(cosine(q[i[lo : lo + PAIRS]], v[j[lo : lo + PAIRS]]) for lo in range(0, len(i), PAIRS))])
    order = np.lexsort((names[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], score[first]


def fit(sample: np.ndarray, leaf: int, branches: int = BRANCHES, rounds: int = 8) -> Tree:
    """Spherical k-means of each node's vectors into `branches` children, until a node has at most `leaf` of the sample."""
    centres, first, count = [sample.mean(axis=0)], [0], [0]
    open_nodes = [(0, np.arange(len(sample)))]
    rng = np.random.default_rng(11)
    while open_nodes:
        node, rows = open_nodes.pop()
        if len(rows) <= leaf:
            continue
        own = sample[rows]
        seeds = np.unique(own[rng.permutation(len(own))[: 4 * branches]], axis=0)
        middle = seeds[rng.permutation(len(seeds))[:branches]]
        for _ in range(rounds):
            near = np.argmax(own @ middle.T, axis=1)
            sums = np.zeros_like(middle)
            np.add.at(sums, near, own)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            middle = np.where(size > 0, sums / np.maximum(size, 1e-300), middle)
        near = np.argmax(own @ middle.T, axis=1)
        used = np.unique(near)
        if len(used) < 2:  # nothing tells them apart
            continue
        first[node], count[node] = len(centres), len(used)
        for k in used:
            open_nodes.append((len(centres), rows[near == k]))
            centres.append(middle[k])
            first.append(0)
            count.append(0)
    return Tree(np.array(centres), np.array(first), np.array(count))


def _matrix(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.array(column.tolist(), float).reshape(-1, width)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def search(rows: DataFrame, key: str, vector: str, queries: str, nearest: int = NEAREST, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, key, score): the `nearest` other rows of each row that meets the SQL condition `queries`, by cosine.

    Scores are cosines in double precision of the original vectors; equal ones go by
    the smaller key. Vectors that are null, empty or zero or hold null or non-finite
    components take no part, nor do rows without a key or whose vectors are not of the
    most frequent length (of equally frequent ones the longest). A row is what its key and vector are: repeated
    rows count once; rows of one key with different vectors are rows of their own, that are
    each other's candidates never, as a row's own key is not. An empty table, or no query, gives no rows.

    Equal vectors become one that keeps its smallest keys, as only these can be among the
    nearest, so thousands of copies are compared once. A bounded sample fits the tree; every vector
    descends to its leaf. How many leaves a query opens is calibrated: the exact
    neighbours of a bounded sample of the queries, found by reading all vectors once,
    tell which place of the traversal each neighbour's leaf has, and visits widen until
    `recall` of them are reached, and further for a query whose leaves hold too few
    vectors. Leaves are packed into cells of bounded size, a large leaf into several; a
    query goes once to each cell that holds a leaf it opens. Where vectors hardly
    cluster, recall makes a query open most leaves.
    """
    keep = nearest + 1  # one of them may be the query itself
    own = rows.withColumn("__query", F.coalesce(F.expr(queries).cast("boolean"), F.lit(False)))
    own = own.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.col("__query").alias("query"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = own.filter(F.col("key").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    # -0.0 and 0.0 are one number; the digest names a vector.
    good = good.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    common = good.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    kind = rows.schema[key].dataType.simpleString()
    spark = rows.sparkSession
    if common is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score double")
    width = common["width"]
    named = good.filter(F.size("v") == width).withColumn("name", F.unhex(F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary"), 256)))
    once = named.groupBy("name", "key").agg(F.first("v").alias("v"), F.max("query").alias("query"))
    least = Window.partitionBy("name").orderBy("key")
    # One row a vector with its smallest keys.
    some = once.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= keep)
    vectors = some.groupBy("name").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("key")).alias("keys"))
    vectors = staged(vectors, "vectors")
    asked = staged(named.filter("query").groupBy("name", "key").agg(F.first("v").alias("v")), "asked")
    wanted = asked.groupBy("name").agg(F.first("v").alias("v"))
    n = vectors.count()

    most = max(1, FIT_VALUES // width)
    sample = vectors.select("v") if n <= most else vectors.orderBy(F.xxhash64("name", F.lit(1))).limit(most).select("v")
    fitted = unit(_matrix(sample.toPandas()["v"], width))
    tree = fit(fitted, max(LEAF_SAMPLE, LEAF * len(fitted) // max(n, 1)))
    shared = spark.sparkContext.broadcast(tree)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                leaf = shared.value.home(unit(_matrix(part.column(1), width)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf.astype(np.int32))], [*part.schema.names, "leaf"])

    index = staged(vectors.mapInArrow(placed, f"name binary, v array<double>, keys array<{kind}>, leaf int"), "index")
    size = np.zeros(len(tree.count), np.int64)
    for r in index.groupBy("leaf").count().collect():  # as many as leaves
        size[r["leaf"]] = r["count"]
    visits = _calibrated(index, wanted, tree, size, width, nearest, recall)

    # Small leaves that stand together share a cell, a large one has several.
    blocks = np.where(size > BLOCK, -(-size // BLOCK), 0)
    first_cell, cells, held = np.zeros(len(size), np.int64), 0, BLOCK
    for leaf in tree.leaves:
        if blocks[leaf]:
            first_cell[leaf], cells, held = cells, cells + blocks[leaf], BLOCK
        else:
            if held + size[leaf] > BLOCK:
                cells, held = cells + 1, 0
            first_cell[leaf], held = cells - 1, held + size[leaf]
    plan = spark.sparkContext.broadcast((size, first_cell, np.maximum(blocks, 1)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, start, many = plan.value
        for batch in batches:
            leaf, drawn = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(start[leaf] + drawn % many[leaf])], ["name", "v", "keys", "leaf", "cell"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, start, many = plan.value
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                rows, cells, leaves = [], [], []
                for q, found in enumerate(shared.value.visits(unit(_matrix(part.column(1), width)), visits, size, keep)):
                    there: dict[int, list[int]] = {}
                    for leaf in found:
                        for cell in range(start[leaf], start[leaf] + many[leaf]):
                            there.setdefault(cell, []).append(leaf)
                    rows += [q] * len(there)
                    cells += there.keys()
                    leaves += there.values()
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in part.columns), pa.array(leaves, pa.list_(pa.int32())), pa.array(cells, pa.int64())], ["name", "v", "leaves", "cell"])

    held_rows = index.withColumn("drawn", F.pmod(F.xxhash64("name", F.lit(2)), F.lit(1 << 40))).mapInArrow(dealt, f"name binary, v array<double>, keys array<{kind}>, leaf int, cell long")
    requests = staged(wanted.select("name", "v").mapInArrow(opened, "name binary, v array<double>, leaves array<int>, cell long"), "requests")
    # Where many queries open a cell, they are dealt to several tasks that each read its vectors.
    asks = requests.groupBy("cell").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts"))
    asks = F.broadcast(asks) if cells <= BROADCAST_CELLS else asks
    requests = requests.join(asks, "cell").withColumn("part", F.pmod(F.xxhash64("name", F.lit(3)), F.col("parts")).cast("int"))
    held_rows = held_rows.join(asks, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def compared(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"name": [], "key": [], "score": []})
        return _neighbours(left, right, width, keep)

    left, right = requests.drop("parts").groupBy("cell", "part"), held_rows.drop("name", "parts").groupBy("cell", "part")
    met = left.cogroup(right).applyInPandas(compared, f"name binary, key {kind}, score double")
    order = Window.partitionBy("name").orderBy(F.desc("score"), "key")
    top = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    # Of each query (a key and a vector): what its vector found, without its own key.
    found = asked.select("name", F.col("key").alias("query_id")).join(top.select("name", "key", "score"), "name").filter("key <> query_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "key")).cast("int"))
    return ranked.filter(F.col("rank") <= nearest).select("query_id", "rank", F.col("key").alias(key), "score")


def _neighbours(left: pd.DataFrame, right: pd.DataFrame, width: int, keep: int) -> pd.DataFrame:
    """(name, key, score): for each query its best keys among the vectors of the leaves that it opens here."""
    q, v, leaf = _matrix(left["v"], width), _matrix(right["v"], width), right["leaf"].to_numpy()
    keys = [list(k) for k in right["keys"]]
    smallest = np.array([k[0] for k in keys])
    opens = left["leaves"].to_numpy(object)
    asker = np.repeat(np.arange(len(q)), [len(x) for x in opens])
    asked = np.concatenate(opens)
    unit_q, unit_v = unit(q), unit(v)
    found = []
    for k in np.unique(leaf):
        own, of = np.flatnonzero(leaf == k), asker[asked == k]
        for lo in range(0, len(of), STEP):
            some = of[lo : lo + STEP]
            near = unit_q[some] @ unit_v[own].T
            i, j = _leading(near, keep)
            found.append((some[i], own[j], near[i, j]))
    i, j, near = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-near, i))
    i, j, near = i[order], j[order], near[order]
    start = np.searchsorted(i, i)
    last = near[np.minimum(start + keep, np.searchsorted(i, i, side="right")) - 1]
    i, j, score = _decided(q, v, smallest, *(x[near >= last - 1e-9] for x in (i, j)), keep)
    many = np.array([len(keys[b]) for b in j], int)
    return pd.DataFrame({"name": left["name"].to_numpy(object)[np.repeat(i, many)], "key": [k for b in j for k in keys[b]], "score": np.repeat(score, many)})


def _calibrated(index: DataFrame, wanted: DataFrame, tree: Tree, size: np.ndarray, width: int, nearest: int, recall: float) -> int:
    """Leaf visits that reach `recall` of the exact neighbours of a bounded sample of queries."""
    chosen = wanted.orderBy(F.xxhash64("name", F.lit(5))).limit(CALIBRATORS).toPandas()
    if not len(chosen):
        return 1
    q = _matrix(chosen["v"], width)
    shared = index.sparkSession.sparkContext.broadcast(q)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                v = _matrix(part.column(0), width)
                i, j = _leading(unit(shared.value) @ unit(v).T, nearest + 1)
                i, j, score = _decided(shared.value, v, np.arange(len(v)), i, j, nearest + 1)
                yield pa.RecordBatch.from_arrays([pa.array(i), part.column(1).take(pa.array(j)), pa.array(score)], ["q", "leaf", "score"])

    met = index.select("v", "leaf").mapInArrow(exact, "q long, leaf int, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "leaf")
    # The first is the query itself.
    truth = met.withColumn("place", F.row_number().over(best)).filter(F.col("place").between(2, nearest + 1)).select("q", "leaf").toPandas()
    if not len(truth):
        return 1
    visits = 1
    while True:  # widen
        order = tree.visits(unit(q), visits, size, 0)
        place = [order[a].index(b) + 1 if b in order[a] else 0 for a, b in zip(truth["q"], truth["leaf"], strict=True)]
        reached = np.bincount(place, minlength=visits + 1)[1:].cumsum() / len(place)
        if reached[-1] >= recall or visits >= len(tree.leaves):
            return int(np.argmax(reached >= min(recall, reached[-1]))) + 1
        visits = min(2 * visits, len(tree.leaves))
