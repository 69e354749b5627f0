"""Near duplicates of embeddings: spherical k-means cells, compared inside in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.graph import components
from tablewright.sources.workspace import staged

THRESHOLD = 0.93
#: Vectors of a cell, about; the number of cells follows the number of vectors.
CELL = 1000
#: Smaller labels have so many cells too, if their vectors are ten times as many.
LEAST_CELLS = 4
#: Rows of a label that its cells are fitted on: a bounded sample by a hash of the id. Every vector is assigned.
FIT_ROWS = 10_000
#: Rows of a block; a task compares two blocks of a cell.
BLOCK = 1024
#: Vectors that are assigned to cells by one task.
ASSIGN_ROWS = 20_000
#: Vectors whose distances from all cells are held together.
STEP = 2_000
#: What names a vector inside a label: its smallest key, and two hashes, as one key may stand for several vectors.
NAME = ["rep", "h1", "h2"]


def near_duplicates(rows: DataFrame, key: str, vector: str, label: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component, kept) for every row.

    Only vectors of one label and length are compared, by cosine in double precision.
    A vector that is null or empty, has null or non-finite components or length 0, or
    whose label is null, is linked with nothing. `component` is the smallest key that
    links reach; the vector with it is kept. Rows repeated under one key are vectors
    of their own, equal or not, in one label or several. Keys are of any type that has
    an order and that pandas can hold.

    Equal vectors become one first. Cells are fitted by spherical k-means on a bounded
    sample of each label; each vector goes to its nearest cell and as a guest to all
    that a vector linked with it may be in, so no link is lost whatever the centres.
    Pairs of a cell that are not both guests are compared. A cell is cut into blocks,
    and each two blocks are a task, so no cell has to fit one. Where vectors do not
    cluster, few cells can be ruled out, and the work is that of comparing all pairs.
    """
    own = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # Two independent hashes name a vector.
    own = own.withColumns({"usable": usable & F.col("key").isNotNull(), "h1": F.xxhash64("v", F.lit(1)), "h2": F.xxhash64(F.lit(7), "v")})
    good = own.filter("usable")
    same = good.groupBy("label", "h1", "h2").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    reps = good.withColumnRenamed("key", "rep").join(same, ["rep", "label", "h1", "h2"])
    reps = reps.groupBy(*NAME, "label", F.size("v").alias("width")).agg(F.first("v").alias("v"), F.first("copies").alias("copies"))
    reps = staged(reps, "vectors")
    compared = staged(_compared(_cells(reps, threshold), threshold), "compared")
    # Copies link with each other whatever the threshold.
    counts = compared.groupBy(*NAME, "label").agg(F.sum("n").alias("n"))
    ends = [F.struct(*[F.col(prefix + c).alias(c) for c in NAME], "label") for prefix in ("", "root_")]
    reached = components(compared.select(ends[0].alias("a"), ends[1].alias("b"))).select("node.*", F.col("component.rep").alias("component"))
    known = same.join(counts, [*NAME, "label"], "left").join(reached, [*NAME, "label"], "left")
    known = known.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = good.join(known, ["label", "h1", "h2"]).select("key", "n_links", "component")
    alone = own.filter(~F.col("usable")).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    out = linked.unionByName(alone).withColumn("kept", F.col("key") == F.col("component"))
    return out.withColumnRenamed("key", key)


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), float).reshape(len(vectors), -1)
    m /= np.abs(m).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def fit(unit: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centres of spherical k-means, started from rows spread by a fixed seed."""
    centres = unit[np.random.default_rng(3).permutation(len(unit))[:cells]].copy()
    for _ in range(rounds):
        nearest = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def may_meet(unit: np.ndarray, centres: np.ndarray, home: np.ndarray, threshold: float) -> np.ndarray:
    """For each vector, the cells that a vector at least `threshold` similar to it may have as its home.

    A vector at home in cell c lies on c's side of the plane halfway between c and any
    other centre. From the other side, the sine of the angle to that plane is at most
    the sine of the angle between the two vectors. The allowance for rounding only adds cells.
    """
    apart = np.stack([np.linalg.norm(c - centres, axis=1) for c in centres])
    reach = np.sqrt(max(0.0, 1 - threshold * threshold)) if threshold > 0 else np.inf
    to = unit @ centres.T
    lead = to[np.arange(len(unit)), home][:, None] - to
    return (lead <= reach * apart[home] + 1e-9) | (reach == np.inf)


def _cells(reps: DataFrame, threshold: float) -> DataFrame:
    """Each vector with its own cell (`home`) and those it is compared in as a guest.

    Two cells that may hold linked vectors visit each other one way only: the smaller
    one is the host if their sum is even, else the larger one. So each pair meets once.
    """
    sizes = reps.groupBy("label", "width").agg(F.count("*").alias("total"))
    sizes = sizes.withColumn("salts", F.ceil(F.col("total") / ASSIGN_ROWS).cast("int"))
    sized = reps.join(sizes, ["label", "width"])
    share = FIT_ROWS / F.col("total")
    sample = sized.filter(F.pmod(F.xxhash64(*NAME), F.lit(1 << 20)) < share * (1 << 20))

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(NAME, ignore_index=True)
        # The sample is bounded, so this many cells are all that it can tell apart.
        cells = int(min(max(LEAST_CELLS, -(-rows["total"].iloc[0] // CELL)), max(1, len(rows) // 10)))
        centres = fit(_unit(rows["v"]), cells)
        first = rows.iloc[0]
        return pd.DataFrame({"label": [first["label"]], "width": [first["width"]], "salts": [first["salts"]], "centres": [centres.ravel().tolist()]})

    label = reps.schema["label"].dataType.simpleString()
    # Written, so that all tasks see the same centres.
    centres = staged(sample.groupBy("label", "width").applyInPandas(fitted, f"label {label}, width int, salts int, centres array<double>"), "centres")
    centres = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    salted = sized.withColumn("salt", F.pmod(F.xxhash64(*NAME, F.lit(2)), "salts").cast("int"))

    def assigned(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=columns)
        homes, guests = np.zeros(len(rows), np.int32), [[] for _ in range(len(rows))]
        if len(found):
            centres = np.array(found["centres"].iloc[0]).reshape(-1, rows["width"].iloc[0])
            cell = np.arange(len(centres))
            host = (cell[:, None] > cell) == ((cell[:, None] + cell) % 2 == 0)
            host[cell, cell] = False
            for lo in range(0, len(rows), STEP):
                unit = _unit(rows["v"].iloc[lo : lo + STEP])
                home = np.argmax(unit @ centres.T, axis=1)
                homes[lo : lo + STEP] = home
                visits = may_meet(unit, centres, home, threshold) & host[home]
                guests[lo : lo + STEP] = [np.flatnonzero(x).astype(np.int32).tolist() for x in visits]
        return rows[["label", "width", *NAME, "copies", "v"]].assign(home=homes, guests=guests)[columns]

    kind = reps.schema["rep"].dataType.simpleString()
    schema = f"label {label}, width int, home int, guests array<int>, rep {kind}, h1 long, h2 long, copies long, v array<double>"
    keys = ["label", "width", "salt"]
    columns = [c.split()[0] for c in schema.split(", ")]
    return salted.groupBy(*keys).cogroup(centres.groupBy(*keys)).applyInPandas(assigned, schema)


def _compared(cells: DataFrame, threshold: float) -> DataFrame:
    """(rep, h1, h2, n, root_rep, root_h1, root_h2, label) from each task: linked vectors counted with their copies, and the smallest one reached inside the task."""
    cells = staged(cells, "cells")
    visits = cells.withColumn("cell", F.explode(F.concat(F.array("home"), "guests"))).withColumn("here", F.col("cell") == F.col("home"))
    blocks = [F.ceil(F.count(F.when(x, 1)) / BLOCK).cast("int") for x in (F.col("here"), ~F.col("here"))]
    size = visits.groupBy("label", "width", "cell").agg(blocks[0].alias("own"), blocks[1].alias("guest"))
    dealt = visits.join(size, ["label", "width", "cell"])
    # The cell's own blocks come first. They meet all blocks, guests only those.
    drawn = F.xxhash64(*NAME, F.lit(4))
    block = F.when(F.col("here"), F.pmod(drawn, F.greatest("own", F.lit(1)))).otherwise(F.col("own") + F.pmod(drawn, F.greatest("guest", F.lit(1))))
    met = F.col("own") + F.when(F.col("here"), F.col("guest")).otherwise(0)
    dealt = dealt.filter("own > 0").withColumns({"block": block.cast("int"), "other": F.explode(F.sequence(F.lit(0), met - 1))})
    tasks = dealt.select("label", "width", "cell", "block", *NAME, "copies", "v", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(NAME, ignore_index=True)
        unit = _unit(rows["v"])
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        block, name = rows["block"].to_numpy(), rows[NAME]
        a, b = (np.flatnonzero(block == x) for x in (low, high))
        i, j = np.nonzero(unit[a] @ unit[b].T >= threshold)
        p, q = a[i], b[j]
        if low == high:
            once = p < q
            p, q = p[once], q[once]
        copies = rows["copies"].to_numpy()
        n = np.bincount(p, copies[q], len(rows)) + np.bincount(q, copies[p], len(rows))
        root = np.arange(len(rows))
        while True:  # rows are in order of their names, so the smallest place is the smallest name
            least = np.minimum(root[p], root[q])
            new = root.copy()
            np.minimum.at(new, p, least)
            np.minimum.at(new, q, least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = n > 0
        found = name[some].reset_index(drop=True).assign(n=n[some].astype(np.int64))
        for c in NAME:
            found["root_" + c] = name[c].to_numpy()[root[some]]
        return found.assign(label=rows["label"].iloc[0])[columns]

    kinds = {c: tasks.schema[c].dataType.simpleString() for c in (*NAME, "label")}
    schema = {**{c: kinds[c] for c in NAME}, "n": "long", **{"root_" + c: kinds[c] for c in NAME}, "label": kinds["label"]}
    columns = list(schema)
    return tasks.groupBy("label", "width", "cell", "low", "high").applyInPandas(compare, ", ".join(f"{c} {k}" for c, k in schema.items()))
