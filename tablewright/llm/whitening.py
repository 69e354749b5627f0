"""Whitening of embeddings: exact integer scatter from bit planes packed across rows, then the eigenvectors of its covariance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.sources.workspace import staged

#: Entries become whole numbers of 1/SCALE.
SCALE = 256
COMPONENTS = 4
#: Rows whose bit planes are packed together.
STEP = 8192
#: Bytes of ANDed planes held at once.
HELD = 1 << 24
#: A component counts if its eigenvalue is above this share of the trace; below, it is rounding.
LEAST_SHARE = 1e-12
#: Entries beyond this are refused: scaled, a double no longer tells whole numbers apart.
MOST = 2.0**44


def usable(vector: str) -> Column:
    """Neither null nor holding null or non-finite entries."""
    return F.coalesce(F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def _whole(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, all of one width, as whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    return np.floor(values * SCALE).astype(np.int64).reshape(len(column), -1)


def scatter(x: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """Sum over rows of the outer products of x - low, from AND-popcounts of bit planes; whole and exact.

    Plane b of a dimension holds bit b of its shifted values, 64 rows a word. The
    product of two dimensions is the sum of 2^(a+b) times the rows set in both planes.
    """
    y = (x - low).T.astype(np.uint64)
    width, n = y.shape
    words = -(-n // 64)
    planes = np.zeros((bits, width, words * 8), np.uint8)
    for b in range(bits):
        planes[b, :, : -(-n // 8)] = np.packbits((y >> np.uint64(b)).astype(np.uint8) & 1, axis=1, bitorder="little")
    planes = planes.view(np.uint64)
    out = np.zeros((width, width), np.int64)
    at_once = max(1, HELD // max(1, width * words * 8))
    for a in range(bits):
        for b in range(a, bits):
            for lo in range(0, width, at_once):
                met = np.bitwise_count(planes[a, lo : lo + at_once, None] & planes[b, None]).sum(axis=2, dtype=np.int64) << (a + b)
                out[lo : lo + at_once] += met
                if a != b:  # planes b of one side with planes a of the other: the same counts, turned
                    out[:, lo : lo + at_once] += met.T
    return out


@dataclass
class Whitening:
    """What whitening one table takes; bounded by the square of the dimension."""

    width: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates. n * x - S is whole, so nothing is lost before the division."""
        centred = self._apart(x).astype(float) / self.n
        return centred @ self.vectors / np.sqrt(self.values)

    def _apart(self, x: np.ndarray) -> np.ndarray:
        most = self.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        kind = np.int64 if most < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        apart = self._apart(x)
        if apart.dtype != object and len(self.sums) * int(np.abs(apart).max(initial=0)) ** 2 >= 1 << 63:
            apart = apart.astype(object)
        return (apart * apart).sum(axis=1)

    def transform(self, rows: DataFrame, key: str, vector: str) -> DataFrame:
        """(key, component, n, deviation, whitened, explained, identity_error) for each usable row of this width."""
        kind = rows.schema[key].dataType.simpleString()
        own = rows.filter(usable(vector) & (F.size(vector) == self.width)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
        columns = ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        many = len(self.values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, STEP):
                    part = batch.slice(lo, STEP)
                    x, k = _whole(part.column(1)), part.num_rows
                    each = np.arange(k * many)
                    arrays = [
                        part.column(0).take(pa.array(each // many)),
                        pa.array((each % many + 1).astype(np.int32)),
                        pa.array(np.full(k * many, self.n, np.int64)),
                        pa.array([int(d) for d in np.repeat(self.deviation(x), many)], pa.int64()),
                        pa.array(self.of(x).ravel()),
                        pa.array(np.tile(self.explained, k)),
                        pa.array(np.full(k * many, self.identity_error)),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, columns)

        schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        if not many:
            out = rows.sparkSession.createDataFrame([], schema)
        else:
            out = own.mapInArrow(run, schema)
        return out.withColumnRenamed("key", key)


def learn(rows: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening:
    """Fitted on each distinct scaled vector once.

    Vectors that are null or hold null or non-finite entries take no part, and of the
    others only those of the most frequent length (of equally frequent ones the
    longest). Entries become x = floor(256 c); an entry of 2^44 or more is an error.
    Repeated vectors, whatever their ids, count once. A component whose eigenvalue is
    within rounding of 0 is left out, so one distinct vector, equal ones or an empty
    table give no components and no rows.

    Distinct vectors are shuffled as packed integers of the least width that holds
    them. Each task packs the bit planes of its rows and adds up one matrix;
    matrices are summed as decimals, so the scatter is exact at any number of rows. Only d * d
    sums reach the driver, which centres them as whole numbers, n XX' - S S', before
    it divides. `identity_error` is measured by another pass over the distinct vectors.
    """
    good = rows.filter(usable(vector)).select(F.col(vector).cast("array<double>").alias("v"))
    widths = good.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("most"))
    found = widths.orderBy(F.desc("n"), F.desc("width")).first()
    if found is None or not found["width"]:
        return Whitening(0, 0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    width, most = found["width"], found["most"]
    if most >= MOST:
        raise ValueError(f"an entry of {most} is too large to be scaled exactly")
    size = next(k for k in (1, 2, 4, 8) if most * SCALE + 1 < 1 << (8 * k - 1))
    packed = np.dtype(f"<i{size}")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _whole(batch.column(0)).astype(packed).tobytes()
            offsets = np.arange(batch.num_rows + 1, dtype=np.int64) * width * size
            column = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([column.cast(pa.binary())], ["x"])

    distinct = staged(good.filter(F.size("v") == width).mapInArrow(pack, "x binary").distinct(), "vectors")

    def unpacked(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(0).to_pylist()), packed).reshape(-1, width).astype(np.int64)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = unpacked(batch)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(low), pa.array(high)], ["i", "low", "high"])

    ends = distinct.mapInArrow(ranges, "i long, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    low = np.array([r["low"] for r in ends])
    bits = max(1, max(r["high"] - r["low"] for r in ends).bit_length())
    upper = np.triu_indices(width)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, n = np.zeros((width, width), np.int64), np.zeros(width, np.int64), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                x = unpacked(batch.slice(lo, STEP))
                if n and (n + len(x)) * 2 ** (2 * bits) >= 1 << 62:  # before 64 bits are full
                    yield from summed(total, first, n)
                    total, first, n = np.zeros_like(total), np.zeros_like(first), 0
                total += scatter(x, low, bits)
                first += (x - low).sum(axis=0)
                n += len(x)
        if n:
            yield from summed(total, first, n)

    def summed(total: np.ndarray, first: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        i = np.concatenate([upper[0], np.arange(width), [-1]])
        j = np.concatenate([upper[1], np.full(width + 1, -1)])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.concatenate([total[upper], first, [n]]))], ["i", "j", "s"])

    if 2 * bits >= 60:
        raise ValueError("entries differ too much for exact products in 64 bits")
    parts = distinct.mapInArrow(sums, "i long, j long, s long").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    total = {(r["i"], r["j"]): int(r["s"]) for r in parts.collect()}
    n = total[-1, -1]
    shifted = [total[i, -1] for i in range(width)]
    covariance = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            # Shifting all rows by one vector does not change n XX' - S S'. True division of whole numbers rounds once.
            covariance[i, j] = covariance[j, i] = (n * total[i, j] - shifted[i] * shifted[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > LEAST_SHARE * trace]
    out = Whitening(width, n, [s + n * int(b) for s, b in zip(shifted, low, strict=True)], values[order], np.ascontiguousarray(vectors[:, order]), values[order] / trace if trace else values[order])
    if not order:
        return out
    k = len(order)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                w = out.of(unpacked(batch.slice(lo, STEP)))
                total += w.T @ w
                first += w.sum(axis=0)
        i = np.concatenate([np.repeat(np.arange(k), k), np.arange(k)])
        j = np.concatenate([np.tile(np.arange(k), k), np.full(k, -1)])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.concatenate([total.ravel(), first]))], ["i", "j", "s"])

    # The coordinates are centred already; their mean is rounding.
    measured = {(r["i"], r["j"]): r["s"] / n for r in distinct.mapInArrow(products, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    out.identity_error = max(abs(measured[i, j] - measured[i, -1] * measured[j, -1] - (i == j)) for i in range(k) for j in range(k))
    return out
