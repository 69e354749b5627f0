"""CSV records that span lines, read in splits.

Lines are read in splits, whatever fields they belong to. Whether a line starts
inside a quoted field depends on all lines before it in the file, but what a split
does to that state does not: each split reports the state after it under both
assumptions, a prefix over the splits of a file fixes the state before each, and
then every split puts its own records together. Only the record that a
split begins or ends in the middle of is put together from pieces, by a shuffle of these alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A field: quoted, with doubled quotes inside and whatever follows up to the comma; or bare,
# where a quote is a character like any other.
_FIELD = rb'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'
_FROM_RECORD = re.compile(_FIELD + rb"(?:," + _FIELD + rb")*+", re.DOTALL)
_FROM_QUOTES = re.compile(rb'(?:[^"]++|"")*+"[^,]*+(?:,' + _FIELD + rb")*+", re.DOTALL)

#: Rows and bytes handed on together.
_ROWS, _BYTES = 10_000, 1 << 24


def quoted_after(line: bytes, quoted: bool) -> bool:
    """Whether a quoted field is open after the line, given whether one was before it."""
    if b'"' not in line:
        return quoted
    return (_FROM_QUOTES if quoted else _FROM_RECORD).fullmatch(line) is None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    # Only a line feed ends a line here, so that a field keeps its carriage returns.
    return spark.read.text(path, lineSep="\n").select(
        F.expr("_metadata.file_path").alias("path"),
        F.expr("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )


def _split_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split makes of both states: (path, block, after_record, after_quotes)."""
    states: dict[tuple[str, int], tuple[bool, bool]] = {}
    for batch in batches:
        for path, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = states.get((path, block), (False, True))
            states[path, block] = (quoted_after(line, a), quoted_after(line, b)) if b'"' in line else (a, b)
    if states:
        paths, blocks = zip(*states, strict=True)
        a, b = zip(*states.values(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (paths, blocks, a, b)], ["path", "block", "after_record", "after_quotes"])


def open_splits(spark: SparkSession, path: str) -> DataFrame:
    """(path, block) of the splits that begin inside a quoted field."""
    states = _lines(spark, path).mapInArrow(_split_states, "path string, block long, after_record boolean, after_quotes boolean")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    # A split either fixes the state after it, or keeps it, or turns it round. What counts
    # is the last one that fixes it and the turns since.
    fixed = F.when(F.col("after_record") == F.col("after_quotes"), F.col("after_record").cast("int"))
    turn = (F.col("after_record") & ~F.col("after_quotes")).cast("int")
    states = states.withColumns({"fixed": fixed, "turns": F.sum(turn).over(so_far)})
    states = states.withColumns(
        {
            "last": F.coalesce(F.last("fixed", ignorenulls=True).over(before), F.lit(0)),
            "then": F.coalesce(F.last(F.when(F.col("fixed").isNotNull(), F.col("turns")), ignorenulls=True).over(before), F.lit(0)),
            "now": F.coalesce(F.last("turns").over(before), F.lit(0)),
        }
    )
    return states.filter((F.col("last") + F.col("now") - F.col("then")) % 2 == 1).select("path", "block")


def read_records(spark: SparkSession, path: str, encoding: str, decode=None) -> DataFrame:
    """(record, first): every record of the files as one text without its line end, and whether it is its file's first.

    `encoding` must keep ASCII as it is. Blank lines between records are left out. A
    quote that is never closed takes in the rest of its file, as one record. The
    driver learns which splits begin inside a quoted field; that is at most one entry
    for each task it has to schedule anyway.
    """
    opened = frozenset(tuple(r) for r in open_splits(spark, path).collect())

    def text(raw: bytes) -> str:
        raw = raw.removesuffix(b"\r")
        return decode(raw) if decode else raw.decode(encoding, "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "block", "kind", "first", "piece", "record"]
        out: list[tuple] = []
        held, size = 0, 0
        here: tuple[str, int] | None = None
        lines: list[bytes] = []
        inside = head = first = False

        def left() -> list[tuple]:
            """The unfinished record of the split that is over."""
            return [(*here, 0 if head else 2, first, b"\n".join(lines), None)] if here and lines else []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for where, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (where, block) != here:
                    out += left()
                    here, lines = (where, block), []
                    inside = head = here in opened
                    first = block == 0
                    if first:
                        line = line.removeprefix(b"\xef\xbb\xbf")
                lines.append(line)
                inside = quoted_after(line, inside)
                if not inside:
                    whole = b"\n".join(lines)
                    if head:
                        out.append((*here, 0, False, whole, None))
                    elif whole.strip() or first:
                        out.append((*here, 1, first, None, text(whole)))
                    held, size = held + 1, size + len(whole)
                    lines, head, first = [], False, False
                    if held >= _ROWS or size >= _BYTES:
                        if out:
                            yield batch_of(out)
                        out, held, size = [], 0, 0
        out += left()
        if out:
            yield batch_of(out)

    parts = _lines(spark, path).mapInArrow(run, "path string, block long, kind int, first boolean, piece binary, record string")
    # Pieces: at most the end of one record (kind 0) and the beginning of another (2) for each split.
    pieces = parts.filter("kind <> 1").select("path", "block", "kind", "first", "piece")
    order = Window.partitionBy("path").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    owned = pieces.withColumn("owner", F.last(F.when(F.col("kind") == 2, F.col("block")), ignorenulls=True).over(order))
    whole = owned.groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("pieces"), F.bool_or("first").alias("first"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = [text(b"\n".join(p["piece"] for p in pieces)) for pieces in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.string()), batch.column(1)], ["record", "first"])

    spanning = whole.select("pieces", "first").mapInArrow(joined, "record string, first boolean")
    return parts.filter("kind = 1").select("record", "first").unionByName(spanning)
