"""CSV scan: encoding, header, record shape and column types.

Files are probed as plain lines first. That scan is splittable and tells per
file how it is encoded and whether any line leaves a quote open. All files are
read in splits, those with records that span lines by way of `records`; only UTF-16 and UTF-32 need
Spark's whole-file CSV mode.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import batches, col, is_text, quoted
from .records import read_records

# The texts that mean "missing" in a CSV field.
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]
# What counts as a whole number and as a number.
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
REAL = r"^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
# Byte order marks (hexadecimal) and the encodings they announce.
BYTE_ORDER_MARKS = [
    ("FFFE0000", "UTF-32"),
    ("0000FEFF", "UTF-32"),
    ("FFFE", "UTF-16"),
    ("FEFF", "UTF-16"),
]

# What bytes 0x80 to 0x9F mean in Windows-1252; five of them mean nothing.
WINDOWS_1252 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰",
    0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•",
    0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}

_BROKEN = "tw_broken_record"


def probe_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, ascii, lines, spans_lines, same_header) per file, in one splittable scan.

    `same_header` compares the first line with that of one of the files. All
    aggregates are numbers and truth values, so lines are neither sorted nor shuffled.
    """
    try:
        texts = spark.read.text(path)
    except AnalysisException as e:
        raise ValueError(f"no files found at {path!r}") from e
    lines = texts.select(
        "value",
        F.expr("_metadata.file_path").alias("path"),
        F.expr("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    one_header = lines.filter("block = 0").select(F.xxhash64("value")).first()
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    start = F.hex(F.substring(F.col("value").cast("binary"), 1, 4))

    def first_line(test: Column) -> Column:
        return F.min(F.when((F.col("block") == 0) & test, F.col("line")))

    files = lines.groupBy("path").agg(
        first_line(F.lit(True)).alias("first"),
        *[first_line(start.startswith(mark)).alias(f"mark{i}") for i, (mark, _) in enumerate(BYTE_ORDER_MARKS)],
        first_line(F.xxhash64("value") == F.lit(one_header[0] if one_header else 0)).alias("header"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(F.decode(F.col("value").cast("binary"), "ISO-8859-1").rlike(r"[\x80-\x9F]")).alias("controls"),
        F.bool_and(~F.col("value").rlike(r"[^\x00-\x7F]")).alias("ascii"),
        F.count("*").alias("lines"),
        F.bool_or(quotes % 2 == 1).alias("open_quote"),
    )
    encoding = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, (_, name) in enumerate(BYTE_ORDER_MARKS):
        encoding = encoding.when(F.col(f"mark{i}") == F.col("first"), name)
    encoding = encoding.when(F.col("utf8"), "UTF-8").when(F.col("controls"), "windows-1252").otherwise("ISO-8859-1")
    return files.select(
        "path",
        encoding.alias("encoding"),
        (F.col("ascii") & (encoding == "UTF-8")).alias("ascii"),
        "lines",
        (F.col("open_quote") | encoding.isin("UTF-16", "UTF-32")).alias("spans_lines"),
        F.coalesce(F.col("header") == F.col("first"), F.lit(False)).alias("same_header"),
    )


def detect_encoding(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding): byte order mark, else valid UTF-8, else windows-1252 if bytes 0x80 to 0x9F occur, else ISO-8859-1."""
    return probe_files(spark, path).select("path", "encoding")


def header_names(raw: list[str | None]) -> list[str]:
    """Blank names become `Unnamed: i`; repeats become `x.1`, `x.2`, ..."""
    names: list[str] = []
    taken = {n for n in raw if n}
    for i, name in enumerate(raw):
        name = name or f"Unnamed: {i}"
        candidate, k = name, 0
        while candidate in names or (k and candidate in taken):
            k += 1
            candidate = f"{name}.{k}"
        names.append(candidate)
    return names


def scan_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Read CSV files with a header into typed columns (see `infer_types`).

    A record with more fields than the header is an error; a shorter one is
    filled with nulls.
    """
    found = (
        probe_files(spark, path)
        .agg(
            # Files of ASCII only are valid in each of the others' encodings that contains it.
            F.sort_array(F.collect_set(F.when(~F.col("ascii"), F.col("encoding")))).alias("encodings"),
            F.bool_or("ascii").alias("ascii"),
            F.bool_or("spans_lines").alias("spans_lines"),
            F.sum("lines").alias("lines"),
            F.bool_and("same_header").alias("same_header"),
        )
        .first()
    )
    if not found.lines:
        raise ValueError(f"the files at {path!r} are empty")
    if encoding is None:
        encodings = set(found.encodings)
        if "windows-1252" in encodings:
            encodings.discard("ISO-8859-1")  # such files hold none of the bytes that differ
        if found.ascii and not encodings & {"UTF-8", "ISO-8859-1", "windows-1252"}:
            encodings.add("UTF-8")
        if len(encodings) > 1:
            raise ValueError(f"files at {path!r} differ in encoding: {sorted(encodings)}; scan them apart")
        encoding = encodings.pop()
    if not found.same_header:
        raise ValueError(f"files at {path!r} have different headers; scan them apart")
    if found.spans_lines and encoding not in ("UTF-16", "UTF-32"):
        names, strict, rows = _read_spanning(spark, path, encoding)
    else:
        names, strict, rows = _read_lines(spark, path, encoding)
    types, too_long = _inferred(strict, names, _is_too_long(len(names)))
    if too_long:
        raise ValueError(f"{too_long} record(s) at {path!r} have more than {len(names)} fields")
    return _typed(rows, types)


# A quoted field doubles its quotes; Spark's own default is a backslash.
_OPTIONS = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": _BROKEN}


def _read_lines(spark: SparkSession, path: str, encoding: str) -> tuple[list[str], DataFrame, DataFrame]:
    """Column names, the rows as texts with their broken records, and the rows as texts, by Spark's CSV reader."""
    # Spark's reader does not take windows-1252; it differs from ISO-8859-1 in 27 characters only.
    windows = encoding == "windows-1252"
    options = _OPTIONS | {"encoding": "ISO-8859-1" if windows else encoding, "multiLine": encoding in ("UTF-16", "UTF-32")}
    header = list(spark.read.options(header=False, **options).csv(path).first())
    names = header_names([h and h.translate(WINDOWS_1252) for h in header] if windows else header)
    fields = [T.StructField(n, T.StringType()) for n in names]
    reader = spark.read.options(header=True, **options)
    strict = reader.schema(T.StructType([*fields, T.StructField(_BROKEN, T.StringType())])).csv(path)
    rows = reader.schema(T.StructType(fields)).csv(path)
    if windows:
        old, new = "".join(map(chr, WINDOWS_1252)), "".join(WINDOWS_1252.values())
        rows = rows.select(*[F.translate(col(n), old, new).alias(n) for n in names])
    return names, strict, rows


def _read_spanning(spark: SparkSession, path: str, encoding: str) -> tuple[list[str], DataFrame, DataFrame]:
    """The same for records that span lines."""

    def windows(raw: bytes) -> str:
        return raw.decode("ISO-8859-1").translate(WINDOWS_1252)

    records = read_records(spark, path, encoding, windows if encoding == "windows-1252" else None)
    first = records.filter("first").select("record").distinct().limit(2).collect()
    if len(first) != 1:
        raise ValueError(f"files at {path!r} have different headers; scan them apart")
    line = spark.createDataFrame(first)
    width = first[0]["record"].count(",") + 1  # no more, as some commas may be quoted
    texts = ", ".join(f"c{i} string" for i in range(width))
    found = line.select(F.from_csv("record", texts, _OPTIONS | {"mode": "PERMISSIVE"}).alias("r")).select("r.*").first()
    size = _fields(first[0]["record"])
    names = header_names(list(found)[:size])
    kinds = ", ".join(f"c{i} string" for i in range(size))
    parsed = records.filter("not first").select(F.from_csv("record", f"{kinds}, {_BROKEN} string", _OPTIONS).alias("r"))
    values = [F.col("r").getField(f"c{i}").alias(n) for i, n in enumerate(names)]
    return names, parsed.select(*values, F.col("r").getField(_BROKEN).alias(_BROKEN)), parsed.select(*values)


def _fields(record: str) -> int:
    return len(re.sub(r'"(?:[^"]|"")*"', "", record).split(","))


def infer_types(df: DataFrame) -> DataFrame:
    """Type the string columns: NA tokens to null, then long, double, boolean or string.

    A whole-number column with nulls becomes double and a boolean column with
    nulls stays string. Other columns are left alone.
    """
    names = [f.name for f in df.schema.fields if is_text(f.dataType)]
    types, _ = _inferred(df, names, F.lit(False))
    return _typed(df, types)


def _is_too_long(fields: int) -> Column:
    # A record that does not match the schema is kept whole; count its
    # separators outside quotes to tell a long one from a short one.
    bare = F.regexp_replace(col(_BROKEN), r'"([^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) >= fields


def _known(name: str) -> Column:
    return F.when(~col(name).isin(NA_TOKENS), col(name))


def _inferred(df: DataFrame, names: list[str], bad: Column) -> tuple[dict[str, str], int]:
    types: dict[str, str] = {}
    bad_rows = 0
    for chunk in batches(names, per_item=4):
        known = df.select(
            *[_known(n).alias(f"v{i}") for i, n in enumerate(chunk)], F.coalesce(bad, F.lit(False)).alias("bad")
        )
        counts = [F.count("*").alias("rows"), F.count_if("bad").alias("bad")]
        for i in range(len(chunk)):
            v = F.col(f"v{i}")
            counts += [
                F.count(v).alias(f"known{i}"),
                F.count_if(v.rlike(WHOLE) & v.try_cast("bigint").isNotNull()).alias(f"whole{i}"),
                F.count_if(v.rlike(REAL)).alias(f"real{i}"),
                F.count_if(v.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"bool{i}"),
            ]
        row = known.agg(*counts).first()
        bad_rows = row["bad"]
        for i, n in enumerate(chunk):
            types[n] = _type_of(row["rows"], *(row[f"{k}{i}"] for k in ("known", "whole", "real", "bool")))
    return types, bad_rows


def _type_of(rows: int, known: int, whole: int, real: int, boolean: int) -> str:
    if whole == known == rows and rows > 0:
        return "bigint"
    if real == known:
        return "double"
    if boolean == known == rows:
        return "boolean"
    return "string"


def _typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    out = []
    for f in df.schema.fields:
        kind = types.get(f.name)
        if kind is None:
            out.append(F.expr(quoted(f.name)))
        elif kind == "string":
            out.append(_known(f.name).alias(f.name))
        elif kind == "boolean":
            out.append(_known(f.name).isin(TRUE_TOKENS).alias(f.name))
        else:
            out.append(_known(f.name).try_cast(kind).alias(f.name))
    return df.select(*out)
