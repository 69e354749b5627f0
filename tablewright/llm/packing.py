"""Harmonic packing of tokenized documents into sequences of a fixed capacity."""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.text import release
from tablewright.sources.workspace import scratch_path

CAPACITY = 2048
#: Ends every document.
END_ID = 1
#: A rest of at most CAPACITY / 32 ids is not cut any more: at least 32 of its class share a sequence, so little is lost.
LAST_CLASS = 32
#: Pre-tokens whose ids a Python process remembers, from task to task, and their longest.
REMEMBERED = 1 << 19
LONGEST = 64
#: Pieces of a class are numbered in parts of about this many, side by side.
PIECES_PER_PART = 200_000


def cut(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces.

    Class k holds pieces of which exactly k share a sequence. Whole sequences come
    first. A rest between capacity / (k + 1) and capacity / k gives up a piece of
    exactly capacity / (k + 1), of which k + 1 fill a sequence; what remains is shorter
    than capacity / (k (k + 1)), so three or four pieces end every document.
    """
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if k >= LAST_CLASS or rest == capacity // k:
            pieces.append(rest)
            break
        pieces.append(capacity // (k + 1))
        rest -= capacity // (k + 1)
    return pieces


class WordIds(dict):
    """Ids of texts by a word-level BPE of the `tokenizers` library, remembered by pre-token.

    The tokenizer splits a text into pre-tokens and encodes each by itself. Texts
    whose lower-case characters are all up to U+024F are split here by the same rule, and a
    pre-token that is not remembered goes to the tokenizer's model; all others,
    and texts that hold the string of a token added to the vocabulary, are given to the
    tokenizer whole, which makes such a string that token.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        #: Pre-tokens of before; those that appear again are kept.
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE)
        letters = "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == "L")
        numbers = "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == "N")
        spaces = r"\t-\r \xa0"
        self.odd = re.compile(r"[^\t-\r -~\xa0-ɏ]")
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")
        probe = _probe("".join(chr(c) for c in range(0x250) if not self.odd.search(chr(c).lower())))
        if self(probe) != self._packed(self.tokenizer.encode(probe, add_special_tokens=False).ids):
            raise ValueError("the tokenizer splits a text differently")

    def __call__(self, text: str) -> bytes:
        """The ids as unsigned 32-bit little-endian numbers."""
        lower = text.lower()
        if self.odd.search(lower) or self.added.search(text):
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, self.split.findall(lower)))

    def __missing__(self, word: str) -> bytes:
        ids = self.older.pop(word, None)
        if ids is None:
            ids = self._packed([t.id for t in self.model.tokenize(word if word.isascii() else _byte_level(word))])
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return _numbers(len(ids))(*ids)


@cache
def _numbers(n: int) -> Callable[..., bytes]:
    return struct.Struct(f"<{n}I").pack


def _byte_level(word: str) -> str:
    """The characters that stand for the word's UTF-8 bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    return word.encode().decode("latin-1").translate(_BYTE_LEVEL)


_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LEVEL = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}


def _probe(characters: str) -> str:
    """A text that has them next to each other, to letters, digits, signs and spaces, and in contractions."""
    around = [f"{c} {c}a{c}{c}1{c}-{c}'s b{c}'ll 'T{c}" for c in characters]
    return "".join([characters, *around, " they're I'VE don't 'd'm"])


@cache
def _words(path: str) -> WordIds:
    return WordIds(path)


def tokenized(docs: DataFrame, key: str, text: str, path: str, ids: bool = True) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, ids): the pieces of every document, each ended by id 1.

    A null text is empty and has that one id; repeated rows are packed each for
    itself. `ids=False` leaves the ids themselves out.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _words(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            row, start, length, crc, tokens, pieces, size = [], [], [], [], [], [], 0

            def out(row=row, start=start, length=length, crc=crc, tokens=tokens, pieces=pieces, keys=batch.column(0)) -> pa.RecordBatch:
                columns = [keys.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
                return pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.binary())], ["key", "start", "length", "ids_crc32", "doc_tokens", "ids"])

            for i, value in enumerate(batch.column(1)):
                data = encode(value.as_py() or "") + end
                at, total = 0, len(data) // 4
                for n in cut(total):
                    piece = data[4 * at : 4 * (at + n)]
                    for x, v in zip((row, start, length, crc, tokens, pieces), (i, at, n, zlib.crc32(piece), total, piece if ids else None), strict=True):
                        x.append(v)
                    at += n
                size += len(data)
                if size >= 1 << 24:
                    yield out()
                    for x in (row, start, length, crc, tokens, pieces):
                        x.clear()
                    size = 0
            if row:
                yield out()
        release()

    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, schema)


def pack(docs: DataFrame, key: str, text: str, path: str, ids: bool = True) -> DataFrame:
    """The pieces with sequence_id and offset: harmonic packing by reciprocal-capacity classes.

    Class k takes the pieces between capacity / (k + 1) and capacity / k; k of them, in
    the order of their numbers, fill one sequence. Numbers are given side by side in
    parts of a class, after one count by class and part; sequences are then filled
    independently. Only the last sequence of each class can be short of pieces:
    their pieces, a fixed number at most whatever the input (under 20,000), are put
    into sequences by decreasing length, each into the first that has room.

    Texts are tokenized once; the pieces are written to the shared folder, their ids
    compressed. Each has a number there, by which its ids are joined to its place: they are
    shuffled once.
    """
    spark = docs.sparkSession
    path_out = scratch_path(spark, "pieces")
    found = tokenized(docs, key, text, path, ids)
    if ids:
        found = found.mapInArrow(_compressed, found.schema).withColumn("piece", F.monotonically_increasing_id())
    found.withColumn("k", F.floor(CAPACITY / F.col("length")).cast("int")).write.parquet(path_out)
    pieces = spark.read.parquet(path_out)
    parts = max(1, pieces.count() // PIECES_PER_PART)
    light = pieces.drop("ids").withColumn("part", F.pmod(F.xxhash64("key", "start"), F.lit(parts)).cast("int"))
    counts = light.groupBy("k", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("k", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("k", "part").orderBy("key", "start", "ids_crc32")) - 1
    ranked = light.withColumn("place", place).join(offsets, ["k", "part"]).withColumn("rank", F.col("base") + F.col("place"))
    binned = ranked.withColumn("bin", F.floor(F.col("rank") / F.col("k")))
    # Classes have their sequences one after the other.
    totals = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    first, at = {}, 0
    for k in sorted(totals):
        first[k] = at
        at += totals[k] // k
    if not totals:
        return pieces.drop("k", "piece").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).withColumnRenamed("key", key)
    base = spark.createDataFrame([(k, first[k], totals[k] // k) for k in totals], "k int, first_id long, bins long")
    binned = binned.join(F.broadcast(base), "k")
    inside = Window.partitionBy("k", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = binned.filter("bin < bins").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    filled = filled.withColumn("sequence_id", F.col("first_id") + F.col("bin"))
    rest = binned.filter("bin >= bins")
    columns = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["piece"] if ids else [])]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", piece long" if ids else "")
    last = rest.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda x: _first_fit(x, at)[columns], schema)
    packed = filled.select(*columns).unionByName(last)
    if ids:
        packed = packed.join(pieces.select("piece", "ids"), "piece").drop("piece")
        packed = packed.mapInArrow(_restored, packed.schema)
    return packed.withColumnRenamed("key", key)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with each row's ids compressed by itself."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        data = [codec.compress(x.as_buffer(), asbytes=True) for x in batch.column("ids")]
        yield batch.set_column(batch.schema.get_field_index("ids"), "ids", pa.array(data, pa.binary()))


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in batches:
        data = [codec.decompress(x.as_buffer(), 4 * n, asbytes=True) for x, n in zip(batch.column("ids"), batch.column("length").to_pylist(), strict=True)]
        yield batch.set_column(batch.schema.get_field_index("ids"), "ids", pa.array(data, pa.binary()))


def _first_fit(pieces, first_id: int):
    """Decreasing lengths, each into the first sequence with room."""
    pieces = pieces.sort_values(["length", "key", "start", "ids_crc32"], ascending=[False, True, True, True]).reset_index(drop=True)
    used: list[int] = []
    where, offset = [], []
    for n in pieces["length"]:
        i = next((i for i, u in enumerate(used) if u + n <= CAPACITY), len(used))
        if i == len(used):
            used.append(0)
        where.append(first_id + i)
        offset.append(used[i])
        used[i] += int(n)
    return pieces.assign(sequence_id=where, offset=offset)
