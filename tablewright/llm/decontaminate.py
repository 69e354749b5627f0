"""Benchmark decontamination: an FM-index over each shard of the corpus, searched for the benchmark's phrases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.fm_index import FMIndex
from tablewright.llm.text import LETTERS_DIGITS, blocks, flat, tidy, words

#: Words of a window.
WINDOW = 10
#: Bytes of text that one index covers.
SHARD_BYTES = 1 << 24
#: Bytes of benchmark texts that are searched for in one pass; a larger benchmark takes several.
PASS_BYTES = 1 << 25

_FOUND = "array<struct<item:string,start:int,stop:int,from:int,to:int>>"
_KIND = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("from", pa.int32()), ("to", pa.int32())]))


@dataclass(frozen=True)
class Phrases:
    """Distinct windows of the items as symbols: number + 1 of a word in the sorted hashes `vocabulary`."""

    vocabulary: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    owner_window: np.ndarray
    owner_item: np.ndarray
    items: list[str]

    @classmethod
    def of(cls, items: pa.Array, texts: pa.Array, window: int) -> Phrases:
        data, at = flat(texts)
        _, _, h, first = words(data, at, LETTERS_DIGITS)
        vocabulary, symbol = np.unique(h, return_inverse=True)
        rows, lengths, owners = [], [], []
        for i in range(len(at) - 1):
            own = symbol[first[i] : first[i + 1]] + 1
            if not len(own):
                continue
            n = min(window, len(own))
            some = np.zeros((len(own) - n + 1, window), np.int64)
            some[:, :n] = np.lib.stride_tricks.sliding_window_view(own, n)
            rows.append(some)
            lengths.append(np.full(len(some), n))
            owners.append(np.full(len(some), i))
        if not rows:
            none = np.zeros(0, np.int64)
            return cls(vocabulary, np.zeros((0, window), np.int64), none, none, none, [])
        every = np.concatenate(rows)
        windows, number = np.unique(every, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([number.ravel(), np.concatenate(owners)]), axis=1)
        return cls(vocabulary, windows, (windows > 0).sum(axis=1), pairs[0], pairs[1], [str(x) for x in items.to_pylist()])

    def occurrences(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the words of the shard where they begin.

        Words that no item has take part in no match and end a run, and runs shorter
        than the shortest window are left out; the index holds all the rest.
        """
        none = np.zeros(0, np.int64)
        if not len(self.windows) or not len(h):
            return none, none
        place = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == h
        breaks = np.zeros(len(h) + 1, bool)
        breaks[first] = True
        begins = np.flatnonzero(known & (breaks[:-1] | ~np.concatenate([[False], known[:-1]])))
        ends = np.flatnonzero(known & (breaks[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        long = ends - begins >= self.lengths.min()
        begins, ends = begins[long], ends[long]
        if not len(begins):
            return none, none
        sizes = ends - begins + 1
        origin = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes)
        last = np.cumsum(sizes) - 1
        symbols = np.zeros(len(origin), np.int64)
        inside = np.ones(len(origin), bool)
        inside[last] = False
        symbols[inside] = place[origin[inside]] + 1
        index = FMIndex(symbols)
        lo, hi = index.search(self.windows, self.lengths)
        count = hi - lo
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return np.repeat(np.arange(len(count)), count), origin[index.locate(rows)]


def find(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str, window: int = WINDOW) -> DataFrame:
    """`docs` (key, text) with n_words and `found`: for each item, merged spans of the words that its windows hit.

    A window is `window` consecutive words of an item, an item of fewer words being
    one window; items without words have none. start and stop count words, from and
    to bytes. Null and empty texts have no words. Each task indexes its own texts in
    shards of bounded size and searches them for all windows: no row is shuffled. A
    benchmark beyond `PASS_BYTES` is taken in parts, one pass over the texts each.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.withColumn("n_words", F.lit(0).cast("long")).withColumn("found", F.array().cast(_FOUND))
    listed = items.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null")
    size = listed.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = size // PASS_BYTES + 1
    for part in range(parts):
        chosen = listed.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        got = chosen.orderBy("item").toArrow().combine_chunks()
        rows = _pass(rows, Phrases.of(got["item"].combine_chunks(), _one(got["text"]), window))
    return rows.withColumnsRenamed({"key": key, "text": text})


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole


def _pass(rows: DataFrame, phrases: Phrases) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(phrases)  # windows of at most PASS_BYTES of texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, at = flat(batch.column(1))
            counts = np.zeros(len(at) - 1, np.int64)
            found = batch.column(3).to_pylist()
            for lo, hi in blocks(at, SHARD_BYTES):
                start, end, h, first = words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], LETTERS_DIGITS)
                counts[lo:hi] = np.diff(first)
                for row, spans in _spans(own, start, end, h, first, at[lo : hi + 1] - at[lo]):
                    found[lo + row] += spans
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts), pa.array(found, _KIND)], ["key", "text", "n_words", "found"]
            )

    return rows.mapInArrow(tidy(run), rows.schema)


def _spans(phrases: Phrases, start, end, h, first, at) -> Iterator[tuple[int, list[dict]]]:
    """For each text that holds a window: spans by item, overlapping and adjoining ones merged."""
    window, place = phrases.occurrences(h, first)
    if not len(window):
        return
    # One row for each item that has the window.
    by_window = np.searchsorted(phrases.owner_window, np.arange(len(phrases.windows) + 1))
    many = by_window[window + 1] - by_window[window]
    owner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(by_window[window], many)
    item, begin = phrases.owner_item[owner], np.repeat(place, many)
    stop = begin + np.repeat(phrases.lengths[window], many)
    row = np.searchsorted(first, begin, side="right") - 1
    order = np.lexsort((stop, begin, item, row))
    item, begin, stop, row = item[order], begin[order], stop[order], row[order]
    group = np.concatenate([[True], (item[1:] != item[:-1]) | (row[1:] != row[:-1])])
    number = np.cumsum(group)
    # Furthest end so far within the group: groups are kept apart by a multiple of the words.
    reach = np.maximum.accumulate(stop + number * (len(h) + 1)) - number * (len(h) + 1)
    new = group.copy()
    new[1:] |= begin[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [len(begin)]]) - 1
    spans: dict[int, list[dict]] = {}
    for a, b in zip(heads.tolist(), tails.tolist(), strict=True):
        r, x, y = int(row[a]), int(begin[a]), int(reach[b])
        base = int(first[r])
        spans.setdefault(r, []).append(
            {"item": phrases.items[item[a]], "start": x - base, "stop": y - base, "from": int(start[x] - at[r]), "to": int(end[y - 1] - at[r])}
        )
    yield from spans.items()


def report(found: DataFrame) -> DataFrame:
    """Adds n_hit (words in any span), n_items and items_sha256 to the result of `find`."""
    items = F.array_sort(F.array_distinct(F.col("found.item")))
    spans = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].cast("long").alias("a"), x["stop"].cast("long").alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    hit = F.aggregate(
        spans,
        zero,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["b"]).alias("end")
        ),
        lambda acc: acc["n"],
    )
    return found.withColumns(
        {"n_hit": hit, "n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.concat_ws(",", items), 256)}
    )


def removed(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str, window: int = WINDOW) -> DataFrame:
    """`docs` with the words of all spans taken out of the texts, a space in their place; other columns are kept.

    A document of which no word is left goes, as long as it had one.
    """
    # Everything but the text travels in one struct through the passes.
    packed = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("rest"), F.col(text).alias("text"))
    found = find(packed, items, "rest", "text", item, item_text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for value, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                left = _without(value, spans) if spans else value
                texts.append(left)
                keep.append(not spans or any(LETTERS_DIGITS[b] for b in left.encode()))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, batch.column(1).type)], ["rest", "text"])
            yield out.filter(pa.array(keep))

    touched = found.select("rest", "text", "found").mapInArrow(tidy(run), found.select("rest", "text").schema)
    return touched.select(*[F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def _without(text: str, spans: list[dict]) -> str:
    data, out, at = text.encode(), bytearray(), 0
    for s in sorted(spans, key=lambda s: s["from"]):
        if s["from"] > at:
            out += data[at : s["from"]] + (b" " if at or s["from"] else b"")
        at = max(at, s["to"])
    return bytes(out + data[at:]).decode("utf-8")
