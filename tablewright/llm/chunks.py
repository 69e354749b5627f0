"""Substring deduplication: chunks cut by a gear rolling hash, deduplicated by digest, their matches extended byte by byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.text import BETWEEN_SPACES, flat, tidy
from tablewright.sources.workspace import staged

#: A chunk has at least so many words and bytes and at most so many bytes; in between, one word in 2^CUT_BITS begins a new one.
LEAST_CHUNK_WORDS, LEAST_CHUNK, MOST_CHUNK, CUT_BITS = 3, 12, 512, 2
#: A cut depends on 2 to this power bytes before it, so it is the same in all copies of a passage from there on.
WINDOW_BITS = 3
#: Bytes that a match is extended by on each side of its chunks.
REACH = 512
#: Chunks at the beginning of a passage whose cuts may still depend on what stands before it.
SETTLED = 3
#: A passage counts from so many words and so many bytes on. 50 words have 99 bytes, so the bytes
#: bind only where there are no spaces.
LEAST_WORDS, LEAST_RUN = 50, 96
#: Longer runs without white space are taken apart into characters, as are scripts written without spaces.
LONG_WORD = 50
#: Bytes of text that are hashed together, and rows that are handed on together.
STEP, ROWS = 1 << 20, 200_000
#: Rows and bytes of a table that may be sent to all executors; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 1 << 25

_GEAR = np.random.default_rng(23).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CUT = np.uint64((1 << CUT_BITS) - 1) << np.uint64(64 - CUT_BITS)
#: A chunk's place as one number: its start, its size, and the words (at most MANY) of the SETTLED + 1 chunks before, its own, and those of the chunk after.
_SIZE_BITS, _WORD_BITS = 10, 6
MANY = (1 << _WORD_BITS) - 1
#: First bytes of characters that may belong to scripts without spaces.
_APART = np.isin(np.arange(256), [0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, *range(0xF0, 0xF5)])
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def cuts(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The ends of the chunks of one text, whose words begin at `start`. Far from the last forced cut they depend on the bytes just before them only."""
    n, behind = len(data), (1 << WINDOW_BITS) - 1
    found = []
    for lo in range(0, n, STEP):
        a, b = np.searchsorted(start, (max(lo, 1), lo + STEP))
        at = max(0, lo - behind - 1)
        h = _GEAR[data[at : lo + STEP]]
        for i in range(WINDOW_BITS):
            h[1 << i :] += h[: -(1 << i)] << np.uint64(1 << i)
        found.append(a + np.flatnonzero((h[start[a:b] - 1 - at] & _CUT) == 0))
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    ends, last, word = [], 0, 0
    for k, c in zip(places.tolist(), start[places].tolist(), strict=True):
        if k - word >= LEAST_CHUNK_WORDS and c - last >= LEAST_CHUNK:
            while c - last > MOST_CHUNK:
                last += MOST_CHUNK
                ends.append(last)
            ends.append(c)
            last, word = c, k
    while n - last > MOST_CHUNK:
        last += MOST_CHUNK
        ends.append(last)
    if n > last:
        ends.append(n)
    return np.array(ends, np.int64)


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of one text. Where there are no spaces, every character counts as a word."""
    inside = BETWEEN_SPACES[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    first, last = edges[::2], edges[1::2]
    if not len(first):
        return first, last
    if not _APART[data].any() and (last - first).max() < LONG_WORD:
        return first, last
    places = np.flatnonzero(((data & 0xC0) != 0x80) & inside)
    owner = np.searchsorted(first, places, side="right") - 1
    a, b = data[places], data[np.minimum(places + 1, len(data) - 1)]
    # Thai, Lao, Tibetan; Burmese, Khmer; kana and Han; full width; further Han.
    apart = ((a == 0xE0) & (b >= 0xB8)) | ((a == 0xE1) & ((b <= 0x82) | (b == 0x9E) | (b == 0x9F)))
    apart |= ((a >= 0xE3) & (a <= 0xE9)) | ((a == 0xEF) & (b >= 0xBC)) | ((a == 0xF0) & (b >= 0xA0))
    apart |= (last - first >= LONG_WORD)[owner]
    begins = apart | (places == first[owner])
    begins[1:] |= apart[:-1]
    start, owner = places[begins], owner[begins]
    return start, np.minimum(np.append(start[1:], len(data)), last[owner])


def _places(begins: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    words = np.minimum(np.diff(np.searchsorted(start, np.append(begins, ends[-1:]))), MANY)
    out = begins << _SIZE_BITS | (ends - begins)
    total = np.append(0, np.cumsum(words))
    before = total[:-1] - total[np.maximum(np.arange(len(words)) - SETTLED - 1, 0)]
    for w in (np.minimum(before, MANY), words, np.append(words[1:], 0)):
        out = out << _WORD_BITS | w
    return out


def _digests(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of BLAKE2b of each."""
    whole = b"".join([hashlib.blake2b(p, digest_size=12).digest() for p in pieces])
    both = np.frombuffer(whole, np.dtype([("h1", "<i8"), ("h2", "<i4")]))
    return both["h1"], both["h2"]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, twin, text) to (key, twin, h, at): a row a chunk."""
    columns = ["key", "twin", "h", "at"]
    for batch in batches:
        data, at = flat(batch.column(2))
        owners, found, size = [], [], 0
        for i in range(len(at) - 1):
            own = data[at[i] : at[i + 1]]
            start = units(own)[0]
            ends = cuts(own, start)
            begins = np.append(0, ends[:-1])
            raw, places = own.tobytes(), _places(begins, ends, start)
            for lo in range(0, len(ends), ROWS):
                a, b = (x[lo : lo + ROWS].tolist() for x in (begins, ends))
                # What a chunk says is confirmed by the bytes around it, so 64 bits are enough here.
                found.append((_digests([raw[x:y] for x, y in zip(a, b, strict=True)])[0], places[lo : lo + ROWS]))
                owners.append(np.full(len(a), i))
                size += len(a)
                if size >= ROWS:
                    yield _chunk_rows(batch, owners, found, columns)
                    owners, found, size = [], [], 0
        if size:
            yield _chunk_rows(batch, owners, found, columns)


def _chunk_rows(batch: pa.RecordBatch, owners: list, found: list, columns: list[str]) -> pa.RecordBatch:
    rows = pa.array(np.concatenate(owners))
    return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], columns)


def _twin(docs: DataFrame, key: str, text: str) -> Column:
    """What tells texts of one key apart; a constant where no key repeats."""
    repeats = not docs.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").isEmpty()
    return F.xxhash64(text) if repeats else F.lit(0).cast("long")


def _sent(df: DataFrame, size: Column) -> DataFrame:
    """A staged table, marked for broadcast if it is small in rows and bytes."""
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def _runs(least_words: int):
    """(key, twin, met) to a row for each run of chunks that stand one after the other in one source.

    Known chunks that follow each other, from whatever sources, with the few before in which
    cuts settle and the one after are all that a match can cover: were further ones in
    it, they would be known as well. Where these hold too few words, there is no run.
    """
    names = ["key", "twin", "start", "stop", "s_key", "s_twin", "s_start"]

    def of(met: pa.StructArray) -> tuple:
        at, source, twin, there = (met.field(k) for k in ("at", "s_key", "s_twin", "s_at"))
        order = np.unique(at.to_numpy(), return_index=True)[1]  # rows may repeat
        at, there, twin = (x.to_numpy()[order] for x in (at, there, twin))
        codes = source.dictionary_encode().indices.to_numpy(zero_copy_only=False)[order]
        before, own, after = (at >> k * _WORD_BITS & MANY for k in (2, 1, 0))
        at, there = at >> 3 * _WORD_BITS, there >> 3 * _WORD_BITS
        size = at & ((1 << _SIZE_BITS) - 1)
        start, origin = at >> _SIZE_BITS, there >> _SIZE_BITS
        apart = np.ones(len(at), bool)
        apart[1:] = start[1:] != start[:-1] + size[:-1]
        head = np.flatnonzero(apart)
        tail = np.append(head[1:], len(at)) - 1
        words = np.add.reduceat(np.where(own == MANY, 1 << 30, own), head)
        words += np.where(before[head] == MANY, 1 << 30, before[head]) + np.where(after[tail] == MANY, 1 << 30, after[tail])
        enough = np.repeat(words >= least_words, tail - head + 1)
        new = apart.copy()
        new[1:] |= (codes[1:] != codes[:-1]) | (twin[1:] != twin[:-1]) | (origin[1:] != origin[:-1] + size[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        first, last = first[enough[first]], last[enough[first]]
        return start[first], (start + size)[last], source.take(pa.array(order[first])), twin[first], origin[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(met.values) for met in batch.column(2)]
            if found:
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                start, stop, twin, origin = (pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1, 3, 4))
                source = pa.concat_arrays([f[2] for f in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), start, stop, source, twin, origin], names)

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, twin, text, wanted) to (s_key, s_twin, pos, side, near): the bytes before (side 0) or after (side 1) a place."""
    for batch in batches:
        data, at = flat(batch.column(2))
        owners, places, sides, near = [], [], [], []
        for i in range(batch.num_rows):
            own = data[at[i] : at[i + 1]]
            for code in batch.column(3)[i].values.to_numpy().tolist():
                p, side = code >> 1, code & 1
                owners.append(i)
                places.append(p)
                sides.append(side)
                near.append((own[p : p + REACH] if side else own[max(0, p - REACH) : p]).tobytes())
        rows = pa.array(owners, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(places, pa.int64()), pa.array(sides, pa.int64()), pa.array(near, pa.binary())], ["s_key", "s_twin", "pos", "side", "near"])


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Bytes that both begin with."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def _joins(data: np.ndarray, at: int) -> bool:
    """Whether the byte there, if any, is of a character that makes one word with its neighbours."""
    if not 0 <= at < len(data):
        return False
    while at and data[at] & 0xC0 == 0x80:
        at -= 1
    return bool(BETWEEN_SPACES[data[at]] and not _APART[data[at]])


def _found(least_words: int):
    """(key, twin, text, runs) to (key, twin, start, stop, h1, h2): repeated stretches, with null hashes, and windows that only another document may hold whole."""

    def of(data: np.ndarray, runs: list[dict]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        start, end = units(data)
        if len(start) < least_words:
            return [], []
        spans, covered = [], np.zeros(len(start), bool)
        for r in runs:
            before, after = (np.frombuffer(r[k], np.uint8) for k in ("before", "after"))
            back = _same(data[max(0, r["start"] - REACH) : r["start"]][::-1], before[::-1])
            on = _same(data[r["stop"] : r["stop"] + REACH], after)
            a, b = r["start"] - back, r["stop"] + on
            i, j = int(np.searchsorted(start, a)), int(np.searchsorted(end, b, side="right"))
            # What is a whole word here may be the end or the beginning of a longer one there.
            if i < len(start) and start[i] == a and not _APART[data[a]] and _joins(before, len(before) - 1 - back) and not _joins(data, a - 1):
                i += 1
            if j and end[j - 1] == b and not _APART[data[start[j - 1]]] and _joins(after, on) and not _joins(data, b):
                j -= 1
            if j - i >= least_words and end[j - 1] - start[i] >= LEAST_RUN:
                spans.append((int(start[i]), int(end[j - 1])))
        # Windows whose chunks all stand in earlier documents, though in no single one that was looked at.
        ends = cuts(data, start)
        begins = np.concatenate([[0], ends[:-1]])
        known = np.zeros(len(ends) + 1, np.int64)
        for r in runs:
            known[np.searchsorted(begins, r["start"]) : np.searchsorted(ends, r["stop"]) + 1] = 1
        n = len(start)
        last = np.maximum(np.arange(n) + least_words - 1, np.searchsorted(end, start + LEAST_RUN))
        first = np.flatnonzero(last < n)
        lo, hi = start[first], end[last[first]]
        i, j = np.searchsorted(begins, lo), np.searchsorted(ends, hi, side="right")
        j -= (j == len(ends)) & (j > i)  # the last chunk ends where the text does, not where a copy's would
        bad = np.flatnonzero(known[: len(ends)] == 0)
        # Cuts agree with those of a copy from a few chunks on.
        late = np.searchsorted(bad, i + SETTLED)
        reached = np.append(bad, len(ends))[late]
        sure = np.maximum(i, np.append(-1, bad)[late] + 1)
        mixed = (reached >= j) & (j - sure >= 2)
        for a, b in spans:
            mixed &= ~((lo >= a) & (hi <= b))
        return spans, list(zip(lo[mixed].tolist(), hi[mixed].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "twin", "start", "stop", "h1", "h2"]
        for batch in batches:
            data, at = flat(batch.column(2))
            for i in range(batch.num_rows):
                own = data[at[i] : at[i + 1]]
                spans, mixed = of(own, batch.column(3)[i].as_py())
                raw = own.tobytes()
                for places, hashed in ((spans, False), (mixed, True)):
                    for lo in range(0, len(places), ROWS):
                        some = places[lo : lo + ROWS]
                        h = _digests([raw[a:b] for a, b in some]) if hashed else ([None] * len(some),) * 2
                        rows = pa.array(np.full(len(some), i))
                        a, b = zip(*some, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(h[0], pa.int64()), pa.array(h[1], pa.int32())], names)

    return run


def repeated_spans(docs: DataFrame, key: str, text: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, twin, spans): the bytes (start, stop) of each text that stand in a document with a smaller key.

    A word is repeated if it lies in a stretch of at least `least_words` words, and
    96 bytes, that one document with a smaller key holds byte for byte, as the same words. Spans begin and end with
    words. Repetitions within one document are its own affair and stay, as do those
    among different texts of one key; `twin` tells such texts apart, so that spans are
    taken out of their own text only. Rows without a key or with fewer than 96 bytes have
    no spans. Keys may be of any type with an order; other columns are not read.

    Chunks are cut where a gear hash of the last bytes says so, so an insertion moves
    only the cuts near it. Each digest keeps the first document that holds it, with the
    place there; this table is aggregated in every task first, written, and joined to
    the chunks in a sort-merge join whose large partitions Spark splits, so a passage that a third of all documents
    share burdens no single task. Chunks that follow each other here and in one source are a run;
    the bytes around a run are compared with those of its source, up to `REACH` on each side, which finds the true
    ends. Where all chunks of `least_words` words are known, but from several sources, the windows
    of just these places are compared by digest. Missed is only a passage that holds no
    whole chunk: about 1 in 10,000 at 50 words.
    """
    own = docs.select(F.col(key).alias("key"), _twin(docs, key, text).alias("twin"), F.col(text).alias("text"))
    own = own.filter(F.col("key").isNotNull() & (F.octet_length("text") >= LEAST_RUN))
    kind = docs.schema[key].dataType.simpleString()
    pieces = own.mapInArrow(tidy(_pieces), f"key {kind}, twin long, h long, at long")
    first = pieces.groupBy("h").agg(F.min(F.struct("key", "twin", "at")).alias("s"), F.max("key").alias("last")).filter("s.key < last")
    first = staged(first.select("h", F.col("s.key").alias("s_key"), F.col("s.twin").alias("s_twin"), F.col("s.at").alias("s_at")), "first-chunks")
    met = pieces.join(first, "h").filter("s_key < key").groupBy("key", "twin").agg(F.collect_list(F.struct("at", "s_key", "s_twin", "s_at")).alias("met"))
    runs = staged(met.mapInArrow(tidy(_runs(least_words)), f"key {kind}, twin long, start long, stop long, s_key {kind}, s_twin long, s_start long"), "runs")

    s_stop = F.col("s_start") + F.col("stop") - F.col("start")
    wanted = runs.select("s_key", "s_twin", F.explode(F.array(F.col("s_start") * 2, s_stop * 2 + 1)).alias("code"))
    wanted = staged(wanted.groupBy(F.col("s_key").alias("key"), F.col("s_twin").alias("twin")).agg(F.collect_set("code").alias("wanted")), "wanted")
    sources = own.join(_sent(wanted, F.size("wanted") * 8 + 32), ["key", "twin"]).select("key", "twin", "text", "wanted")
    near = staged(sources.mapInArrow(tidy(_contexts), f"s_key {kind}, s_twin long, pos long, side long, near binary"), "contexts")
    before, after = (near.filter(F.col("side") == k).select("s_key", "s_twin", F.col("pos").alias(p), F.col("near").alias(name)) for k, p, name in ((0, "s_start", "before"), (1, "s_stop", "after")))
    around = runs.withColumn("s_stop", s_stop).join(before, ["s_key", "s_twin", "s_start"]).join(after, ["s_key", "s_twin", "s_stop"])
    around = around.groupBy("key", "twin").agg(F.collect_list(F.struct("start", "stop", "before", "after")).alias("runs"))
    found = own.join(around, ["key", "twin"]).select("key", "twin", "text", "runs").mapInArrow(tidy(_found(least_words)), f"key {kind}, twin long, start long, stop long, h1 long, h2 int")
    found = staged(found, "found")

    windows = found.filter(F.col("h1").isNotNull())
    again = staged(windows.groupBy("h1", "h2").agg(F.min("key").alias("s_key"), F.max("key").alias("last")).filter("s_key < last").drop("last"), "windows")
    mixed = windows.join(again, ["h1", "h2"]).filter("s_key < key").select("key", "twin", "start", "stop")
    each = found.filter(F.col("h1").isNull()).select("key", "twin", "start", "stop").unionByName(mixed)
    each = each.groupBy("key", "twin").agg(F.collect_list(F.struct("start", "stop")).alias("found"))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_union(x.values.field("start").to_numpy(), x.values.field("stop").to_numpy()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(spans, _SPAN)], ["key", "twin", "spans"])

    spans = each.mapInArrow(tidy(union), f"key {kind}, twin long, spans array<struct<start:long,stop:long>>")
    return staged(spans.withColumnRenamed("key", key), "spans")


def _union(start: np.ndarray, stop: np.ndarray) -> list[dict]:
    """Overlapping and adjoining stretches as one span each."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
    return [{"start": a, "stop": b} for a, b in zip(start[new].tolist(), stop[np.append(new[1:], len(start)) - 1].tolist(), strict=True)]


def without_spans(docs: DataFrame, key: str, text: str, spans: DataFrame, into: str | None = None) -> DataFrame:
    """`docs` with the texts' spans (start, stop in bytes) taken out, all columns and other texts as they were.

    Spans end where words or characters do, and exactly their bytes go. What is left on
    both sides is joined by a single space unless white space is there already. `into`
    names a last column that keeps the spans, null for untouched texts; it must be none
    of the columns of `docs`.
    """
    if into in docs.columns:
        raise ValueError(f"there is a column {into!r} already")
    # Column names of `docs` may be any; ours differ from all of them.
    taken = "_".join(["spans", *docs.columns])
    mine = _sent(spans, F.size("spans") * 16 + 48).select(F.col(key).alias(f"key_{taken}"), F.col("twin").alias(f"twin_{taken}"), F.col("spans").alias(taken))
    twin = _twin(docs, key, text)
    joined = docs.join(mine, (F.col(key) == F.col(f"key_{taken}")) & (twin == F.col(f"twin_{taken}")), "left").select(*docs.columns, taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, last = batch.schema.get_field_index(text), batch.num_columns - 1
            texts = batch.column(i)
            touched = np.flatnonzero(batch.column(last).is_valid().to_numpy(zero_copy_only=False))
            if len(touched):
                new = texts.to_pylist()
                for row in touched.tolist():
                    if new[row] is not None:
                        new[row] = _left(new[row], batch.column(last)[row].as_py())
                texts = pa.array(new, texts.type)
            columns = [texts if k == i else c for k, c in enumerate(batch.columns)]
            out = pa.RecordBatch.from_arrays(columns, batch.schema.names)
            yield out if into else out.select(batch.schema.names[:last])

    schema = joined.schema if into else docs.schema
    out = joined.mapInArrow(tidy(run), schema)
    return out.withColumnRenamed(taken, into) if into else out


def _left(text: str, spans: list[dict]) -> str:
    data = text.encode()
    out, at = bytearray(), 0
    for s in spans:
        a, b = s["start"], s["stop"]
        out += data[at:a]
        if out and bytes(out[-1:]) not in _SPACES and b < len(data) and data[b : b + 1] not in _SPACES:
            out += b" "
        at = b
    return bytes(out + data[at:]).decode("utf-8")


_SPACES = {bytes([c]) for c in (*range(9, 14), 32)}


def deduplicate(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`docs` with every passage that a document with a smaller key holds taken out of the later ones."""
    return without_spans(docs, key, text, repeated_spans(docs, key, text))
