"""Language identification with language-bitmask n-gram filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.text import STEP, blocks, flat, mix

UNKNOWN = "und"
#: Labelled rows of each language that the filters are learned from: a bounded sample, chosen by a hash of the id.
ROWS_PER_LANGUAGE = 2000
#: Parts of a language that are sorted apart.
PARTS = 64
#: Bytes of an n-gram of the letters-only text.
GRAM = 5
#: A language's filter takes the n-grams in at least this share of its sampled texts,
LEAST_SHARE = 0.001
#: unless another language has them this many times more often: they stem from quoted passages.
MOST_FOREIGN = 20.0
#: Slots of the filter are 2 to this power; each holds one bit for each language.
SLOT_BITS = 21
PROBES = 2


@dataclass(frozen=True)
class LanguageFilters:
    """`masks[slot]` has bit i set if an n-gram of language i falls into the slot; `wrong[i]` is the share of foreign n-grams that pass."""

    languages: list[str]
    masks: np.ndarray
    wrong: np.ndarray

    def predict(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(key, lang_pred, score): the language with most n-grams after subtracting what passes its filter by chance.

        Null texts and texts without a letter are `und` with score 0, and so is all
        text if no language was learned. Equal counts go to the first name. `key`
        keeps its type; other columns are not read.
        """
        kind = docs.schema[key].dataType
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                best, score = own._batch(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), best, score], ["key", "lang_pred", "score"])

        rows = docs.select(F.col(key).alias("key"), _letters(F.col(text)).alias("letters"))
        out = f"key {kind.simpleString()}, lang_pred string, score double"
        return rows.mapInArrow(run, out).withColumnRenamed("key", key)

    def _batch(self, letters: pa.Array) -> tuple[pa.Array, pa.Array]:
        data, at = flat(letters)
        n = len(at) - 1
        best, score = np.full(n, -1), np.zeros(n)
        if self.languages:
            for lo, hi in blocks(at):
                hits, total = self._hits(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                fair = (hits - total[:, None] * self.wrong) / (1 - self.wrong)
                first = np.argmax(fair, axis=1)
                known = total > 0
                best[lo:hi] = np.where(known, first, -1)
                top = fair[np.arange(hi - lo), first] / np.maximum(total, 1)
                score[lo:hi] = np.where(known, np.clip(top, 0.0, 1.0), 0.0)
        names = np.array([*self.languages, UNKNOWN], dtype=object)
        return pa.array(names[best], pa.string()), pa.array(score)

    def _hits(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, its n-grams in each language's filter, and its n-grams."""
        n = len(at) - 1
        hits, total = np.zeros((n, len(self.languages))), np.zeros(n)
        for codes, texts in _grams(data, at):
            found = self.masks[_slot(codes, 0)]
            for probe in range(1, PROBES):
                found &= self.masks[_slot(codes, probe)]
            for i in range(len(self.languages)):
                bit = (found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                hits[:, i] += np.bincount(texts, weights=bit, minlength=n)
            total += np.bincount(texts, minlength=n)
        return hits, total


def learn(docs: DataFrame, key: str, text: str, lang: str, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageFilters:
    """Filters from the rows whose language is not null.

    At most `rows_per_language` rows of each language are read, those with the
    smallest hashes of `key`: first of each of `PARTS` parts of a language, so that a
    language of a third of all rows is not sorted by one task. The filter's size is fixed; only its slots, never
    texts or n-grams, come to the driver.
    """
    labelled = docs.filter(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"))
    chosen = labelled.distinct().withColumn("part", F.pmod(F.xxhash64("k", F.lit(5)), F.lit(PARTS)))
    for within in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*within).orderBy(F.xxhash64("k"), "k")
        chosen = chosen.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rows_per_language)
    sizes = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    width = max(1, -(-len(languages) // 64))
    masks = np.zeros((1 << SLOT_BITS, width), np.uint64)
    if languages:
        number = {name: i for i, name in enumerate(languages)}
        above, low = np.uint64(8 * GRAM), np.uint64((1 << 8 * GRAM) - 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = flat(batch.column(1))
                owner = np.array([number[x] for x in batch.column(0).to_pylist()], np.uint64)
                times: list[np.ndarray] = []
                for lo, hi in blocks(at):
                    part = _grams(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                    # A text's number in its block fits above the bits of an n-gram.
                    once = [np.unique((texts.astype(np.uint64) << above) | codes) for codes, texts in part]
                    pairs = np.unique(np.concatenate(once)) if once else np.zeros(0, np.uint64)
                    times.append((owner[lo:hi][(pairs >> above).astype(np.int64)] << above) | (pairs & low))
                found, n = np.unique(np.concatenate(times), return_counts=True) if times else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                codes = found & low
                columns = [(found >> above).astype(np.int32), codes.view(np.int64), n, *(_slot(codes, p).astype(np.int32) for p in range(PROBES))]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["language", "code", "n", *(f"s{p}" for p in range(PROBES))])

        schema = "language int, code long, n long, " + ", ".join(f"s{p} int" for p in range(PROBES))
        # At most rows_per_language ids of each language, so the ids are small enough to broadcast.
        ids = F.broadcast(chosen.select("k", "lang"))
        texts = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), _letters(F.col(text)).alias("letters")).join(ids, ["k", "lang"])
        grams = texts.select("lang", "letters").mapInArrow(run, schema)
        slots = [f"s{p}" for p in range(PROBES)]
        counted = grams.groupBy("language", "code", *slots).agg(F.sum("n").alias("n"))
        floor = F.element_at(F.array(*[F.lit(float(LEAST_SHARE * sizes[x])) for x in languages]), F.col("language") + 1)
        rate = F.col("n") / F.element_at(F.array(*[F.lit(float(sizes[x])) for x in languages]), F.col("language") + 1)
        top = F.max("rate").over(Window.partitionBy("code", *slots))
        own = counted.filter(F.col("n") >= floor).withColumn("rate", rate).withColumn("top", top).filter(F.col("rate") * MOST_FOREIGN >= F.col("top"))
        kept = own.select("language", F.explode(F.array(*slots)).alias("slot")).distinct()
        # One row for each slot and 64 languages: the size of the filter, whatever the input.
        planes = kept.groupBy("slot", (F.col("language") / 64).cast("int").alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, language % 64)")).alias("mask")
        )
        got = planes.toPandas()
        masks[got["slot"].to_numpy(), got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    full = [((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
    return LanguageFilters(languages, masks, np.minimum(np.array(full) ** PROBES, 0.99))


def _letters(text: Column) -> Column:
    """Lower-case letters with one space for all else; empty if there is no letter."""
    kept = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.when(F.length(kept) > 0, F.concat(F.lit("   "), kept, F.lit(" "))).otherwise("")


def _grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A code for each n-gram that lies inside one text, and the text's number; long texts in windows."""
    for base in range(0, len(data), STEP):
        window = data[base : base + STEP + GRAM - 1]
        n = len(window) - GRAM + 1
        if n <= 0:
            continue
        codes = np.zeros(n, np.uint64)
        for i in range(GRAM):
            codes = (codes << np.uint64(8)) | window[i : i + n]
        # An n-gram that begins in the last bytes of a text reaches into the next one.
        inside = np.ones(n, bool)
        ends = at[1:] - base
        for i in range(1, GRAM):
            over = ends - i
            inside[over[(over >= 0) & (over < n)]] = False
        edges = np.clip(at - base, 0, n)
        texts = np.repeat(np.arange(len(at) - 1), np.diff(edges))
        yield codes[inside], texts[inside]


def _slot(codes: np.ndarray, probe: int) -> np.ndarray:
    return (mix(codes + np.uint64(0x9E3779B97F4A7C15 * (2 * probe + 1) % (1 << 64))) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
