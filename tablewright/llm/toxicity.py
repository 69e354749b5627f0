"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.text import LETTERS_DIGITS, blocks, flat, mix, tidy, words

#: Rows that the model is learned from: bounded samples, chosen by a hash of the id.
LABELLED_ROWS, OTHER_ROWS = 20_000, 5_000
#: Bytes of the word beginnings that make the pattern voters.
BEGINNINGS = (4, 5, 6)
#: A word or beginning is one feature for each of these counts that a text reaches.
LEVELS = (1, 2, 4)
#: Features that the classifier may weigh: at most so many, with a log-likelihood ratio (against no
#: connection with the label) of at least this.
FEATURES, LEAST_TOLD = 20_000, 12.0
#: Voters: at most so many features, likelier in toxic texts, with a ratio of at least this.
VOTERS, LEAST_VOTE = 400, 24.0
#: The given label votes too, and is right this often.
LABEL_RIGHT = 0.995
#: Voters whose correlation within the classes is above this count as related.
RELATED = 0.1
THRESHOLD = 0.3

_FILTER_BITS = 22
#: Voters, or texts, whose votes are held as wider numbers at once.
_BLOCK, _BLOCK_TEXTS = 32, 2_048


@dataclass(frozen=True)
class Toxicity:
    """`weights[i, j]` is for base feature `ids[i]` at count LEVELS[j]; the rest describes the label model.

    `voters` are places in the flattened weights, `fires` how often each fires in
    toxic and other texts, `related` their correlations.
    """

    ids: np.ndarray
    weights: np.ndarray
    bias: float
    voters: np.ndarray
    fires: np.ndarray
    related: np.ndarray

    def score(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(key, score): the classifier's probability for the whole text; null and empty texts get that of no word at all."""
        scored = self._scored(docs.select(F.col(key), F.col(text)), text)
        return scored.select(key, F.col("__score").alias("score"))

    def below(self, docs: DataFrame, text: str, threshold: float) -> DataFrame:
        """`docs` without the rows that score `threshold` or more."""
        return self._scored(docs, text).filter(F.col("__score") < threshold).select(*docs.columns)

    def _scored(self, docs: DataFrame, text: str) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast((self.ids, np.cumsum(self.weights, axis=1), self.bias))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, total, bias = shared.value
            known = _Known(ids)
            for batch in batches:
                z = []
                for place, text_of, level, n in known.batch(batch.column(batch.schema.get_field_index(text))):
                    z.append(np.bincount(text_of, total[place, level], n))
                p = 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *z]) + bias, -40, 40)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "__score"])

        return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())]))


class _Known:
    """Finds the features of a sorted list in texts."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[ids >> np.uint64(64 - _FILTER_BITS)] = True

    def batch(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """For each block of texts: places in the list, the text's number, the level reached, and the number of texts."""
        data, at = flat(texts)
        for lo, hi in blocks(at):
            ids, owner = _features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            some = self.maybe[ids >> np.uint64(64 - _FILTER_BITS)]
            ids, owner = ids[some], owner[some]
            place = np.searchsorted(self.ids, ids)
            some = self.ids[np.minimum(place, len(self.ids) - 1)] == ids if len(self.ids) else np.zeros(len(ids), bool)
            pairs, times = np.unique(owner[some] * max(1, len(self.ids)) + place[some], return_counts=True)
            owner, place = np.divmod(pairs, max(1, len(self.ids)))
            yield place, owner, np.searchsorted(LEVELS, times, side="right") - 1, hi - lo


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str) -> Toxicity:
    """From documents and labels (key, toxic 0/1), both only of rows that may be learned from.

    Null labels do not count; of several for one key the largest holds. Without
    toxic and other labelled texts there are no voters, and the score is the share
    of toxic labels (0 without labels) for every text.
    """
    given = labels.filter("toxic is not null").groupBy(F.col(key).alias("k")).agg(F.max("toxic").alias("toxic"))
    ids = docs.select(F.col(key).alias("k")).filter("k is not null").distinct()
    chosen = ids.join(given, "k").orderBy(F.xxhash64("k"), "k").limit(LABELLED_ROWS)
    others = ids.join(given, "k", "left_anti").orderBy(F.xxhash64("k"), "k").limit(OTHER_ROWS)
    # Both samples have a fixed number of rows at most, so their ids are small enough to broadcast.
    picked = docs.sparkSession.createDataFrame(
        [(r["k"], r["toxic"]) for r in chosen.collect()] + [(r["k"], None) for r in others.collect()],
        f"k {docs.schema[key].dataType.simpleString()}, toxic int",
    )
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(picked), "k").select("text", "toxic")
    counts = {r["toxic"]: r["n"] for r in picked.filter("toxic is not null").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not other:
        share = toxic / max(1, toxic + other)
        bias = float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -40.0)
        none = np.zeros(0)
        return Toxicity(none.astype(np.uint64), np.zeros((0, len(LEVELS))), bias, none.astype(int), np.zeros((2, 0)), np.zeros((0, 0)))
    found, told, toward = _told(sample.filter("toxic is not null"), toxic, other)
    place, starts, label = _gathered(sample, found)
    strong = np.flatnonzero(((told >= LEAST_VOTE) & toward).ravel())
    voters = np.sort(strong[np.argsort(-told.ravel()[strong], kind="stable")][:VOTERS])
    votes = np.zeros((len(label), len(voters)), np.uint8)
    row = np.repeat(np.arange(len(label)), np.diff(starts))
    number = np.full(told.size, -1)
    number[voters] = np.arange(len(voters))
    fired = number[place] >= 0
    votes[row[fired], number[place[fired]]] = 1
    del row, number, fired
    posterior, fires, related = label_model(votes, label)
    weights, bias = _classifier(place, starts, posterior, told.ravel() >= LEAST_TOLD)
    return Toxicity(found, weights.reshape(told.shape), bias, voters, fires, related)


def _told(labelled: DataFrame, toxic: int, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base features that tell most, sorted; by level the log-likelihood ratio, and whether toxic texts have it more often."""
    columns = [f"{c}{level}" for level in LEVELS for c in ("bad", "n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(0))
            y = batch.column(1).to_numpy(zero_copy_only=False) == 1
            for lo, hi in blocks(at):
                ids, owner = _features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                order = np.lexsort((ids, owner))
                ids, owner = ids[order], owner[order]
                head = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])])) if len(ids) else np.zeros(0, int)
                times, bad = np.diff(np.append(head, len(ids))), y[lo:hi][owner[head]]
                feature, back = np.unique(ids[head], return_inverse=True)
                sums = [np.bincount(back, x & (times >= level), len(feature)).astype(np.int64) for level in LEVELS for x in (bad, np.ones_like(bad))]
                yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), *map(pa.array, sums)], ["id", *columns])

    counted = labelled.select("text", "toxic").mapInArrow(tidy(run), "id long, " + ", ".join(f"{c} long" for c in columns))
    counted = counted.groupBy("id").agg(*[F.sum(c).alias(c) for c in columns]).filter("n1 >= 4")
    ratios = [_ratio(F.col(f"bad{x}"), F.col(f"n{x}"), toxic, other).alias(f"g{x}") for x in LEVELS]
    toward = [(F.col(f"bad{x}") * other > (F.col(f"n{x}") - F.col(f"bad{x}")) * toxic).alias(f"t{x}") for x in LEVELS]
    rated = counted.select("id", *ratios, *toward).withColumn("worth", F.greatest(*[F.col(f"g{x}") for x in LEVELS]))
    best = rated.filter(F.col("worth") >= LEAST_TOLD).orderBy(F.desc("worth"), "id").limit(FEATURES).toPandas()
    ids = best["id"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(ids)
    pick = lambda c: np.stack([best[f"{c}{x}"].to_numpy()[order] for x in LEVELS], axis=1)
    return ids[order], pick("g").astype(float), pick("t").astype(bool)


def _ratio(bad: Column, n: Column, toxic: int, other: int) -> Column:
    """Log-likelihood ratio of a feature in `bad` of the toxic texts and n - bad of the others, against equal shares."""
    share = n / (toxic + other)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    good = n - bad
    terms = part(bad, share * toxic) + part(good, share * other) + part(toxic - bad, (1 - share) * toxic) + part(other - good, (1 - share) * other)
    return F.when((n > 0) & (n < toxic + other), 2 * terms).otherwise(0.0)


def _gathered(sample: DataFrame, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the bounded sample: feature numbers (base feature x level) one text after the other, their starts, labels (-1: none)."""
    width = len(LEVELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(ids)
        for batch in batches:
            at = 0
            for place, owner, level, n in known.batch(batch.column(0)):
                many = level + 1
                base, text = np.repeat(place, many), np.repeat(owner, many)
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array((base * width + step).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1)[at : at + n], lists], ["toxic", "seen"])
                at += n

    got = sample.select("text", "toxic").mapInArrow(tidy(run), "toxic int, seen array<int>").toArrow()
    label = np.nan_to_num(got["toxic"].to_numpy().astype(float), nan=-1).astype(int)
    seen = got["seen"].combine_chunks()
    seen = seen.chunk(0) if isinstance(seen, pa.ChunkedArray) else seen
    return seen.flatten().to_numpy(), seen.offsets.to_numpy() - seen.offsets[0].as_py(), label


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 for each text, how often each voter fires in texts of label 1 and 0, and their correlations.

    Expectation-maximisation over a model in which a voter fires at a rate of its own
    in each class. A voter that does not fire abstains, but a text on which all
    abstain is told by one more voter, the last. Voters are not independent: what
    they have in common beyond the classes is estimated along with the rates, and a
    voter's evidence is divided by the number of voters that say the same. The given
    label (-1: none) votes too.
    """
    # A byte a vote: sums run over blocks of them, so that the whole table is never held as numbers of 8 bytes.
    votes = np.column_stack([votes, ~votes.any(axis=1)]).astype(np.uint8, copy=False)
    known = label >= 0
    share = max(1e-3, min(0.999, (label == 1).sum() / max(1, known.sum())))
    own = np.where(known, np.where(label == 1, 1, -1) * np.log(LABEL_RIGHT / (1 - LABEL_RIGHT)), 0.0)
    posterior = np.where(known, np.where(label == 1, LABEL_RIGHT, 1 - LABEL_RIGHT), share)
    fires, related = np.zeros((2, votes.shape[1])), np.eye(votes.shape[1])
    for step in range(rounds):
        mass = np.array([posterior.sum(), (1 - posterior).sum()])
        toxic, other = np.concatenate([np.stack([posterior, 1 - posterior]) @ votes[:, at : at + _BLOCK].astype(float) for at in range(0, votes.shape[1], _BLOCK)], axis=1)
        fires = np.stack([(toxic + 0.1) / (mass[0] + 1), (other + 0.1) / (mass[1] + 1)])
        if step % 5 == 1:
            related = _correlations(votes, posterior, fires)
        alike = np.where(related > RELATED, related, 0).sum(axis=0)
        heard = np.log(fires[0] / fires[1]) / np.maximum(alike, 1)
        prior = mass[0] / mass.sum()
        z = np.log(prior / (1 - prior)) + own + sum(votes[:, at : at + _BLOCK] @ heard[at : at + _BLOCK] for at in range(0, len(heard), _BLOCK))
        posterior = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return posterior, fires, related


def _correlations(votes: np.ndarray, posterior: np.ndarray, fires: np.ndarray) -> np.ndarray:
    """Of each two voters, the correlation that is left within the classes."""
    # Counts, which float32 holds exactly up to 2^24, more than there are texts in a block.
    both = np.zeros((votes.shape[1],) * 2)
    for at in range(0, len(votes), _BLOCK_TEXTS):
        some = votes[at : at + _BLOCK_TEXTS].astype(np.float32)
        both += some.T @ some
    p, q = posterior.sum(), (1 - posterior).sum()
    apart = p * np.outer(fires[0], fires[0]) + q * np.outer(fires[1], fires[1])
    var = np.maximum(p * fires[0] * (1 - fires[0]) + q * fires[1] * (1 - fires[1]), 1e-9)
    out = np.clip((both - apart) / np.sqrt(np.outer(var, var)), -1, 1)
    np.fill_diagonal(out, 1)
    return out


def _classifier(seen: np.ndarray, starts: np.ndarray, posterior: np.ndarray, used: np.ndarray, rounds: int = 30, batch: int = 128) -> tuple[np.ndarray, float]:
    """Logistic regression on the posteriors over the features in use, by adaptive gradient steps over small batches."""
    n, size = len(posterior), len(used)
    weights, squares = np.zeros(size), np.full(size, 1e-2)
    share = np.clip(posterior.mean(), 1e-3, 0.999)
    bias, bias_square = float(np.log(share / (1 - share))), 1e-2
    order = np.random.default_rng(5)
    for _ in range(rounds):
        turn = order.permutation(n)
        for at in range(0, n, batch):
            rows = turn[at : at + batch]
            lengths = starts[rows + 1] - starts[rows]
            row = np.repeat(np.arange(len(rows)), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts[rows], lengths)
            number = seen[place]
            keep = used[number]
            row, number = row[keep], number[keep]
            z = np.bincount(row, weights[number], len(rows)) + bias
            error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - posterior[rows]
            touched, back = np.unique(number, return_inverse=True)
            step = np.bincount(back, error[row], len(touched)) / len(rows) + 3e-5 * weights[touched]
            squares[touched] += step**2
            weights[touched] -= 0.2 * step / np.sqrt(squares[touched])
            bias_square += error.mean() ** 2
            bias -= 0.2 * error.mean() / np.sqrt(bias_square)
    # The penalty pulls scores together; a line through them, fitted last, gives probabilities again.
    row = np.repeat(np.arange(n), np.diff(starts))
    keep = used[seen]
    slope, shift = _line(np.bincount(row[keep], weights[seen[keep]], n) + bias, posterior)
    return slope * weights, float(slope * bias + shift)


def _line(z: np.ndarray, posterior: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of z under which the logistic function fits the posteriors best (Newton's method, slightly held back)."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w = p * (1 - p)
        gradient = np.array([((p - posterior) * z).sum() + 1e-2 * (a - 1), (p - posterior).sum() + 1e-2 * b])
        curve = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        step = np.clip(np.linalg.solve(curve, gradient), -1, 1)
        a, b = max(0.1, a - step[0]), b - step[1]
    return float(a), float(b)


def _features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit id for each word and each beginning of a longer word, and the number of its text."""
    start, end, h, first = words(data, at, LETTERS_DIGITS)
    texts = np.repeat(np.arange(len(at) - 1), np.diff(first))
    ids, owners = [h], [texts]
    lower = np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint64)
    for n in BEGINNINGS:
        long = np.flatnonzero(end - start > n)
        code = np.full(len(long), n, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | lower[start[long] + i]
        ids.append(mix(code))
        owners.append(texts[long])
    return np.concatenate(ids), np.concatenate(owners)
