"""Substring deduplication against all windows of 50 words, by definition."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tablewright.llm import chunks, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def windows(text):
    data = (text or "").encode()
    start, end = chunks.units(np.frombuffer(data, np.uint8))
    out = []
    for k in range(len(start)):
        last = max(k + chunks.LEAST_WORDS - 1, int(np.searchsorted(end, start[k] + chunks.LEAST_RUN)))
        if last < len(start):
            out.append((int(start[k]), int(end[last])))
    return data, out


def by_definition(texts):
    """(key, text) -> merged spans of windows that a smaller key holds."""
    first = {}
    for key, text in texts:
        if key is not None:
            data, own = windows(text)
            for a, b in own:
                first[data[a:b]] = min(first.get(data[a:b], key), key)
    out = {}
    for key, text in texts:
        spans = []
        data, own = windows(text) if key is not None else (b"", [])
        for a, b in own:
            if first[data[a:b]] < key:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
        out[key, text] = [tuple(s) for s in spans]
    return out


def check(rows, texts):
    want = by_definition(texts)
    got = {(r["doc_id"], r["spans_text"]): [(s["start"], s["stop"]) for s in r["spans"] or []] for r in rows}
    assert got == want


def found(docs):
    """The spans of each row of `docs`, beside its text as it was."""
    spans = chunks.repeated_spans(docs, "doc_id", "text")
    return chunks.without_spans(docs.withColumn("spans_text", F.col("text")), "doc_id", "text", spans, into="spans").collect()


def test_query_by_definition(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf, "documents").collect()]
    want = by_definition(texts)
    got = {(r["doc_id"]): [(s["start"], s["stop"]) for s in r["spans"] or []] for r in queries.op4_chunk_dedup(spark, sf).collect()}
    assert got == {k: s for (k, _), s in want.items()} and any(got.values())


def test_edited_copies_by_definition(frame):
    rng = random.Random(3)
    texts = [(i, prose(rng, rng.randint(1, 400))) for i in range(12)]
    for i in range(12, 40):  # each an edit of two earlier ones
        a, b = (rng.choice(texts)[1].split() for _ in range(2))
        for w in (a, b):
            for _ in range(rng.randint(0, 4)):
                w.insert(rng.randint(0, len(w)), prose(rng, rng.randint(1, 3)))
                del w[rng.randint(0, len(w) - 1)]
        x, y = rng.randint(0, len(a)), rng.randint(0, len(b))
        texts.append((i, " ".join(a[:x] + b[y:]) or None))
    check(found(frame(texts, "doc_id long, text string")), texts)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_one_key_with_several_texts(frame, kind):
    rng = random.Random(6)
    passage, other, long = prose(rng, 70), prose(rng, 160), "é " + prose(rng, 300)
    texts = [(1, passage), (2, other), (2, prose(rng, 20) + " " + passage + " é"), (2, long), (3, long[:-9] + "日本"), (3, other), (3, other), (None, other), (4, None), (4, "")]
    texts = [(k if k is None or kind == "long" else str(k), t) for k, t in texts]
    docs = frame(texts, f"doc_id {kind}, text string")
    check(found(docs), texts)
    assert chunks.deduplicate(docs, "doc_id", "text").count() == len(texts)


def test_columns_may_have_any_name(spark, frame):
    rng = random.Random(7)
    passage = prose(rng, 70)
    schema = "doc_id long, text string, spans int, twin long, key string, cut int, `a b` int"
    docs = frame([(1, passage, 1, 2, "x", 3, 4), (2, passage, 1, 2, "x", 3, 4), (3, passage + " more", 5, 6, "y", 7, 8)], schema)
    got = corpus_pipeline.cut_repeated_passages(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, passage, 1, 2, "x", 3, 4), (3, " more", 5, 6, "y", 7, 8)]
    with pytest.raises(ValueError, match="already"):
        chunks.without_spans(docs, "doc_id", "text", chunks.repeated_spans(docs, "doc_id", "text"), into="spans")
