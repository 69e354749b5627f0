from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tablewright.llm import queries  # noqa: E402

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    key = list(want.columns)
    want, got = (x.sort_values(key).reset_index(drop=True).astype(object).where(x.sort_values(key).reset_index(drop=True).notna(), None) for x in (want, got))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_language_is_held_out_right(spark, sf):
    docs = queries.table(spark, sf, "documents").select("doc_id", "lang")
    got = queries.op1_language_masks(spark, sf).filter("held_out").join(docs, "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9


def test_stages_follow_each_other(spark, sf):
    docs, columns = queries.table(spark, sf, "documents"), queries.table(spark, sf, "documents").columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == columns
            now = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert 0 < len(now) <= len(before) and set(now) <= set(before)
            if name in ("toxicity", "ngram_jaccard_join"):
                assert all(before[i] == t for i, t in now.items())
            else:
                assert all(set(t.split()) <= set(before[i].split()) or name == "benchmark_decontamination" for i, t in now.items() if t)
            before = now
    packed = docs.toPandas()
    assert set(packed.doc_id) == set(before)
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert corpus_pipeline.ORACLE_SQL is None


def test_cutting_passages_drops_only_what_it_emptied(spark, frame):
    passage = " ".join(f"word{i}" for i in range(70))
    texts = [(1, passage), (2, passage), (3, "\n" + passage + "\n"), (4, ""), (5, "   "), (6, "\n\t"), (7, None), (8, "few words")]
    got = corpus_pipeline.cut_repeated_passages(spark, frame(texts, "doc_id long, text string"), "")
    assert got.columns == ["doc_id", "text"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {i: t for i, t in texts if i not in (2, 3)}
