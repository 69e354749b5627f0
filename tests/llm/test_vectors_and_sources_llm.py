"""Search trees, source divergence and whitening against brute force, with nulls, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from tablewright.llm import ann, divergence, queries, whitening

VECTORS = "vec_id long, embedding array<float>, name string, v int, leaf int, n long"
ODD = [(90, None), (91, []), (92, [0.0, 0.0, 0.0]), (93, [1.0, None, 0.0]), (94, [float("nan"), 1.0, 0.0]), (95, [float("inf"), 0.0, 1.0]), (96, [1.0, 2.0])]


def vectors(frame, rows):
    """With extra columns whose names operators use inside."""
    return frame([(i, v, "x", 1, 2, 3) for i, v in rows], VECTORS)


def nearest(rows, asked, k=5):
    """By definition, from all pairs."""
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 3 and all(c is not None and np.isfinite(c) for c in v) and any(v)})
    out = {}
    for i, v in good:
        if asked(i):
            a = np.array(v)
            scored = sorted((-float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), j) for j, w in good if j != i for b in [np.array(w)])
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_search_opens_all_leaves_if_recall_must_be_whole(frame, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 8)
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "ASKS", 4)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(150)]
    same = [0.5, 0.25, -1.0]
    rows += [(i, same) for i in range(200, 290)] + [rows[7], rows[7], (None, same), *[(i + 400, v) for i, v in ODD]]
    asked = lambda i: i % 10 == 0
    got = ann.search(vectors(frame, rows), "vec_id", "embedding", "vec_id % 10 = 0", recall=1.0).collect()
    want = nearest(rows, asked)
    assert {r["query_id"] for r in got} == set(want)
    for i, best in want.items():
        own = sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert np.allclose([r["score"] for r in own], [s for _, s in best], rtol=0, atol=1e-12)
        assert [(r["vec_id"], round(r["score"], 9)) for r in own if r["score"] < 1 - 1e-9] == [(j, round(s, 9)) for j, s in best if s < 1 - 1e-9]
    copies = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 200), key=lambda r: r["rank"])]
    assert copies == [201, 202, 203, 204, 205]


def test_search_odd_tables(frame):
    for rows in ([], ODD, [(0, [1.0, 0.0, 0.0])]):
        assert ann.search(vectors(frame, rows), "vec_id", "embedding", "vec_id % 2 = 0").count() == 0
    few = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 1.0, 0.0]), (3, [2.0, 2.0, 0.0]), (5, [1e300, 0.0, 0.0])]
    got = ann.search(frame(few, "vec_id long, embedding array<double>"), "vec_id", "embedding", "vec_id % 2 = 0").collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 5), (2, 1), (3, 3)]
    names = [("b", [1.0, 0.0, 0.0]), ("a", [1.0, 0.0, 0.0]), ("c", [0.0, 1.0, 0.0])]
    got = ann.search(frame(names, "id string, vector array<double>"), "id", "vector", "id = 'b'").collect()
    assert [(r["query_id"], r["rank"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == [("b", 1, "a"), ("b", 2, "c")]


def test_search_reaches_the_recall_it_was_calibrated_for(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, sf, "embeddings").collect()]
    ids, m = np.array([i for i, _ in rows]), ann.unit(np.array([v for _, v in rows], float))
    got = {(r["query_id"], r["vec_id"]) for r in queries.op11_kmeans_tree(spark, sf).collect()}
    asked = np.flatnonzero(ids % 50 == 0)
    near = m[asked] @ m.T
    near[np.arange(len(asked)), asked] = -2
    want = {(ids[a], ids[b]) for a, row in zip(asked, np.argsort(-near, axis=1)[:, :5], strict=True) for b in row}
    assert len(got) == len(want) and len(want & got) >= 0.9 * len(want)


def test_best_bin_first_order():
    rng = np.random.default_rng(2)
    middle = ann.unit(rng.normal(size=(40, 16)))
    points = ann.unit(np.repeat(middle, 50, axis=0) + rng.normal(scale=0.05, size=(2000, 16)))
    tree = ann.fit(points, 60)
    home = tree.home(points)
    assert set(home) <= set(tree.leaves)
    size = np.bincount(home, minlength=len(tree.count))
    few = tree.visits(points[:100], 3, size, 0)
    assert [x[0] for x in few] == home[:100].tolist()
    assert all(len(set(x)) == 3 for x in few)
    near = points[:100] @ points.T
    found = [home[j] in few[i] for i in range(100) for j in np.argsort(-near[i])[:6]]
    assert np.mean(found) > 0.95
    whole = tree.visits(points[:5], 1, size, len(points))
    assert all(sorted(x) == sorted(np.unique(home)) or size[x].sum() == len(points) for x in whole)


def divergence_by_hand(rows, least=3, most=200):
    found = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in found}:
        docs = Counter(t for x in found if x[0] == lang for t in x[2])
        kept = sorted(t for t, n in docs.items() if n >= least)
        counts = {s: Counter() for x, s, _ in found if x == lang}
        for x, s, c in found:
            if x == lang:
                counts[s].update({t: n for t, n in c.items() if t in set(kept)})
        whole = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c.values()) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        for s, c in counts.items():
            p, q = shares(c), shares(whole)
            pairs = [(sum((p[t] - r[t]) ** 2 // r[t] for t in kept), o) for o in counts if o != s for r in [shares(counts[o])]]
            terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if c[t] and p[t] > q[t]]
            for part, values, cut in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:cut]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence(frame, monkeypatch, small):
    if small:  # many blocks, many runs, no broadcast
        for name, value in (("GROUPS", 2), ("TERMS", 3), ("HELD", 500), ("BROADCAST_GROUPS", 1)):
            monkeypatch.setattr(divergence, name, value)
    rng = random.Random(4)
    words = ["Ab", "aB", "ab", "é", "ZÉ", "x1y", "straße", "日本", "q", "w", "e", "r", "t", "yy", "uuu"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", "fr", None]), rng.choice(["a", "b", "c", "d", "é", "Z", None])) for _ in range(120)]
    rows += [("ab " * 5000, "en", "a"), (None, "en", "empty"), ("", "xx", "y"), (None, None, None), ("12 !?", "xx", "z"), ("one time", "alone", "s")] + [("same same text", "en", "b")] * 3
    docs = frame([(*r, 1, 2, "t") for r in rows], "text string, lang string, source string, n long, p int, term string")
    got = sorted(tuple(r) for r in divergence.audit(docs, "text", "lang", "source").collect())
    assert got == divergence_by_hand(rows)
    assert sorted(tuple(r) for r in divergence.audit(docs, "text", "lang", "source", most_ranks=2).collect()) == divergence_by_hand(rows, most=2)


def test_divergence_of_no_documents(frame):
    assert divergence.audit(frame([], "text string, lang string, source string"), "text", "lang", "source").count() == 0


def test_shares_are_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    pairs = [(0, 1), (6, 7), (10**12, 3 * 10**12 + 7), (8 * 10**15, 8 * 10**15 + 11), (123456789012, 987654321098765)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", divergence.share(F.col("a"), F.col("b")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["a"] + 1) // r["b"] for r in got)


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(8)
    for n, width, most in ((1, 1, 2), (63, 5, 500), (64, 3, 1 << 20), (1000, 17, 513)):
        x = rng.integers(-most, most, (n, width))
        low = x.min(axis=0)
        bits = max(1, int((x.max(axis=0) - low).max()).bit_length())
        assert (whitening.scatter(x, low, bits) == (x - low).T @ (x - low)).all()


def whitened_by_hand(x):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - u.mean(axis=0)
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:4], w[:, ::-1][:, :4]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ w / np.sqrt(e), e / np.trace(v)


def test_whitening(frame):
    rng = np.random.default_rng(3)
    m = (rng.normal(size=(300, 6)) * [1, 2, 3, 0.5, 4, 9]).astype(np.float32)
    m[5] = m[6]
    m[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(8, m[9].tolist()), (None, m[3].tolist())] + [(1000 + i, v) for i, v in ODD if v is None or len(v) != 6]
    rows += [(1100, [1.0, 2.0, None, 0.0, 0.0, 0.0]), (1101, [float("nan")] * 6), (1102, [float("-inf")] + [0.0] * 5)]
    table = vectors(frame, rows)
    got = whitening.learn(table, "embedding").transform(table, "vec_id", "embedding").toPandas()
    kept = [(i, v) for i, v in rows if v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]
    n, deviation, white, explained = whitened_by_hand(np.floor(np.array([v for _, v in kept]) * 256).astype(int))
    assert len(got) == 4 * len(kept) and set(got["n"]) == {n} and got["identity_error"].max() <= 1e-9
    for k in range(4):
        own = got[got.component == k + 1]
        assert np.allclose(own.explained, explained[k], rtol=1e-12)
        theirs = sorted(zip(deviation.tolist(), (abs(white[:, k])).round(7).tolist(), strict=True))
        assert np.allclose(sorted(zip(own.deviation, own.whitened.abs().round(7), strict=True)), theirs, atol=1e-6)
    one = got[got.vec_id == 5].sort_values("component").whitened.to_numpy()
    assert np.allclose(one, got[got.vec_id == 6].sort_values("component").whitened.to_numpy())


def test_whitening_odd_tables(frame):
    for rows in ([], ODD[:2], [(1, [1.0, 2.0, 3.0])], [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])]):
        table = vectors(frame, rows)
        assert whitening.learn(table, "embedding").transform(table, "vec_id", "embedding").count() == 0
    line = vectors(frame, [(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [2.0, 2.0, 0.0])])
    got = whitening.learn(line, "embedding").transform(line, "vec_id", "embedding").toPandas()
    assert set(got.component) == {1} and np.allclose(got.explained, 1)
    with pytest.raises(ValueError, match="too large"):
        whitening.learn(frame([(1, [1e30])], "vec_id long, embedding array<double>"), "embedding")


def test_whitening_of_the_table(spark, sf):
    rows = queries.table(spark, sf, "embeddings").toPandas()
    x = np.floor(np.array(rows.embedding.tolist(), float) * 256).astype(int)
    n, deviation, white, explained = whitened_by_hand(x)
    got = queries.op13_bit_whitening(spark, sf).toPandas().sort_values(["vec_id", "component"])
    mine = got.whitened.to_numpy().reshape(-1, 4)
    white = white[np.argsort(rows.vec_id.to_numpy())]
    assert np.allclose(mine, white * np.sign((mine * white).sum(axis=0)), atol=1e-9)
    assert (got.deviation.to_numpy()[::4] == deviation[np.argsort(rows.vec_id.to_numpy())]).all()
    assert np.allclose(got.explained.to_numpy()[:4], explained) and got.identity_error.nunique() == 1 and set(got.n) == {n}
