"""Hand-made cases and brute force for the operators, with nulls, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tablewright.llm import chunks, decontaminate, embeddings, langid, ngram_join, packing, queries, reputation, sharding, toxicity, warc

DOCS = "doc_id long, text string, key string, n long, found int"


def prose(rng: random.Random, n: int, start: str = "") -> str:
    return " ".join(start + "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def rows(texts):
    """With extra columns whose names operators use inside."""
    return [(i, t, "k", 1, 2) for i, t in texts]


@pytest.fixture(scope="module")
def odd(frame):
    """Null, empty, blank, one word, repeats, a long text."""
    rng = random.Random(9)
    same = prose(rng, 80)
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, same), (6, same), (6, same), (7, prose(rng, 60_000)), (8, "Word"), (None, same)]
    return frame(rows(texts), DOCS)


@pytest.fixture(scope="module")
def none(frame):
    return frame([], DOCS)


def test_language(frame, odd, none):
    rng = random.Random(1)
    train = [(i, prose(rng, 60, "ka" if i % 2 else "zo"), "aa" if i % 2 else "bb") for i in range(60)] + [(99, "kax", None)]
    learned = langid.learn(frame(train, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert learned.languages == ["aa", "bb"]
    tests = [(1, prose(rng, 30, "ka")), (2, prose(rng, 30, "zo")), (3, None), (4, "12 !"), (5, prose(rng, 200_000, "ka"))]
    got = {r["doc_id"]: r for r in learned.predict(frame(rows(tests), DOCS), "doc_id", "text").collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["aa", "bb", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert learned.predict(odd, "doc_id", "text").count() == 10
    empty = langid.learn(frame([], "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in empty.predict(odd, "doc_id", "text").collect()} == {"und"}
    assert learned.predict(none, "doc_id", "text").count() == 0


def test_warc_round_trip(frame, spark, tmp_path):
    long = "x" * 99 + "é"
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "b" * 100
    pages = [(1, "http://a/", long), (2, None, long), (3, "u\r\nv", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", tricky), (7, "u", tricky), (8, "u", tricky), (None, "u", long)]
    table = frame(pages, "id long, url string, payload string")
    path = str(tmp_path / "a")
    warc.write_archives(warc.resolve(table), path)
    read = warc.read_archives(spark, path).collect()
    stored = {r["record_id"]: bytes(r["payload"]).decode() for r in read if r["record_type"] == "response"}
    assert stored["<urn:record:1>"] == long and stored["<urn:record:7>"] == tricky
    got = sorted(((r["id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.full_records(warc.read_archives(spark, path)).collect()))
    want = []
    for i, _, payload in pages:
        data = (payload or "").encode()
        first = {long: 1, tricky: 7}.get(payload)
        again = i is not None and first is not None and i > first
        want.append((i or 0, "revisit" if again else "response", first if again else None, len(data), hashlib.sha256(data).hexdigest()))
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2] or 0))
    assert warc.deduplicate(frame([], "id long, url string, payload string")).count() == 0


def test_warc_one_id_with_two_payloads(frame):
    pages = [(1, "u", "a" * 200), (1, "u", "b" * 150), (2, "u", "a" * 200), (3, "u", "b" * 150), (3, "u", "c" * 120)]
    got = warc.deduplicate(frame([(*p, "extra") for p in pages], "id long, url string, payload string, record_type string"))
    got = sorted((r["id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in got.collect())
    digest = {len(p): hashlib.sha256(p.encode()).hexdigest() for _, _, p in pages}
    assert got == [
        (1, 150, "response", None, digest[150]),
        (1, 200, "response", None, digest[200]),
        (2, 200, "revisit", 1, digest[200]),
        (3, 120, "response", None, digest[120]),
        (3, 150, "revisit", 1, digest[150]),
    ]


def test_reputation(frame):
    pages = [(i, f"http://bad.x.com/{i}") for i in range(40)] + [(100 + i, f"http://Good.y.com/{i}?q") for i in range(40)]
    pages += [(200, "http://good.y.com/en/a#b"), (201, None), (202, "nothing"), (203, "x://com/"), (204, "a://b.co.uk"), (204, "a://b.co.uk")]
    outcomes = [(i, 1) for i in range(40)] + [(100 + i, int(i == 0)) for i in range(40)] + [(0, 0)]
    rules = [("block", "com", "/en/"), ("allow", "good.y.com", "/en/a"), ("allow", "bad.x.com", "/7")]
    got = {r["page_id"]: r for r in reputation.judge(frame(pages, "page_id long, url string"), frame(outcomes, "page_id long, bad int"), rules).collect()}
    assert got[1]["verdict"] == "block" and got[101]["verdict"] == "allow" and got[101]["host"] == "good.y.com" and got[101]["path"] == "/1"
    assert (got[7]["rule"], got[7]["verdict"]) == ("bad.x.com/7", "allow")
    assert (got[200]["rule"], got[200]["verdict"]) == ("good.y.com/en/a", "allow")
    assert all((got[i]["host"], got[i]["path"], got[i]["rule"]) == ("", "", None) for i in (201, 202))
    assert reputation.judge(frame([], "page_id long, url string"), frame([], "page_id long, bad int"), rules).count() == 0


def test_chunks(frame, odd, none):
    rng = random.Random(4)
    shared = prose(rng, 70)
    texts = [(1, prose(rng, 50) + " " + shared + " " + prose(rng, 20)), (2, shared + "\n" + prose(rng, 90)), (3, prose(rng, 200)), (4, prose(rng, 33) + " " + shared)]
    docs = frame(rows(texts), DOCS)
    got = {r["doc_id"]: r["text"] for r in chunks.deduplicate(docs, "doc_id", "text").collect()}
    assert got[1] == texts[0][1] and got[3] == texts[2][1]
    for i in (2, 4):
        left = set(got[i].split())
        assert len(left & set(shared.split())) <= 30 and set(dict(texts)[i].split()) - set(shared.split()) <= left
    out = chunks.deduplicate(odd, "doc_id", "text")
    assert out.columns == odd.columns and sorted(r["text"] == "" for r in out.filter("doc_id = 6").collect()) == [True, True]
    assert out.count() == 10 and chunks.deduplicate(none, "doc_id", "text").count() == 0


def test_toxicity(frame, odd, none):
    rng = random.Random(2)
    texts = [(i, prose(rng, 40) + (" vequ" + prose(rng, 1) + " idiot" if i % 5 == 0 else "")) for i in range(600)]
    labels = frame([(i, int(i % 5 == 0)) for i in range(400)] + [(1, None), (2, 0)], "doc_id long, toxic int")
    docs = frame(rows(texts), DOCS)
    model = toxicity.learn(docs.filter("doc_id < 400"), labels, "doc_id", "text")
    got = {r["doc_id"]: r["score"] for r in model.score(docs, "doc_id", "text").collect()}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(400, 600))
    assert model.below(docs, "text", 0.3).columns == docs.columns
    assert model.score(odd, "doc_id", "text").filter("score between 0 and 1").count() == 10
    assert model.score(none, "doc_id", "text").count() == 0
    blank = toxicity.learn(none, labels, "doc_id", "text")
    assert {r["score"] < 0.01 for r in blank.score(odd, "doc_id", "text").collect()} == {True}


def test_label_model_holds_votes_as_bytes():
    import tracemalloc

    rng = np.random.default_rng(0)
    label = (rng.random(4000) < 0.2).astype(int)
    votes = (rng.random((4000, 400)) < np.where(label == 1, 0.05, 0.005)[:, None]).astype(np.uint8)
    tracemalloc.start()
    posterior, fires, _ = toxicity.label_model(votes, label)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * votes.nbytes and len(posterior) == 4000
    assert (fires[0, :400] > fires[1, :400]).all()


def test_packing(odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(odd, "doc_id", "text", path).toPandas()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(got[(got.doc_id == 6) & (got.start == 0)]) == 2
    for i in (1, 2, 3, 4, 5, 7, 8):
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert b"".join(own.ids) == ids.tobytes() and set(own.doc_tokens) == {len(ids)}
        assert all(zlib.crc32(b) == c for b, c in zip(own.ids, own.ids_crc32, strict=True))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= packing.CAPACITY
    assert packing.pack(none, "doc_id", "text", path).count() == 0


def test_packing_shuffles_ids_once_and_compressed(frame, monkeypatch):
    """Pieces are joined by their number, so their ids take no part in a grouping; at rest they are small."""
    written = []
    monkeypatch.setattr(packing, "scratch_path", lambda spark, name, own=packing.scratch_path: written.append(own(spark, name)) or written[-1])
    docs = frame(rows([(i % 40, "many common words of one text " * 400) for i in range(80)]), DOCS)
    got = packing.pack(docs, "doc_id", "text", queries.tokenizer_path())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "first(ids" not in plan and "eqNullSafe" not in plan and "<=>" not in plan
    got = got.toPandas()
    assert all(len(b) == 4 * n and zlib.crc32(b) == c for b, n, c in zip(got.ids, got.length, got.ids_crc32, strict=True))
    assert got.groupby("doc_id").length.sum().tolist() == (2 * got.groupby("doc_id").doc_tokens.first()).tolist()
    kept = docs.sparkSession.read.parquet(written[0]).selectExpr("sum(length(ids)) / sum(4 * length)").first()[0]
    assert kept < 0.5


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    words, tokenizer = packing.WordIds(path), Tokenizer.from_file(path)
    rng = random.Random(7)
    kinds = ["".join(map(chr, range(32, 127))), "".join(map(chr, range(0xA0, 0x250))), "\t\n\r\x0b\x0c \xa0'sdlmtrv", "".join(map(chr, range(0x250, 0x3000)))]
    for k in range(600):
        t = "".join(rng.choice(rng.choice(kinds[: 3 + (k % 3 == 0)])) for _ in range(40))
        assert words(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)
    for t in ("abc <|endoftext|> def", "<|startoftext|>x<|endoftext|>", "<|EndOfText|> <|endoftext", "<| endoftext |>"):
        assert words(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    assert 49407 in np.frombuffer(words("abc <|endoftext|> def"), "<u4")


def brute_components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(frame, n, percent):
    rng = random.Random(n)
    texts = []
    for _ in range(12):
        base = [prose(rng, 1) for _ in range(rng.choice([2, 5, 40, 90]))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = prose(rng, 1)
            texts.append(" ".join(own))
    common = prose(rng, 30)
    texts += [prose(rng, 60) + " " + common for _ in range(20)] + [None, "", "  "]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = brute_components(len(texts), links)
    got = {r["doc_id"]: r for r in ngram_join.linked(frame(rows(enumerate(texts)), DOCS), "doc_id", "text", n, percent).collect()}
    assert [got[i]["component"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


def test_ngram_join_odd_rows(odd, none):
    got = ngram_join.linked(odd, "doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["component"] or 0) for r in got) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (6, 5), (7, 7), (8, 4)]
    kept = ngram_join.first_of_each(odd, "doc_id", "text")
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert ngram_join.linked(none, "doc_id", "text").count() == 0


def test_sharding(frame, none):
    rng = random.Random(6)
    texts = [(i, rng.choice(["same", prose(rng, rng.randint(1, 300))])) for i in range(3000)] + [(5000, None), (5001, None)]
    table = frame(rows(texts), DOCS).withColumn("bytes", F.octet_length(F.coalesce("text", F.lit(""))) + 16)
    got = sharding.shard(table, "doc_id", "text", "bytes", 7).toPandas()
    owner = {}
    for i, s in zip(got.key, got.shard, strict=True):
        assert owner.setdefault(dict(texts)[i], s) == s
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 7 and (load.max() - load.min()) / load.mean() < 0.01
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))
    assert sharding.shard(none.withColumn("bytes", F.lit(1)), "doc_id", "text", "bytes", 7).count() == 0


def test_decontamination(frame, odd, none, monkeypatch):
    rng = random.Random(8)
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [(i, prose(rng, rng.choice([4, 10, 30]))) for i in range(15)] + [(20, None), (21, "..."), (22, "b c d")]
    texts = [prose(rng, 30) for _ in range(20)]
    for i in range(20):
        w = items[i % 15][1].split()
        a = rng.randrange(max(1, len(w) - 12))
        texts[i] += ", " + "  ".join(w[a : a + rng.choice([3, 10, 14])]).upper() + ". " + prose(rng, 5) + (" b-c d b c d" if i % 4 == 0 else "")
    texts += [None, "", items[2][1]]
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 900)
    docs, bench = frame(rows(enumerate(texts)), DOCS), frame(items, "item_id long, text string")
    results = []
    for size in (1 << 25, 500):  # in one pass and in several
        monkeypatch.setattr(decontaminate, "PASS_BYTES", size)
        found = decontaminate.report(decontaminate.find(docs, bench, "doc_id", "text", "item_id", "text"))
        results.append({r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in found.collect()})
    want = {}
    for d, t in enumerate(texts):
        w, hit, named = re.findall(pattern, (t or "").lower()), set(), []
        for i, x in items:
            v = re.findall(pattern, (x or "").lower())
            n = min(10, len(v))
            places = [k for k in range(len(w) - n + 1) if n and any(w[k : k + n] == v[j : j + n] for j in range(len(v) - n + 1))]
            hit |= {k + j for k in places for j in range(n)}
            named += [str(i)] * bool(places)
        want[d] = (len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest())
    assert results[0] == want and results[1] == want
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 1 << 25)
    left = {r["doc_id"]: r["text"] for r in decontaminate.removed(docs, bench, "doc_id", "text", "item_id", "text").collect()}
    assert 22 not in left and left[20] is None and left[21] == ""
    for d in range(20):
        assert len(re.findall(pattern, left[d].lower())) == want[d][0] - want[d][1]
    assert decontaminate.removed(odd, bench, "doc_id", "text", "item_id", "text").columns == odd.columns
    assert decontaminate.find(none, bench, "doc_id", "text", "item_id", "text").count() == 0
    assert decontaminate.report(decontaminate.find(docs, frame([], "item_id long, text string"), "doc_id", "text", "item_id", "text")).filter("n_hit > 0").count() == 0


def test_embeddings(frame, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 60)
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    vectors = [(base[i % 60] + rng.normal(size=16) * rng.choice([0.05, 0.15, 0.3])).tolist() for i in range(600)]
    data = [(i, v, i % 2) for i, v in enumerate(vectors)] + [(600 + i, vectors[i], i % 2) for i in range(10)]
    data += [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] * 16, 1), (703, [None] * 16, 1), (704, vectors[0], None), (705, vectors[1][:8], 1), (706, [], 0), (707, [float("inf")] * 16, 1)]
    got = embeddings.near_duplicates(frame([(*d, 1, 2) for d in data], "vec_id long, v array<double>, label int, rep int, cell int"), "vec_id", "v", "label").toPandas().set_index("vec_id")
    good = [d for d in data if d[0] < 700]
    m = np.array([d[1] for d in good])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    label = np.array([d[2] for d in good])
    met = (m @ m.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(good), dtype=bool)
    n = got.n_links.loc[[d[0] for d in good]].to_numpy()
    assert (n <= met.sum(axis=1)).all() and n.sum() >= 0.9 * met.sum() and met.sum() > 1000
    odd = got.loc[700:]
    assert (odd.n_links == 0).all() and (odd.component == odd.index).all() and odd.kept.all()
    assert (got.kept == (got.component == got.index)).all() and (got.component <= got.index).all()
    empty = frame([], "vec_id long, v array<float>, label int")
    assert embeddings.near_duplicates(empty, "vec_id", "v", "label").count() == 0


def test_embeddings_one_id_with_two_vectors(frame):
    near, far = [0.01, 1.0], [1.0, 0.0]
    data = [(1, far, 1), (1, [0.0, 1.0], 1), (3, near, 1), (4, far, 2), (1, near, 2), (1, far, 2), (5, [-1.0, 0.0], 2)]
    got = embeddings.near_duplicates(frame(data, "vec_id long, v array<double>, label int"), "vec_id", "v", "label")
    links = sorted((r["vec_id"], r["n_links"], r["component"], r["kept"]) for r in got.collect())
    assert links == [(1, 0, 1, True), (1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True), (3, 1, 1, False), (4, 1, 1, False), (5, 0, 5, True)]
    names = embeddings.near_duplicates(frame([(f"k{i}", v, str(l)) for i, v, l in data], "vec_id string, v array<double>, label string"), "vec_id", "v", "label")
    assert sorted((r["vec_id"], r["n_links"], r["component"], r["kept"]) for r in names.collect()) == [(f"k{i}", n, f"k{c}", k) for i, n, c, k in links]


def test_embeddings_lose_no_link_among_many_cells(frame, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 20)
    monkeypatch.setattr(embeddings, "BLOCK", 30)
    rng = np.random.default_rng(11)
    base = rng.normal(size=(400, 24))
    # Each second vector lies just inside the threshold, in any direction, from the one before it.
    side = rng.normal(size=base.shape)
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    side -= (side * unit).sum(axis=1, keepdims=True) * unit
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    vectors = np.stack([unit, 0.931 * unit + np.sqrt(1 - 0.931**2) * side], axis=1).reshape(-1, 24)
    got = embeddings.near_duplicates(frame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, v array<double>, label int"), "vec_id", "v", "label")
    got = got.toPandas().set_index("vec_id").loc[range(800)]
    met = (vectors @ vectors.T >= 0.93) & ~np.eye(800, dtype=bool)
    assert got.n_links.tolist() == met.sum(axis=1).tolist() and met.sum() >= 800
    assert got.component.tolist() == brute_components(800, np.argwhere(met).tolist())


def test_chunks_remove_whole_passages(frame):
    rng = random.Random(12)
    shared = [prose(rng, n) for n in (51, 60, 80, 120) for _ in range(25)] + [" ".join(rng.choices("abcdefghij", k=51)) for _ in range(20)]
    texts = [(i, prose(rng, 30) + " " + p + " " + prose(rng, 30)) for i, p in enumerate(shared)]
    around = [(prose(rng, 20) + " ", " " + prose(rng, 40)) for _ in shared]
    texts += [(1000 + i, a + p + b) for i, (p, (a, b)) in enumerate(zip(shared, around, strict=True))]
    short = [(2000 + i, prose(rng, 20) + " " + " ".join(p.split()[:49]) + " " + prose(rng, 20)) for i, p in enumerate(shared)]
    got = {r["doc_id"]: r["text"] for r in chunks.deduplicate(frame(rows(texts + short), DOCS), "doc_id", "text").collect()}
    for i, (a, b) in enumerate(around):
        assert got[1000 + i] == a + b and got[i] == texts[i][1]
    assert [got[i] for i, _ in short] == [t for _, t in short]


def test_chunks_keep_what_no_single_document_holds(frame):
    rng = random.Random(13)
    parts = [prose(rng, 20) for _ in range(3)]
    texts = [(i, prose(rng, 60) + " " + p + " " + prose(rng, 60)) for i, p in enumerate(parts)] + [(9, prose(rng, 9) + " " + " ".join(parts) + " " + prose(rng, 9))]
    # The first 30 words and the last 30 are known from two documents; only the third holds all 51.
    whole = prose(rng, 51).split()
    texts += [(20, prose(rng, 9) + " " + " ".join(whole[:30])), (21, " ".join(whole[21:]) + " " + prose(rng, 9)), (22, " ".join(whole)), (23, "x " + " ".join(whole) + " y")]
    got = {r["doc_id"]: r["text"] for r in chunks.deduplicate(frame(rows(texts), DOCS), "doc_id", "text").collect()}
    assert got == dict(texts) | {23: "x  y"}


def test_chunks_without_spaces(frame):
    rng = random.Random(14)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    thai = lambda n: "".join(chr(rng.randrange(0xE01, 0xE2F)) for _ in range(n))
    token = lambda n: "".join(rng.choice("abcdefghij0123456789") for _ in range(n))
    texts, want = [], {}
    for k, make in enumerate((han, thai, token)):
        shared, a, b = make(150), make(80), make(90)
        texts += [(10 * k, make(70) + shared + make(60)), (10 * k + 1, a + shared + b)]
        want |= {10 * k: texts[-2][1], 10 * k + 1: a + " " + b}
    docs = frame(rows(texts), DOCS)
    spans = chunks.repeated_spans(docs, "doc_id", "text")
    assert {r["doc_id"]: r["text"] for r in chunks.without_spans(docs, "doc_id", "text", spans).collect()} == want
    assert {r["doc_id"]: [s["stop"] - s["start"] for s in r["spans"]] for r in spans.collect()} == {1: [450], 11: [450], 21: [150]}


def test_frequent_pre_tokens_stay_remembered(monkeypatch):
    """Of many pre-tokens, those that come again are encoded once, long ones never remembered."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "REMEMBERED", 16)
    path = queries.tokenizer_path()
    words, tokenizer = packing.WordIds(path), Tokenizer.from_file(path)
    words.clear()
    words.older.clear()
    asked = []

    class Watched:
        def tokenize(self, word):
            asked.append(word)
            return tokenizer.model.tokenize(word)

    words.model = Watched()
    for i in range(60):
        text = f"The épée isn't {'x' * 99} {chr(97 + i % 26)}q{chr(97 + i // 26)}ž"
        assert words(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert asked.count("the") == asked.count("isn") == 1 and asked.count("x" * 99) == 60
    assert len(words) + len(words.older) <= 16


def test_a_tokenizer_that_splits_otherwise_is_refused(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(queries.tokenizer_path())
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    other.save(str(tmp_path / "other.json"))
    with pytest.raises(ValueError, match="splits a text differently"):
        packing.WordIds(str(tmp_path / "other.json"))
