"""How the sources of a language differ in their terms: a three-dimensional cube of (group block, group block, term block) cells."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.sources.workspace import staged

#: A term counts if so many documents of its language hold it.
LEAST_DOCUMENTS = 3
#: Shares are whole billionths.
SCALE_DIGITS = 3  # groups of three digits
#: Ranks of the terms that stand out.
MOST_RANKS = 200
#: Groups of a group block and terms of a term block, about: what one cell holds.
GROUPS, TERMS = 32, 1024
#: Bytes of counts that a task holds before it hands them on.
HELD = 1 << 25
#: Groups that may be sent to all executors.
BROADCAST_GROUPS = 50_000

_WORD = re.compile(rb"[a-z\x80-\xff]+")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of bounded runs of rows; a null term says that the group occurs."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                one = held.setdefault((lang, source), {})
                # Lower-casing bytes changes A-Z only, and no byte from 0x80 cuts a character.
                for term, n in Counter(_WORD.findall(text.lower())).items():
                    if (got := one.get(term)) is None:
                        one[term] = [n, 1]
                        size += 200 + len(term)
                    else:
                        got[0] += n
                        got[1] += 1
            if size > HELD:
                yield from _rows(held)
                held, size = {}, 0
    yield from _rows(held)


def _rows(held: dict[tuple[str, str], dict[bytes, list[int]]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), one in held.items():
        k = len(one) + 1
        n, docs = ([0, *(x[i] for x in one.values())] for i in (0, 1))
        terms = pa.array([None, *(t.decode() for t in one)], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([source] * k), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / total), by long division in groups of three digits: exact for totals below 9 * 10^15."""
    total = F.greatest(total, F.lit(1))
    out, rest = F.lit(0).cast("long"), (count + 1).cast("long")
    for _ in range(SCALE_DIGITS):
        rest = rest * 1000
        out, rest = out * 1000 + _div(rest, total), rest % total
    return out + 1


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of all ordered pairs of groups of one cell, over the terms that any of its groups has."""
    is_head = rows["term"].isna().to_numpy()
    head = rows[is_head].sort_values("source", ignore_index=True)
    body = rows[~is_head]
    code, terms = pd.factorize(body["term"])
    base = head["p"].to_numpy(np.int64)
    grid = np.repeat(base[:, None], len(terms), axis=1)
    grid[pd.Index(head["source"]).get_indexer(body["source"]), code] = body["p"].to_numpy(np.int64)
    block, names = head["block"].to_numpy(), head["source"].to_numpy(object)
    i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    sides = [(np.flatnonzero(block == i), np.flatnonzero(block == j))]
    if i != j:
        sides.append(sides[0][::-1])
    found = []
    for own, others in sides:
        for g in own:
            h = others[others != g]
            d = grid[g] - grid[h]
            value = (d * d // grid[h]).sum(axis=1)
            away = base[g] - base[h]
            found.append(pd.DataFrame({"source": [names[g]] * len(h), "item": names[h], "value": value, "unseen": away * away // base[h]}))
    columns = ["lang", "source", "item", "value", "unseen", "terms", "seen"]
    if not any(len(x) for x in found):
        return pd.DataFrame({c: np.zeros(0, object) for c in columns})
    return pd.concat(found, ignore_index=True).assign(lang=rows["lang"].iloc[0], terms=head["terms"].iloc[0], seen=len(terms))[columns]


def audit(docs: DataFrame, text: str, lang: str, source: str, least_documents: int = LEAST_DOCUMENTS, most_ranks: int = MOST_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each group (lang, source) is from each other source of its language, and by which terms.

    Null texts, languages and sources count as empty. Terms are runs of ASCII letters
    and characters beyond ASCII, A-Z lower-cased; a language keeps those in at least
    `least_documents` of its rows. Every row is a document of its own, repeated ids and
    texts included; other columns are not read. p = 1 + floor(10^9 (count + 1) /
    (all kept counts + kept terms)), and a term adds floor((p - q)^2 / q), all in whole
    numbers. Part `pair`: q is the other source's p, summed over all kept terms. Part
    `term`: q is the language's p; terms of the group with p > q, to `most_ranks`.
    A group without terms takes part; a language without kept terms has values of 0; a
    single source has no pairs. No documents give no rows. A value or a sum beyond
    64 bits (over 10^9 kept terms) is an error.

    Documents become counts by (lang, source, term) with a combine in each task. The
    cube: groups are dealt into blocks of about `GROUPS`, terms into blocks of about
    `TERMS`; each slice (group block, term block) is copied to the cells that pair it
    with the language's other group blocks; a cell sums over its terms, and sums meet
    along the term axis. Terms that no group of a cell has add the same for each, so they are
    only counted. No task holds more than two slices; a source with a third of all
    rows is one row a term like any other.
    """
    empty = F.lit("")
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), empty).alias("lang"),
        F.coalesce(F.col(source).cast("string"), empty).alias("source"),
        F.coalesce(F.col(text).cast("binary"), empty.cast("binary")).alias("text"),
    )
    raw = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = staged(raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    held = counts.filter(F.col("term").isNotNull())
    kept = held.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_documents)
    kept = staged(kept.drop("docs"), "kept")
    slices = staged(held.drop("docs").join(kept, ["lang", "term"]), "slices")

    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    sizes = slices.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.filter(F.col("term").isNull()).select("lang", "source")
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / GROUPS).cast("int").alias("blocks"))
    none = F.lit(0).cast("long")
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").join(blocks, "lang")
    groups = groups.withColumns({c: F.coalesce(c, none) for c in ("group_n", "lang_n", "terms")})
    groups = staged(groups.withColumn("cuts", F.greatest(F.ceil(F.col("terms") / TERMS), F.lit(1)).cast("int")), "groups")
    known = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups

    own = share(F.col("n"), F.col("group_n") + F.col("terms"))
    with_p = slices.join(known, ["lang", "source"]).withColumn("p", own)

    q = share(F.col("total"), F.col("lang_n") + F.col("terms"))
    out_terms = with_p.withColumn("q", q).filter("p > q").withColumn("value", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")))
    out_terms = out_terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    out_terms = out_terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_ranks)

    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    heads = groups.withColumns({"n": none, "cut": F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))})
    heads = heads.select("lang", "source", F.lit(None).cast("string").alias("term"), own.alias("p"), "terms", "cut", block, "blocks")
    bodies = with_p.select("lang", "source", "term", "p", "terms", F.pmod(F.xxhash64("term", F.lit(1)), F.col("cuts")).cast("int").alias("cut"), block, "blocks")
    copies = heads.unionByName(bodies).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = copies.select("lang", "source", "term", "p", "terms", "cut", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    partial = cells.groupBy("lang", "i", "j", "cut").applyInPandas(_cell, "lang string, source string, item string, value long, unseen long, terms long, seen long")
    total = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("unseen").alias("unseen"), F.max("terms").alias("terms"))
    pairs = total.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + (F.col("terms") - F.col("seen")) * F.col("unseen")).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(out_terms)
