"""Empirical-Bayes reputation of hosts, and URL rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.sources.workspace import staged

#: A host is blocked if the lower bound of its share of bad pages is above this.
BLOCK_ABOVE = 0.5
#: Posterior standard deviations below the mean that make the bound (one-sided 95 %).
BOUND = 1.645
#: Second-level labels that belong to the suffix below a two-letter country code.
COUNTRY_SECOND = ["ac", "co", "com", "edu", "gov", "net", "org"]

Rule = tuple[str, str, str]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL as text; both empty if it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def suffix(host: Column) -> Column:
    """The last label, or the last two where a country's second level is one of the fixed ones."""
    last, second = F.substring_index(host, ".", -1), F.substring_index(F.substring_index(host, ".", -2), ".", 1)
    deep = (F.length(last) == 2) & second.isin(COUNTRY_SECOND) & F.contains(host, F.lit("."))
    return F.when(deep, F.substring_index(host, ".", -2)).otherwise(last)


def registered(host: Column) -> Column:
    """The suffix with one more label."""
    last = suffix(host)
    deep = F.contains(last, F.lit("."))
    return F.when(deep, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def reputations(hosts: DataFrame) -> DataFrame:
    """(host, n, bad) with one row a host, plus posterior mean and lower bound of each host's share of bad pages.

    Shares are shrunk from the whole to the suffix, the registered domain and the
    host. At each level the prior is a beta distribution around the parent's shrunk
    share; its strength comes from how much the children differ beyond chance
    (method of moments over all of them). A level without labelled pages takes its
    parent's share; without any label the share is 1/2. Sums move between levels,
    never pages: each level is an aggregate of the one below.
    """
    leaf = hosts.select("host", registered(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "bad")
    domains = leaf.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).scalar()
    level = _shrunk(suffixes.withColumn("m", whole))
    level = _shrunk(domains.join(level.select("suffix", F.col("share").alias("m")), "suffix"))
    level = _shrunk(leaf.join(level.select("domain", F.col("share").alias("m")), "domain"))
    deviation = F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("strength") + F.col("n") + 1))
    return level.select("host", "n", "bad", "share", (F.col("share") - BOUND * deviation).alias("bound"))


def _shrunk(level: DataFrame) -> DataFrame:
    """Adds `strength` and `share` to rows with n, bad and the parent's share m."""
    spread = F.pow(F.col("bad") / F.col("n") - F.col("m"), 2) * F.col("n") / (F.col("m") * (1 - F.col("m")))
    counted = F.col("n") > 0
    extra = (F.sum(F.when(counted, spread)) - F.count(F.when(counted, 1))) / F.sum(F.when(F.col("n") > 1, F.col("n") - 1))
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.9), F.coalesce(extra, F.lit(0.1))))
    joined = level.withColumn("strength", level.agg(1 / rho - 1).scalar())
    return joined.withColumn("share", (F.col("bad") + F.col("strength") * F.col("m")) / (F.col("n") + F.col("strength")))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule]) -> DataFrame:
    """Verdict of each page (page_id, url): the longest fitting rule's, else the host's by its reputation.

    `outcomes` (page_id, bad 0/1) may label any pages; repeated rows of a page count
    as one, bad if any says so. `rules` are (allow or block, host, path); a rule fits
    its host and all subdomains if the path starts with its path. Of fitting rules the
    one with the longest text wins, then block. A null url has no host; pages with an
    empty host are judged together. Repeated pages are all returned.

    Hosts are counted before they meet anything else, so a host with a third of all
    pages is one row; pages meet their host's row in one sort-merge join, whose large
    partitions Spark splits.
    """
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    marked = cut.select("page_id", "host").join(known, "page_id", "left")
    # Every level reads the hosts; written once, they are also a side of their own in the last join.
    hosts = staged(marked.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "hosts")
    judged = reputations(hosts).select("host", F.when(F.col("bound") > BLOCK_ABOVE, "block").otherwise("allow").alias("own"))
    table = staged(_fitting(hosts.select("host"), rules).join(judged, "host"), "verdicts")
    chosen = F.expr("filter(rules, r -> startswith(path, r.path))")
    best = F.array_max(F.transform(chosen, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["action"].alias("action"), r["rule"].alias("rule"))))
    out = cut.join(table, "host").withColumn("best", best)
    return out.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", "own").alias("verdict")
    )


def _fitting(hosts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each host with the rules of its own name and of all names above it."""
    listed = hosts.sparkSession.createDataFrame(
        [(h, a, p, h + p) for a, h, p in rules], "above string, action string, path string, rule string"
    )
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    met = hosts.select("host", F.explode(above).alias("above")).join(listed, "above")
    found = met.groupBy("host").agg(F.collect_set(F.struct("action", "path", "rule")).alias("rules"))
    empty = F.array().cast("array<struct<action:string,path:string,rule:string>>")
    return hosts.join(found, "host", "left").withColumn("rules", F.coalesce("rules", empty))
