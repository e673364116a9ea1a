"""Operator 1: URL filter by rules and link-graph propagation.

A page's rule decides where one fits. Other pages get their host's verdict: trust spreads from
hosts with allowed pages along links between hosts (personalised PageRank), distrust from hosts
with blocked pages against the links' direction. A seed's weight is the share of its pages that
rules allow or block. A host is blocked if its distrust reaches ``threshold`` times what a wholly
blocked host has by itself and exceeds its trust.

Links are summed per pair of hosts before anything else, so a host with a third of all pages is one
row from there on; links within a host (relative ones too) say nothing about others and are left out.
All of it is DataFrame expressions; every round of propagation is written to a shared table.

A host without links onward passes nothing on. Rounds go on until what they still can change in all
hosts together, damping / (1 - damping) times the last round's change, is at most TOLERANCE of the
seeds' weight; a round shrinks it by the factor ``damping`` at least, so 86 rounds always do. Nothing
is rounded, and where there are no links between hosts ranks are the seeds.

Defined results: a url that is null or has no "://" has empty host and path; no rule fits an empty
host, whose verdict is allow; rows with equal page_id are judged one by one; null html has no
links; very long pages are searched whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, release

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def _fits(rule: str) -> Column:
    host, _, path = rule.partition("/")
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)


def _first(rules: list[tuple[str, str]], which: int) -> Column:
    """Of the longest rule that fits; null if none does."""
    order = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    return reduce(lambda out, r: F.when(_fits(r[0]), F.lit(r[which])).otherwise(out), reversed(order), F.lit(None).cast("string"))


def spread(hosts: DataFrame, links: DataFrame, seed: str, source: str, target: str, damping: float, tolerance: float) -> DataFrame:
    """host, rank: the solution of rank = (1 - damping) * seed + damping * what comes over the links."""
    shares = materialise(links.join(links.groupBy(source).agg(F.sum("n").alias("all")), source).select(F.col(source).alias("from"), F.col(target).alias("to"), (F.col("n") / F.col("all")).alias("share")), "link-shares")
    base = hosts.select("host", (F.lit(1 - damping) * F.col(seed)).alias("base"))
    weight = base.agg(F.coalesce(F.sum("base"), F.lit(0.0))).first()[0]
    rank = materialise(base.where("base > 0").select("host", F.col("base").alias("rank"), F.col("base").alias("change")), "ranks")
    left = weight
    while left * damping / (1 - damping) > tolerance * weight:
        # what came in the last round goes on: rank is the sum of all changes
        come = rank.where("change > 0").join(shares, F.col("host") == F.col("from")).groupBy("to").agg((damping * F.sum(F.col("change") * F.col("share"))).alias("come"))
        both = rank.join(come, F.col("host") == F.col("to"), "full")
        more = F.coalesce("come", F.lit(0.0))
        last, rank = rank, materialise(both.select(F.coalesce("host", "to").alias("host"), (F.coalesce("rank", F.lit(0.0)) + more).alias("rank"), more.alias("change")), "ranks")
        release(last)
        left = rank.agg(F.coalesce(F.sum("change"), F.lit(0.0))).first()[0]
    return rank.select("host", "rank")


def host_verdicts(judged: DataFrame, links: DataFrame, damping: float = DAMPING, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust, verdict of every host with pages or links."""
    seen = judged.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("action") == "allow").alias("allowed"), F.count_if(F.col("action") == "block").alias("blocked"))
    linked = links.select(F.col("src").alias("host")).union(links.select(F.col("dst").alias("host"))).distinct()
    hosts = materialise(seen.join(linked, "host", "full").select("host", F.coalesce(F.col("allowed") / F.col("pages"), F.lit(0.0)).alias("trusted"), F.coalesce(F.col("blocked") / F.col("pages"), F.lit(0.0)).alias("barred")), "hosts")
    if links.isEmpty():  # ranks are the seeds
        rank = [hosts.select("host", (F.lit(1 - damping) * F.col(c)).alias("rank")) for c in ("trusted", "barred")]
    else:
        rank = [spread(hosts, links, "trusted", "src", "dst", damping, tolerance), spread(hosts, links, "barred", "dst", "src", damping, tolerance)]
    both = hosts.select("host").join(rank[0].withColumnRenamed("rank", "trust"), "host", "left").join(rank[1].withColumnRenamed("rank", "distrust"), "host", "left").na.fill(0.0)
    bad = (F.col("distrust") >= threshold * (1 - damping)) & (F.col("distrust") > F.col("trust")) & (F.col("host") != "")
    return both.withColumn("verdict", F.when(bad, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, **settings) -> DataFrame:
    """page_id, host, path, rule, verdict, host_trust, host_distrust of every page."""
    host, path = host_and_path(F.col("url"))
    parted = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("html"))
    links = parted.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), F.lit(1))).alias("to"))
    links = links.select("src", host_and_path(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to")))[0].alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    links = materialise(links.groupBy("src", "dst").agg(F.count("*").alias("n")), "host-links")
    judged = materialise(parted.drop("html").withColumns({"rule": _first(rules, 0), "action": _first(rules, 1)}), "judged-pages")
    verdicts = host_verdicts(judged, links, **settings).withColumnsRenamed({"verdict": "host_verdict", "trust": "host_trust", "distrust": "host_distrust"})
    out = judged.join(verdicts, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "host_verdict", F.lit("allow")).alias("verdict"), "host_trust", "host_distrust")
