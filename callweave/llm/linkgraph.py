"""URL filter: rules for hosts with their subdomains and paths, then trust and distrust over the host graph.

A rule fits the urls of its host and subdomains whose path starts with the rule's; the longest that fits decides.
Urls without a rule get their host's verdict from two personalised PageRanks over the host edges found in the
pages: trust flows from hosts whose urls are mostly allowed along links, distrust from hosts whose urls are mostly blocked against them
(who links to a blocked host shares its distrust). A host is blocked where distrust exceeds `ratio` times trust
and `least` times the mean seed of a blocked host, so the bound does not fall with the number of seeds; a host that
no mass reaches is allowed.

Edges are aggregated to one row per pair of hosts before any iteration; the rank tables hold one row per host,
are joined by key and cut every few rounds. Both walks run together, until less than TOLERANCE of each one's mass
is still to be carried on.

Edge cases: null urls and urls without :// have empty host and path, fit no rule and are allowed; null html has
no links; repeated rows count once per pair of hosts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = ""


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
ROUNDS, DAMPING, RATIO, LEAST = 8, 0.85, 1.0, 1e-6
#: Mass of a walk that may be left when it ends, and rounds between two cuts. The damping bounds the rounds: 88 of them.
TOLERANCE, STEPS = 1e-6, 4
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(https?://[^"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """(name, verdict) of the longest fitting rule, else null."""
    chain = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for r in sorted(rules, key=lambda r: -len(r.host + r.path)):
        chain = chain.when(fits(r, host, path), F.struct(F.lit(f"{r.host}{r.path or '/'}").alias("rule"), F.lit(r.verdict).alias("verdict")))
    return chain


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n) between different hosts, from links with an absolute address."""
    links = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), 1), host_of))).alias("dst"))
    return links.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, mass): the mass of seeds (host, seed; summing to 1) carried over edges (src, dst, n); sinks drop theirs."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = cut(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    rank = seeds.select("host", F.col("seed").alias("mass"))
    if shares.isEmpty():
        return rank
    for _ in range(rounds):
        moved = rank.join(shares, rank["host"] == shares["src"]).select(F.col("dst").alias("host"), (F.lit(damping) * F.col("mass") * F.col("share")).alias("mass"))
        fresh = seeds.select("host", (F.lit(1 - damping) * F.col("seed")).alias("mass"))
        rank = cut(moved.unionByName(fresh).groupBy("host").agg(F.sum("mass").alias("mass")))
    return rank


def settled_ranks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(walk, host, mass): as personalised_rank without end, for each walk of edges (walk, src, dst, n) and seeds (walk, host, seed).

    A row holds the mass that has come to stay at its host and the rest that moves on, so what is not carried yet is
    known; the walks end when it is below the tolerance.
    """
    out = edges.groupBy("walk", "src").agg(F.sum("n").alias("total"))
    shares = cut(edges.join(out, ["walk", "src"]).select("walk", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("share")))
    state = seeds.select("walk", "host", F.lit(0.0).alias("mass"), F.col("seed").alias("rest"))
    left = 1.0
    while left >= tolerance:
        for _ in range(STEPS):
            moved = state.join(shares, ["walk", "host"]).select("walk", F.col("dst").alias("host"), F.lit(0.0).alias("mass"), (F.lit(damping) * F.col("rest") * F.col("share")).alias("rest"))
            stays = state.select("walk", "host", (F.col("mass") + F.lit(1 - damping) * F.col("rest")).alias("mass"), F.lit(0.0).alias("rest"))
            state = moved.unionByName(stays).groupBy("walk", "host").agg(F.sum("mass").alias("mass"), F.sum("rest").alias("rest"))
        state = cut(state)
        left = max((r.rest or 0.0 for r in state.groupBy("walk").agg(F.sum("rest").alias("rest")).collect()), default=0.0)  # a row a walk
    return state.select("walk", "host", "mass")


def _seeds(urls: DataFrame, verdict: str) -> tuple[DataFrame, int]:
    """Hosts most of whose urls the rules give the verdict, in proportion to those urls, and how many; a ruled path does not taint a whole host."""
    hosts = cut(urls.where("host <> ''").groupBy("host").agg(F.count("*").alias("urls"), F.count_if(F.col("hit.verdict") == verdict).alias("n")).where("2 * n > urls"))
    total, count = hosts.agg(F.sum("n"), F.count("*")).first()  # two numbers
    return hosts.select(F.lit(verdict).alias("walk"), "host", (F.col("n") / F.lit(total or 1)).alias("seed")), count


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", html: str = "html", key: str = "page_id", ratio: float = RATIO, least: float = LEAST) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust)."""
    urls = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = urls.withColumn("hit", longest_rule(rules, F.col("host"), F.col("path")))
    edges = cut(host_edges(pages, url, html))
    (good, _), (evil, count) = _seeds(urls, "allow"), _seeds(urls, "block")
    forth = edges.select(F.lit("allow").alias("walk"), "src", "dst", "n")
    back = edges.select(F.lit("block").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    mass = settled_ranks(forth.unionByName(back), good.unionByName(evil))
    of = lambda walk: F.sum(F.when(F.col("walk") == walk, F.col("mass")).otherwise(0.0))
    hosts = stored(mass.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust")), "hosts")
    joined = urls.join(hosts, "host", "left")
    bad = (F.coalesce(F.col("distrust"), F.lit(0.0)) > ratio * F.coalesce(F.col("trust"), F.lit(0.0))) & (F.col("distrust") * F.lit(count) > least)
    method = F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow")
    return joined.select(key, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), method).alias("verdict"), "trust", "distrust")
