"""URL filtering: prefix rules first, then trust and distrust propagated over the host graph.

Pages that a rule allows seed trust, which flows along links (a trusted host's links are trusted); pages that a rule
blocks seed distrust, which flows against links (who links to a blocked host is suspect). Both are personalised
PageRanks with the same damping, iterated until they stand still. A host is blocked when distrust makes up at least half of what reached it.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm.common import Scratch

#: (host, path, verdict) as the rules are given.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING = 0.85
#: Rounds go on until no round reaches a new host and the scores of a flow change by no more than this in all ...
TOLERANCE = 1e-6
#: ... which is looked at after this many rounds, and then after each.
STEPS = 10
BLOCK_SHARE = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?(//[^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host the rules of it and of the domains it lies in, the longest rule first.

    A host is asked for as many of its last labels as the longest rule has, so long hosts cost no more than their length.
    """
    most = rules.agg(F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(1))).first()[0]
    suffixes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i)))
    near = hosts.select("host", F.explode(suffixes).alias("rule_host")).join(F.broadcast(rules), "rule_host")  # the rules came from the driver
    rule = F.concat("rule_host", "rule_path")
    made = F.struct((-F.length(rule)).alias("short"), rule.alias("rule"), F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict"))
    return near.groupBy("host").agg(F.sort_array(F.collect_list(made)).alias("rules"))


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) between different hosts; n: links."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("url"))
    return links.select("src", host_of(F.concat(F.lit(":"), "url")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(scratch: Scratch, edges: DataFrame, seeds: DataFrame, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(flow, host, score): personalised PageRank for flow 't' along edges from trusted and 'd' against edges from blocked hosts.

    seeds: (flow, host, seed) with seeds of a flow summing to 1. Scores are written out each step, and steps go on,
    after the first `steps`, until no host is new and no flow's scores change by more than tolerance; contributions of a host with very many links are summed on the map side, and Spark splits its side of the join.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all")).withColumnRenamed("src", "x")
    into = edges.groupBy("dst").agg(F.sum("n").alias("all")).withColumnRenamed("dst", "x")
    along = edges.join(out, F.col("src") == F.col("x")).select(F.lit("t").alias("flow"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("part"))
    against = edges.join(into, F.col("dst") == F.col("x")).select(F.lit("d").alias("flow"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("all")).alias("part"))
    moves = scratch.keep(along.union(against), "moves")
    base = seeds.select("flow", "host", (F.lit(1 - DAMPING) * F.col("seed")).alias("score"))
    if moves.isEmpty():
        return base
    score = seeds.select("flow", "host", F.col("seed").alias("score"))
    for i in itertools.count():
        moved = score.join(moves, ["flow", "host"]).select("flow", F.col("to").alias("host"), (F.lit(DAMPING) * F.col("score") * F.col("part")).alias("score"))
        last, score = score, scratch.keep(moved.union(base).groupBy("flow", "host").agg(F.sum("score").alias("score")), f"score-{i}")
        if i + 1 >= steps:
            both = score.join(last.withColumnRenamed("score", "last"), ["flow", "host"], "full")
            change = F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("last", F.lit(0.0))))
            still = both.groupBy("flow").agg((F.max(F.col("last").isNull()) | (change > tolerance)).alias("moving")).where("moving").isEmpty()
            if still:
                return score
        if i:
            scratch.drop(f"score-{i - 1}")


def filter_urls(spark: SparkSession, pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row per row of pages.

    A url that is null or has no '://' has an empty host and path, fits no rule and is allowed, as is a host that
    neither trust nor distrust reached. Repeated rows are rows like others; null html has no links. Other columns are
    ignored.
    """
    scratch = Scratch(spark)
    # one pass over html leaves urls and the hosts linked to, counted per row
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    edges = scratch.keep(link_edges(parsed), "edges")
    parsed = parsed.drop("html")
    hosts = scratch.keep(parsed.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    fitting = scratch.keep(rules_by_host(hosts.where("host <> ''"), rules_table(spark, rules)), "rules")
    ruled = parsed.join(fitting, "host", "left")
    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r.path)), F.lit(0))
    ruled = scratch.keep(ruled.select("page_id", "host", "path", first["rule"].alias("rule"), first["verdict"].alias("by_rule")), "ruled")
    of_host = ruled.where("by_rule is not null").groupBy("by_rule", "host").agg(F.count(F.lit(1)).alias("n"))
    seeds = of_host.select(F.when(F.col("by_rule") == "allow", "t").otherwise("d").alias("flow"), "host", "n")
    whole = seeds.groupBy("flow").agg(F.sum("n").alias("all"))
    seeds = scratch.keep(seeds.join(whole, "flow").select("flow", "host", (F.col("n") / F.col("all")).alias("seed")), "seeds")
    flows = propagate(scratch, edges, seeds)
    part = lambda f: F.coalesce(F.sum(F.when(F.col("flow") == f, F.col("score"))), F.lit(0.0))
    scores = flows.groupBy("host").agg(part("t").alias("trust"), part("d").alias("distrust"))
    scores = scratch.keep(hosts.join(scores, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "scores")
    reached = F.col("trust") + F.col("distrust")
    by_host = F.when((reached > 0) & (F.col("distrust") >= F.lit(BLOCK_SHARE) * reached), "block").otherwise("allow")
    return ruled.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "trust", "distrust")
