"""URL verdicts by rules, and by trust and distrust that spread over links between hosts (operator 9).

A rule names a host with a path; it fits the host and its subdomains where the path starts with the rule's, and the
longest rule that fits decides. Pages that no rule decides get the verdict of their host. Links between hosts are
counted into weighted edges. Hosts with pages that rules allow are trusted seeds, those with pages that rules block
are blocked seeds, each weighted by the share of its pages. Personalised PageRank spreads trust from the trusted
seeds along the links, and distrust from the blocked seeds against them; a host all of whose pages are allowed, or
blocked, starts with 1 - damping. A host is blocked where distrust exceeds trust by `threshold`.

Pages are aggregated to hosts before anything is joined, ranks are kept only for hosts that some mass has reached,
and each round is one join and one aggregation keyed by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treequarry.llm.common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
DAMPING, ROUNDS, THRESHOLD = 0.85, 20, 0.05
#: A table of hosts of at most so many rows, of one host, one number and few rules each, is broadcast.
BROADCAST_ROWS = 50_000


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts; weight counts the links."""
    linking = pages.filter(F.contains("html", F.lit("//"))).select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    return linking.withColumn("dst", lowered(F.col("dst"))).filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank from seeds (host, weight) over edges (src, dst, weight): (host, score).

    score = (1 - damping) * weight at each seed + damping * what comes in; a host without links out passes nothing on.
    """
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = checkpointed(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total") * damping).alias("share")))
    start = checkpointed(seeds.select("host", (F.col("weight") * (1 - damping)).alias("score")))
    ranks = start
    if share.isEmpty() or start.isEmpty():
        return ranks
    for number in range(1, rounds + 1):
        sent = ranks.join(share, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("score"))
        ranks = start.unionByName(sent).groupBy("host").agg(F.sum("score").alias("score"))
        if number % 4 == 0 or number == rounds:
            ranks = checkpointed(ranks)
    return ranks


def verdicts(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict.

    A null url, or one without ://, has an empty host and path, which no rule fits; its verdict is allow, as is that
    of every host that no distrust reaches. Of rules of equal length on one page the greater by host and path wins.
    A null html has no links. Repeated rows each get their row; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    edges = checkpointed(link_edges(pages))
    hosts = checkpointed(parts.groupBy("host").agg(F.count("*").alias("n")).select("host"))
    table = spark.createDataFrame([(h, p, v) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string")
    fitting = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("rule_host")).join(table, "rule_host")
    rule = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.col("rule_host").alias("host"), F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict"))
    listed = checkpointed(hosts.join(fitting.groupBy("host").agg(F.collect_set(rule).alias("rules")), "host", "left"))
    ruled = meet(parts, listed)
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    decided = ruled.select("page_id", "host", "path", best.alias("best"))
    share = lambda verdict: F.avg(F.when(F.col("best.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = checkpointed(decided.groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")).filter("host <> ''"))
    trust = spread(edges, seeds.filter("allow > 0").select("host", F.col("allow").alias("weight")), rounds=rounds)
    distrust = spread(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), seeds.filter("block > 0").select("host", F.col("block").alias("weight")), rounds=rounds)
    scores = trust.select("host", (-F.col("score")).alias("score")).unionByName(distrust).groupBy("host").agg(F.sum("score").alias("score"))
    bad = checkpointed(scores.filter(F.col("score") > threshold).select("host", F.lit("block").alias("host_verdict")))
    out = meet(decided, bad)
    return out.select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", "host_verdict", F.lit("allow")).alias("verdict"))


def meet(left: DataFrame, hosts: DataFrame) -> DataFrame:
    """A left join on host; the table of hosts is broadcast if it is small, and else Spark may split hot hosts."""
    return left.join(F.broadcast(hosts) if hosts.count() <= BROADCAST_ROWS else hosts, "host", "left")
