"""URL filters with trust that spreads over the link graph of hosts.

Rules decide what they fit. For the other urls, trust flows from hosts whose pages are allowed along links, and distrust from hosts whose pages are blocked
against them (who links to a blocked host is suspect): two personalised PageRanks over weighted host edges, as joins and
aggregations. A host is blocked where its distrust passes a threshold and its trust.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .words import LOWER, UPPER

#: The rules of the contract, (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

LINK = r"(?i)\bhref\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'>\s]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The rule that fits, the longest first, as struct<rule, verdict>."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _spread(hosts: DataFrame, edges: DataFrame, seed: str, damping: float, rounds: int) -> DataFrame:
    """(host, score) of the hosts that the seeds reach; a host without seed or links in has score 0 and no row."""
    start = hosts.select("host", (F.col(seed) * (1 - damping)).alias("score")).where("score > 0")
    score = start
    for k in range(rounds):
        sent = edges.join(score, edges["src"] == score["host"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("share") * damping).alias("score"))
        score = start.unionAll(sent.select(F.col("dst").alias("host"), "score")).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 3 == 2 or k == rounds - 1:
            score = stage(score, "scores")
    return score


def _shares(edges: DataFrame, src: str, dst: str) -> DataFrame:
    total = edges.groupBy(src).agg(F.sum("n").alias("all"))
    return edges.join(total, src).select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("n") / F.col("all")).alias("share"))


def judge(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str, str]] = RULES,
    damping: float = 0.85, rounds: int = 9, threshold: float = 0.075,
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust): one row a row of ``pages``.

    A seed's weight is the share of the host's pages that rules allow (block), so a host of which few pages are blocked is
    no full source of distrust. A host that is linked to but has no pages is a seed by the share of the links to it that rules allow (block). Edges: links with a host of their own, to another host, weighted by their number. Where no rule fits, the verdict is block
    if the host's distrust is at least ``threshold`` and above its trust, else allow; 0.075 is half of what a wholly blocked host keeps by itself at damping 0.85.
    A null url, or one without ``://``, has empty host and path and is allowed; null html has no links. Repeated rows are
    judged alike, each link counting as often as it stands. Scores are rounded to 9 digits.
    """
    url = F.col(url_col)
    seen = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    seen = seen.withColumn("fit", _rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.count_if(F.col("fit.verdict") == v) / F.count("*")
    hosts = stage(seen.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    out = pages.select(host_of(url).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1)).alias("link"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit(":"), F.col("link"))).otherwise(F.col("link"))
    out = out.select("src", host_of(target).alias("dst"), path_of(target).alias("path")).where("src <> '' and dst <> '' and src <> dst")
    out = out.withColumn("fit", _rule(F.col("dst"), F.col("path"), rules))
    fits = (F.count_if(F.col("fit.verdict") == v).alias(v) for v in ("allow", "block"))
    edges = stage(out.groupBy("src", "dst").agg(F.count("*").alias("n"), *fits), "host-edges")
    if edges.isEmpty():  # then scores are what the seeds keep
        trust, distrust = (hosts.select("host", (F.col(c) * (1 - damping)).alias("score")) for c in ("allowed", "blocked"))
    else:
        linked = edges.groupBy(F.col("dst").alias("host")).agg(*((F.sum(v) / F.sum("n")).alias(c) for v, c in (("allow", "allowed"), ("block", "blocked"))))
        seeds = stage(hosts.unionByName(linked.where("allowed + blocked > 0").join(hosts.select("host"), "host", "left_anti")), "seeds")
        trust = _spread(seeds, stage(_shares(edges, "src", "dst"), "shares"), "allowed", damping, rounds)
        distrust = _spread(seeds, stage(_shares(edges, "dst", "src"), "shares"), "blocked", damping, rounds)
    scored = hosts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
    scored = scored.select("host", *(F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("trust", "distrust")))
    both = seen.join(scored, "host", "left").select("*", *(F.coalesce(c, F.lit(0.0)).alias(f"_{c}") for c in ("trust", "distrust")))
    method = F.when((F.col("_distrust") >= threshold) & (F.col("_distrust") > F.col("_trust")), "block").otherwise("allow")
    return both.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), F.col("_trust").alias("trust"), F.col("_distrust").alias("distrust"))
