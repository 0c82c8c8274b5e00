"""URL filters: rules by host and path, and trust that spreads over the link graph of hosts.

A rule is a host and the beginning of a path; it fits the host and its subdomains, and the longest fitting rule decides.
Pages without a rule are decided by their host. Hosts with allowed pages are trusted seeds and those with blocked pages
blocked seeds, in proportion to the pages; trust is the personalised PageRank from the trusted seeds along links between
hosts, distrust the personalised PageRank from the blocked seeds against them. A host whose distrust exceeds `ratio`
times its trust is blocked, any other allowed. All of it is DataFrame work, one row for each pair of linked hosts.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and links nothing; the empty
host is no node, and its pages are allowed. A null html has no links. Links to the own host do not count. Repeated
rows count as pages of their own. Trust and distrust that are equal allow. An empty table gives no rows; urls and pages
of any length count whole; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import saved

#: Fixed rules of the query op3: what they do, and host and path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*+=\s*+["']?(?:[a-z][a-z0-9+.-]*+:)?//([^/?#"'\s>]++)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    picked = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last one that fits, the longest, comes first in the chain
        at, _, begin = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + begin)
        picked = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(picked)
    return picked


def spread(nodes: DataFrame, edges: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """Personalised PageRank of each kind: kind, host, rank. nodes: kind, host and seed shares that add up to 1 for each kind; edges: kind, src, dst, share of src's links.

    What a host without links holds goes back to the seeds, as does the rest of every step. Steps go on until they change
    the ranks of all hosts by less than `tolerance` together; each step takes the change down by `damping` at least.
    """
    rank = saved(nodes.select("kind", "host", "seed", F.col("seed").alias("rank")))
    change = 0.0 if edges.isEmpty() else 1.0  # without links all that is held goes back to the seeds in every step
    while change > tolerance:
        moved = rank.where("rank > 0").join(edges.withColumnRenamed("src", "host"), ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        kept = rank.join(moved, ["kind", "host"], "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
        arrived = kept.groupBy("kind").agg(F.sum("got").alias("all"))  # a row for each kind
        new = damping * F.col("got") + (1 - damping * F.col("all")) * F.col("seed")
        rank = saved(kept.join(F.broadcast(arrived), "kind").select("kind", "host", "seed", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")))
        change = rank.agg(F.sum("change")).first()[0] or 0.0
    return rank.select("kind", "host", "rank")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...], damping: float = 0.85, tolerance: float = 1e-9, ratio: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each page (page_id, url, html)."""
    known = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = known.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    linked = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to"))
    linked = linked.select("src", F.translate("to", UPPER, LOWER).alias("dst")).where("src != '' AND src != dst")
    edges = saved(linked.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    hosts = known.where("host != ''").groupBy("host").agg(F.count_if(F.col("found.verdict") == "allow").alias("allowed"), F.count_if(F.col("found.verdict") == "block").alias("blocked"))
    hosts = saved(hosts.unionByName(edges.select(F.col("dst").alias("host"), F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("blocked"))).groupBy("host").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")))
    total = hosts.agg(F.sum("allowed").alias("all_allowed"), F.sum("blocked").alias("all_blocked"))
    share = lambda n: F.coalesce(F.try_divide(F.col(n), F.col(f"all_{n}")), F.lit(0.0)).alias(n)
    nodes = hosts.crossJoin(F.broadcast(total)).select("host", share("allowed"), share("blocked"))
    out = edges.groupBy("src").agg(F.sum("n").alias("all")).withColumnRenamed("src", "s")
    into = edges.groupBy("dst").agg(F.sum("n").alias("all")).withColumnRenamed("dst", "s")
    share_of = (F.col("n") / F.col("all")).alias("share")
    along = edges.join(out, F.col("src") == F.col("s")).select(F.lit("trust").alias("kind"), "src", "dst", share_of)
    against = edges.join(into, F.col("dst") == F.col("s")).select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), share_of)
    seeds = nodes.select(F.lit("trust").alias("kind"), "host", F.col("allowed").alias("seed")).union(nodes.select(F.lit("distrust"), "host", "blocked"))
    both = spread(seeds, saved(along.union(against)), damping, tolerance)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("rank"))).alias(kind)  # noqa: E731  a row for each host and kind
    # written, so the pages' join has a plain shuffle on either side and Spark can split the pages of a hot host
    ranks = saved(both.groupBy(F.col("host").alias("h")).agg(of("trust"), of("distrust")))
    judged = known.join(ranks, F.col("host") == F.col("h"), "left")
    worse = F.coalesce(F.col("distrust") > ratio * F.col("trust"), F.lit(False))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.when(worse, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    from .frames import table

    return judge(table(spark, sf_dir, "pages"), RULES)
