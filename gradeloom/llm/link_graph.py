"""URL filters: rules, and trust and distrust spread over the graph of hosts.

A rule (verdict, host, path) fits a URL on its host or a subdomain whose path starts
with the rule's; the longest fitting rule decides. Other URLs get their host's verdict:
hosts with allowed pages are seeds of trust, which follows links; hosts with blocked
pages are seeds of distrust, which follows links backwards, for a host that links to
bad ones is likely bad. Both are personalised PageRanks, computed with joins and
aggregates; only DataFrame functions are used.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import LOWER, UPPER
from gradeloom.session import settle

DAMPING = 0.85
TOLERANCE = 1e-9  # PageRank goes on until all scores together lack no more than this
THRESHOLD = 0.5  # share of (1 - DAMPING): what a host has whose pages are half blocked and that nobody links to
DIGITS = 12  # scores are compared after rounding, for the order of a sum must not decide

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules) for each of the distinct ``hosts``: the rules of the host and all domains
    above it, longest first (then in the order of their text), as an array."""
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    above = hosts.select("host", F.explode(suffix).alias("_domain"))
    text = F.concat(F.col("host"), F.col("path"))
    listed = rules.select(
        F.col("host").alias("_domain"),
        F.struct((-F.length(text)).alias("order"), text.alias("rule"), F.col("verdict").alias("verdict"), F.col("path").alias("path")).alias("rule"),
    )
    fitting = above.join(listed, "_domain").groupBy("host").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    return hosts.join(fitting, "host", "left")


def links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of different hosts, from absolute and protocol-relative links in ``html``."""
    # Only the references leave the row, so that no stage moves whole pages.
    href = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(href), F.lit(1))
    target = host_of(F.regexp_replace("link", "^//", "http://"))
    out = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(found)).alias("link"))
    return out.select("src", target.alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst").distinct()


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, score): PageRank with restarts at ``seeds``(host, seed).

    Rounds go on until all scores together lack at most ``tolerance``, however long the paths;
    they stop earlier only if a number of ``rounds`` is given. What all scores grow by in a round
    shrinks by the damping at least, which bounds what is still to come.

    Scores are not normalised: a host without links has (1 - damping) times its seed.
    A host with very many links is one key on either side of a join of edges, which
    adaptive execution splits; its sum is combined before the shuffle.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    shares = settle(edges.join(degree, "src"))
    nothing = F.lit(0.0)
    start = seeds.select("host", (F.col("seed") * F.lit(1 - damping)).alias("part"), nothing.alias("former"))
    scores = settle(start.select("host", F.col("part").alias("score")))
    if shares.isEmpty():
        return scores
    done, mass = 0, seeds.agg(F.sum("seed")).first()[0] or 0.0
    while rounds is None or done < rounds:
        moved = shares.join(scores.select(F.col("host").alias("src"), "score"), "src")
        moved = moved.select(F.col("dst").alias("host"), (F.col("score") / F.col("degree") * damping).alias("part"), nothing.alias("former"))
        every = moved.unionByName(start).unionByName(scores.select("host", nothing.alias("part"), F.col("score").alias("former")))
        grown = settle(every.groupBy("host").agg(F.sum("part").alias("score"), F.sum("former").alias("former")))
        scores, done = grown.select("host", "score"), done + 1
        growth = grown.agg(F.sum(F.col("score") - F.col("former"))).first()[0] or 0.0
        if min(growth * damping / (1 - damping), mass * damping ** (done + 1)) <= tolerance:
            break
    return scores


def judged(pages: DataFrame, rules: Sequence[Rule] | DataFrame, damping: float = DAMPING, rounds: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of pages(page_id, url, html).

    Without a rule a page is blocked if its host's distrust exceeds its trust and is
    at least ``threshold`` of what a fully blocked host has on its own. Null URLs and
    those without ``://`` have empty host and path; they have no edges and are
    allowed unless a rule has an empty host. Repeated rows are judged alike.
    """
    if not isinstance(rules, DataFrame):
        rules = rule_table(pages.sparkSession, rules)
    located = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = settle(host_rules(located.select("host").distinct(), rules))
    matching = F.filter(F.coalesce("rules", F.array()), lambda r: F.startswith(F.col("path"), r["path"]))
    ruled = located.join(known, "host", "left").select("page_id", "host", "path", F.get(matching, F.lit(0)).alias("rule"))
    ruled = settle(ruled.select("page_id", "host", "path", "rule.rule", "rule.verdict"))
    share = [F.avg((F.coalesce("verdict", F.lit("")) == v).cast("double")) for v in ("allow", "block")]
    hosts = settle(ruled.filter("host <> ''").groupBy("host").agg(share[0].alias("allow"), share[1].alias("block")))
    edges = settle(links(pages))
    trust = spread(hosts.select("host", F.col("allow").alias("seed")), edges, damping, rounds)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = spread(hosts.select("host", F.col("block").alias("seed")), back, damping, rounds)
    scores = (
        hosts.select("host")
        .join(trust.withColumnRenamed("score", "trust"), "host", "left")
        .join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
    )
    zero = F.lit(0.0)
    trusted, distrusted = (F.round(F.coalesce(k, zero), DIGITS) for k in ("trust", "distrust"))
    bad = (distrusted > trusted) & (distrusted >= round(threshold * (1 - damping), DIGITS))
    return ruled.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        trusted.alias("trust"),
        distrusted.alias("distrust"),
    )
