"""URL verdicts by link-graph propagation, in DataFrame operations only.

Rules judge the urls that they fit. For all others the host decides: trust spreads by personalised PageRank from hosts
with allowed pages along host edges, distrust from hosts with blocked pages along the reversed edges, and a host is
blocked where its distrust exceeds its trust. Edges are absolute links between hosts in the pages, and both ways between
a host and its parent domain, which such sites link as a matter of course.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborscale.llm._shared import written

#: Host, path and verdict of each rule; a fixed list.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Share of the rank that goes on along edges at each of the rounds.
DAMPING, ROUNDS = 0.85, 12
#: A host is blocked where distrust exceeds trust by more than this.
THRESHOLD = 1e-9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z turn small. Else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits; of equally long ones the first by text."""
    best = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in best]
    nothing = F.lit(None).cast("string")
    named = F.coalesce(*[F.when(f, F.lit(r[0] + r[1])) for f, r in zip(fits, best, strict=True)], nothing)
    verdict = F.coalesce(*[F.when(f, F.lit(r[2])) for f, r in zip(fits, best, strict=True)], nothing)
    return named, verdict


def host_edges(pages: DataFrame, judged: DataFrame) -> DataFrame:
    """Distinct ``src`` and ``dst`` hosts with the number of links as ``weight``, without loops."""
    own = host_of(F.col("url"))
    linked = pages.select(own.alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)(?:href|src)\s*=\s*["']?([a-z][a-z0-9+.-]*://[^\s"'<>]+)"""), 1)).alias("link"))
    links = linked.select("src", host_of(F.col("link")).alias("dst"))
    hosts = judged.select("host").distinct()
    parent = hosts.select(F.col("host").alias("child"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("dst")).where("dst <> ''")
    known = parent.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")
    both = known.select(F.col("child").alias("src"), "dst").union(known.select(F.col("dst").alias("src"), F.col("child").alias("dst")))
    return links.union(both).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank: ``host`` and ``rank`` after some rounds from ``seeds`` (``host``, ``mass``).

    Mass at a host without edges stays there with its own share, as its seeds give it anew each round. Every fourth
    round is written, which keeps lineage short."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    shares = written(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "shares")
    base = seeds.select("host", (F.col("mass") * (1 - damping)).alias("rank"))
    ranks = base
    for i in range(1, rounds + 1):
        moved = ranks.join(shares, ranks["host"] == shares["src"]).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("rank"))
        ranks = base.union(moved).groupBy("host").agg(F.sum("rank").alias("rank"))
        if i % 4 == 0:
            ranks = written(ranks, "ranks")
    return ranks


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row of ``pages``: ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``.

    Seeds are hosts by the share of their pages that a rule allows or blocks. A host without either, or with a url that
    is null or has no ``://``, is allowed; equal trust and distrust allow too."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = named.withColumn("rule", rule).withColumn("of_rule", verdict)
    by_host = written(judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("of_rule") == "allow").alias("allowed"), F.count_if(F.col("of_rule") == "block").alias("blocked"), F.count("*").alias("n")), "hosts")
    edges = written(host_edges(pages, by_host), "host-edges")
    trust = propagate(edges, by_host.where("allowed > 0").select("host", (F.col("allowed") / F.col("n")).alias("mass")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(back, by_host.where("blocked > 0").select("host", (F.col("blocked") / F.col("n")).alias("mass")))
    scores = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0), F.col("rank")))
    blocked = written(scores.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).where(F.col("distrust") > F.col("trust") + THRESHOLD).select("host", F.lit("block").alias("of_host")), "blocked-hosts")
    return judged.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("of_rule", "of_host", F.lit("allow")).alias("verdict"))
