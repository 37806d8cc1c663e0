"""Verdicts on urls: rules first, then trust and distrust that spread over the links between hosts.

Pages that a rule decides are the seeds. Trust starts at hosts by their allowed pages and follows the links; distrust starts at
hosts by their blocked pages and follows them backwards, to hosts that link to them. Both are personalised PageRank over the
same table of host links, in one join and one aggregation a round; each round's scores are written to the shared folder.
A host is blocked if its distrust outweighs its trust; one that neither reaches is allowed.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.scratch import Scratch, broadcast_if_small

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
#: Hosts whose scores may be broadcast.
_BROADCAST_HOSTS = 500_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _fits(rule: Rule) -> Column:
    host = F.col("host")
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(F.col("path"), F.lit(rule.path))


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule and ruling of every page; the longest fitting rule wins, of equally long ones the first."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), -rules.index(r))):
        rule, ruling = F.when(_fits(r), r.name).otherwise(rule), F.when(_fits(r), r.verdict).otherwise(ruling)
    return named.select("*", rule.alias("rule"), ruling.alias("ruling"))


def host_links(pages: DataFrame) -> DataFrame:
    """source, target, links: links between different hosts; relative links stay on their host and say nothing."""
    out = pages.select(host_of(F.col("url")).alias("source"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(_LINK), 1)).alias("target"))
    return out.select("source", lower_ascii(F.col("target")).alias("target")).where("source != '' AND source != target").groupBy(
        "source", "target"
    ).agg(F.count("*").alias("links"))


def spread(seeds: DataFrame, links: DataFrame, scratch: Scratch, damping: float, rounds: int | None, tolerance: float) -> DataFrame:
    """host, trust, distrust after personalised PageRank from ``seeds`` (host, trust, distrust).

    ``links`` counts as directed for trust and as reversed for distrust. What a host without links to follow would pass on returns
    to itself. Ends once no host is newly reached and no host's score changes by more than ``tolerance`` of itself, however large
    the other scores are, or after ``rounds`` if given.
    """
    forward = links.select(F.lit(True).alias("good"), F.col("source").alias("from"), F.col("target").alias("to"), "links")
    backward = links.select(F.lit(False).alias("good"), F.col("target").alias("from"), F.col("source").alias("to"), "links")
    both = forward.union(backward)
    totals = both.groupBy("good", "from").agg(F.sum("links").alias("total"))
    edges = scratch.table(both.join(totals, ["good", "from"]).select("good", "from", "to", (F.col("links") / F.col("total")).alias("share")), "links-edges")
    ends = scratch.table(edges.select("good", F.col("from").alias("host")).distinct(), "links-ends")
    start = scratch.table(
        seeds.select(F.lit(True).alias("good"), "host", F.col("trust").alias("seed")).union(
            seeds.select(F.lit(False).alias("good"), "host", F.col("distrust").alias("seed"))
        ).where("seed > 0"),
        "links-seeds",
    )
    now = scratch.table(start.withColumnRenamed("seed", "score"), "links-scores")
    seeded = not start.isEmpty()
    for _ in (count() if rounds is None else range(rounds)) if seeded else ():
        moved = now.withColumnRenamed("host", "from").join(edges, ["good", "from"]).select("good", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("part"))
        stays = now.join(ends, ["good", "host"], "left_anti").select("good", "host", (F.col("score") * damping).alias("part"))
        fresh = start.select("good", "host", (F.col("seed") * (1 - damping)).alias("part"))
        parts = moved.union(stays).union(fresh)
        # The old scores go through the same aggregation, which gives the change without another join.
        old = now.select("good", "host", F.lit(0.0).alias("part"), F.col("score").alias("old"))
        after = scratch.table(
            parts.withColumn("old", F.lit(0.0)).union(old).groupBy("good", "host").agg(F.sum("part").alias("score"), F.sum("old").alias("old")),
            "links-scores",
        )
        larger = F.greatest("score", "old")
        # A newly reached host changes by all of itself. Scores that are about to underflow don't settle.
        change = after.where(larger > 1e-290).agg(F.max(F.abs(F.col("score") - F.col("old")) / larger)).first()[0]
        scratch.drop(now)
        now = after
        if change is None or change <= tolerance:
            break
    scratch.drop(edges, ends, start)
    return now.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("good"), F.col("score"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(~F.col("good"), F.col("score"))), F.lit(0.0)).alias("distrust"),
    )


def judge(
    pages: DataFrame, rules: list[Rule], damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-4, threshold: float = 0.0
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A NULL url or one without ``://`` has an empty host and path, which no rule and no link reaches, and is allowed. NULL html has
    no links. A host is blocked if (trust - distrust) / (trust + distrust) lies below ``threshold``. Repeated rows come out
    repeated and weigh as often; an empty table gives no rows. Extra columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    decided = ruled(pages, rules)
    seeds = decided.where("host != '' AND ruling IS NOT NULL").groupBy("host").agg(
        F.sum((F.col("ruling") == "allow").cast("double")).alias("trust"), F.sum((F.col("ruling") == "block").cast("double")).alias("distrust")
    )
    links = scratch.table(host_links(pages), "links-hosts")
    scores = scratch.table(spread(scratch.table(seeds, "links-rulings"), links, scratch, damping, rounds, tolerance), "links-result")
    scratch.drop(links)
    met = decided.join(broadcast_if_small(scores, scores.count(), _BROADCAST_HOSTS), "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    bad = (trust + distrust > 0) & ((trust - distrust) / F.greatest(trust + distrust, F.lit(1e-300)) < threshold)
    return met.select(
        "page_id", "host", "path", "rule", F.coalesce("ruling", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )
