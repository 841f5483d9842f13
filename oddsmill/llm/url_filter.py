"""URL filtering by rules, and for what no rule fits by trust and distrust over the graph of links, in DataFrame operations only.

A rule has a host and a path: it fits its host and all subdomains where the URL's path starts with its own, and the
longest that fits a URL decides. Pages that rules allow or block make their hosts seeds, by the number of such pages. Trust flows
from trusted seeds along links between hosts, distrust from blocked seeds against them, to those that link there; both are
personalised PageRank: at each round a host passes DAMPING of its mass on, in proportion to its links, and the rest returns to
the seeds, as does the mass of hosts without a link. Masses are scaled to pages: a host without links has as trust the share of
its pages that rules allow and as distrust the share that they block. A page without a rule is blocked where its host's distrust reaches
BLOCK_AT and exceeds its trust, else allowed.

Links are the `href` and `src` values of a page's HTML that name a host (`http://`, `https://` or `//`); relative ones stay on their
host, and links of a host to itself would only hold its mass, so neither makes an edge. Edges are counted by pair of hosts, map-side;
the edges of a host with many are dealt to slots, and its mass goes to each slot, so no host is one task's work. Each round is
written to the shared scratch folder.

Null html has no links. A null URL or one without `://` has empty host and path: no rule fits it, it is no seed and is allowed; its
links count for nothing. Repeated rows count each and are answered each; null ids are ids like others; other columns are ignored;
an empty table gives an empty result; without a seed nothing is blocked but by rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Share of its mass that a host passes on, rounds, and the distrust from which a host is blocked.
DAMPING, ROUNDS, BLOCK_AT = 0.85, 20, 0.5
#: Edges of one host in a slot, and how many ways a host's pages without a rule are dealt when they meet its verdict.
SLOT, SLOTS_OF_PAGES = 10_000, 16
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


# The production rules.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The (rule, verdict) of the longest rule that fits, or null; of equal rules the first counts."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def parsed(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and the rule's verdict, null where no rule fits."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    found = rows.withColumn("found", ruled(F.col("host"), F.col("path"), rules))
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target, links): how many links of one host's pages name another host."""
    named = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))
    links = pages.select(host_of(F.col(url_col)).alias("source"), F.explode(named).alias("target")).withColumn("target", F.translate("target", CAPITALS, SMALL))
    return links.where("source <> '' and source <> target").groupBy("source", "target").agg(F.count("*").alias("links"))


def _ways(edges: DataFrame) -> DataFrame:
    """(kind, from_, slot, to_, share): trust along links and distrust against them, and how a host's mass is shared."""
    both = edges.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(a).alias("from_"), F.col(b).alias("to_"), "links") for kind, a, b in (("trust", "source", "target"), ("distrust", "target", "source"))])).alias("e")).select("e.*")
    whole = both.groupBy("kind", "from_").agg(F.sum("links").alias("all_"), F.ceil(F.count("*") / SLOT).alias("slots"))
    shared = both.join(whole, ["kind", "from_"])
    return shared.select("kind", "from_", F.pmod(F.xxhash64("to_"), "slots").alias("slot"), "slots", "to_", (F.col("links") / F.col("all_")).alias("share"))


def propagate(hosts: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, pages, allowed, blocked) and edges to (host, trust, distrust) of those hosts, scaled to pages.

    Masses start at the seeds; after k rounds they differ from the limit by damping^k of all mass at most, a 25th after 20.
    """
    by_kind = lambda trust, distrust, name: F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias(name)) for k, c in (("trust", trust), ("distrust", distrust))])).alias("s")
    sums = hosts.agg(F.sum("allowed").alias("trust"), F.sum("blocked").alias("distrust"))  # one row
    seeds = hosts.select("host", by_kind("allowed", "blocked", "n")).select("host", "s.*").where("n > 0")
    totals = sums.select(by_kind("trust", "distrust", "total")).select("s.*")
    seeds = cut(seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed")), "seeds")  # two rows are broadcast
    ways = cut(_ways(edges), "host-ways")
    mass = seeds.select("kind", "host", F.col("seed").alias("mass"))
    if ways.head(1):
        slots = cut(ways.groupBy("kind", "from_").agg(F.first("slots").alias("slots")), "host-slots")
        for _ in range(rounds):
            sent = mass.join(slots.withColumnRenamed("from_", "host"), ["kind", "host"], "left")
            loose = sent.where("slots is null").groupBy("kind").agg(F.sum("mass").alias("loose"))  # two rows at most
            dealt = sent.where("slots is not null").select("kind", F.col("host").alias("from_"), "mass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))
            moved = dealt.join(ways, ["kind", "from_", "slot"]).select("kind", F.col("to_").alias("host"), (damping * F.col("mass") * F.col("share")).alias("part"))
            back = seeds.join(F.broadcast(loose), "kind", "left").select("kind", "host", (F.col("seed") * (1 - damping + damping * F.coalesce("loose", F.lit(0.0)))).alias("part"))
            after = cut(moved.unionByName(back).groupBy("kind", "host").agg(F.sum("part").alias("mass")), "host-mass")
            if hasattr(mass, "cut_path"):
                drop_cut(mass)
            mass = after
    scaled = mass.join(F.broadcast(totals), "kind").groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("mass") * F.col("total"))).alias(k) for k in ("trust", "distrust")])
    of = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.col("pages")
    return hosts.join(scaled, "host", "left").select("host", of("trust").alias("trust"), of("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block_at: float = BLOCK_AT) -> DataFrame:
    """page_id, host, path, rule and verdict for each row."""
    rows = cut(parsed(pages, rules, id_col, url_col), "page-rules")
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    hosts = cut(rows.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), count("allow").alias("allowed"), count("block").alias("blocked")), "hosts")
    scores = propagate(hosts, host_edges(pages, url_col, html_col))
    # nine digits, so that sums in another order give the same verdict
    bad = scores.where((F.bround("distrust", 9) >= block_at) & (F.bround("distrust", 9) > F.bround("trust", 9))).select("host", F.lit("block").alias("by_links"))
    open_ = rows.where("verdict is null").withColumn("deal", F.pmod(F.xxhash64("page_id", "path"), F.lit(SLOTS_OF_PAGES)))
    bad = bad.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS_OF_PAGES - 1).cast("long"))))
    decided = open_.join(bad, ["host", "deal"], "left").select("page_id", "host", "path", "rule", F.coalesce("by_links", F.lit("allow")).alias("verdict"))
    return rows.where("verdict is not null").unionByName(decided)
