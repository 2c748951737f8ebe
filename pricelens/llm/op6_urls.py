"""URL filters with link-graph propagation, in DataFrame functions only.

Rules of host and path decide first, the longest that fits. Hosts without one are judged by the link graph:
personalised PageRank from trusted hosts along the links, and distrust from blocked hosts against the links, by
a fixed number of damped rounds over the host edges; a host is blocked if its distrust outweighs its trust by
more than the threshold. Host edges come from the pages' absolute links and, with the lesser weight ``SITE``, from each host
to its registrable domain and back (a page on a subdomain speaks for its site): the last two labels, or three below one of
``SUFFIXES``, so sites that only share a suffix are not joined; nor are numeric hosts. A whole list of suffixes, of any
number of labels, can be given as a table instead.

Cases: a null url or one without ``://`` has empty host and path, fits no rule, and is allowed; a null html
has no links; a repeated page counts its links again; other columns are not read; an empty table gives an empty
table; very long pages are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: (host, path, verdict), fixed values of the contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, ROUNDS = 0.85, 6
#: An absolute link, quoted or not; group 2 is its host.
LINK = r"""href=["']?([A-Za-z]+:)?//([^/"'?#>\s]+)"""
#: Suffixes of two labels under which sites are registered (fixed values, to be extended), and the weight of an edge
#: within a site beside a link's 1.
SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
SITE = 0.5
#: Distrust above trust from which a host is blocked, in units of an even share of the seeds' weight.
THRESHOLD = 0.5


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null without one."""
    fits = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        cond = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(cond, value) if fits is None else fits.when(cond, value)
    return fits


def domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(src, dst) of every host: its registrable domain, one label more than the longest of the ``suffixes`` (suffix) that it
    ends with, or than its last label. Without such a table the two-label ``SUFFIXES`` count."""
    labels = F.split("host", r"\.")
    last = lambda n: F.array_join(F.slice(labels, -F.least(n, F.size(labels)), n), ".")
    if suffixes is None:
        two, three = last(F.lit(2)), last(F.lit(3))
        return hosts.select(F.col("host").alias("src"), F.when(two.isin(*SUFFIXES), three).otherwise(two).alias("dst"))
    ends = hosts.select("host", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("k")).withColumn("suffix", last(F.col("k")))
    ends = ends.join(suffixes.select("suffix").distinct(), "suffix").groupBy("host").agg(F.max("k").alias("k"))
    return hosts.join(ends, "host", "left").select(F.col("host").alias("src"), last(F.coalesce("k", F.lit(1)) + 1).alias("dst"))


def host_edges(pages: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(src, dst, n): links between different hosts, and between a host and its registrable domain both ways."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 2)).alias("dst"))
    links = links.select(F.col("host").alias("src"), _ascii_lower(F.col("dst")).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))
    up = domains(pages.where(~F.col("host").rlike("[0-9]$")).select("host").distinct(), suffixes)
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(SITE))
    every = links.unionByName(both).where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != ""))
    return every.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, score): personalised PageRank from ``seeds`` (host, seed) along (src, dst, n)."""
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    steps = stash(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("p")), "steps")
    rank = seeds.select("host", F.col("seed").alias("score"))
    for k in range(rounds):
        moved = rank.join(steps, rank["host"] == steps["src"]).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("score") * F.col("p"))).alias("score"))
        rank = moved.unionByName(seeds.select("host", ((1 - damping) * F.col("seed")).alias("score"))).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 3 == 2:
            rank = stash(rank, "rank")
    return rank


def url_verdicts(pages: DataFrame, rules=RULES, url_col="url", html_col="html", id_col="page_id", threshold: float = THRESHOLD, suffixes: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every page."""
    p = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col].cast("string")).alias("host"), path_of(pages[url_col].cast("string")).alias("path"), pages[html_col].cast("string").alias("html"))
    edges = stash(host_edges(p, suffixes), "hosts")
    p = p.drop("html").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    # Seeds: hosts by the share of their pages that rules allow or block, scaled to a mean of one.
    share = p.where("host <> ''").groupBy("host").agg(F.avg((F.col("fit.verdict") == "allow").cast("int") + F.lit(0.0)).alias("a"), F.avg((F.col("fit.verdict") == "block").cast("int") + F.lit(0.0)).alias("b"), F.count("fit").alias("nf"), F.count(F.lit(1)).alias("n"))
    share = stash(share.select("host", (F.coalesce("a", F.lit(0.0)) * F.col("nf") / F.col("n")).alias("good"), (F.coalesce("b", F.lit(0.0)) * F.col("nf") / F.col("n")).alias("bad")), "seeds")
    trust = propagate(edges, share.where("good > 0").select("host", F.col("good").alias("seed")))
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(against, share.where("bad > 0").select("host", F.col("bad").alias("seed")))
    scores = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    scores = stash(scores.groupBy("host").agg(F.round(F.sum("trust"), 9).alias("trust"), F.round(F.sum("distrust"), 9).alias("distrust")), "scores")
    p = p.join(scores, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    method = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return p.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "trust", "distrust")
