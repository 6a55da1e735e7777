"""URL filters: host and path rules, and link-graph propagation for what no rule covers.

Hosts that rules allow or block outright are the seeds. Trust is a personalised PageRank from the
trusted ones along links, distrust one from the blocked ones against the links: who links to blocked
hosts is suspect. Both walks go on until what is left of their mass is below a tolerance. Each host's
scores are then held against thresholds.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: The rules of the filter, as host and path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DAMPING = 0.85
#: The share of the seeds' mass that may be left unsettled. A round leaves DAMPING of what the one before
#: left, exactly, as mass at hosts without links goes back to the seeds; so the rounds that it takes are known.
TOLERANCE = 1e-3
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
#: A host is blocked if its distrust is at least so many seeds' shares and so many times its trust.
LEAST_DISTRUST, MARGIN = 0.02, 1.0
_LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/"'?#\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): from the first :// up to /, ?, # or the end, A-Z lowered; then up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none; of equally long ones the first."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(walk, host, score): personalised PageRank from seeds (walk, host) over edges (walk, src, dst, n), each walk by itself.

    Mass that reaches a host without links goes back to the walk's seeds in equal parts. Scores are in
    shares of one seed: a seed has 1 by itself, and more if the walk leads back to it.
    """
    out = materialise(edges.groupBy("walk", "src").agg(F.sum("n").alias("all")), "out-links")
    steps = materialise(edges.join(out, ["walk", "src"]).select("walk", "src", "dst", (F.col("n") / F.col("all")).alias("w")), "steps")
    seeds = materialise(seeds.select("walk", "host").distinct(), "seeds")
    sizes = {r["walk"]: r["n"] for r in seeds.groupBy("walk").agg(F.count("*").alias("n")).collect()}  # a row per walk
    share, now = {w: 1.0 for w in sizes}, seeds.withColumn("score", F.lit(1.0))
    mass = {w: float(n) for w, n in sizes.items()}
    for k in range(rounds if sizes else 0):
        held = steps.join(now.withColumnRenamed("host", "src"), ["walk", "src"]).select("walk", F.col("dst").alias("host"), (F.col("w") * F.col("score") * DAMPING).alias("score"))
        # written before it is met again: cuts lineage, and lets the next join split a host with very many links
        moved = materialise(held.groupBy("walk", "host").agg(F.sum("score").alias("score")), "moved")
        got = {r["walk"]: r["mass"] for r in moved.groupBy("walk").agg(F.sum("score").alias("mass")).collect()}
        share = {w: 1.0 + (DAMPING * mass[w] - got.get(w, 0.0)) / n for w, n in sizes.items()}
        mass = {w: got.get(w, 0.0) + share[w] * n for w, n in sizes.items()}
        own = F.coalesce(*(F.when(F.col("walk") == w, F.lit(x)) for w, x in share.items()), F.lit(0.0))
        if k:
            discard(old)
        old, now = moved, moved.unionByName(seeds.withColumn("score", own))
    return now.groupBy("walk", "host").agg(F.sum("score").alias("score"))


def judge(pages: DataFrame, rules=RULES, trusted: tuple[str, ...] = (), blocked: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of pages.

    The verdict is the longest fitting rule's, else the host's: block if its distrust passes both
    thresholds, otherwise allow. Seeds are the hosts named, those of whose pages rules block all, and
    those where rules allow some and block none. A null url or one without :// has an empty host and
    path; the empty host is no seed and has no links. Null html has no links; repeated rows are judged alike
    and their links count as often as they occur; other columns are not looked at.
    """
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruling"))
    links = parsed.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select("src", lower_ascii(F.col("dst")).alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
    edges = materialise(links.groupBy("src", "dst").agg(F.count("*").alias("n")), "host-edges")
    scores = {k: None for k in ("trust", "distrust")}
    if not edges.isEmpty():
        hosts = ruled.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruling") == "allow").alias("a"), F.count_if(F.col("ruling") == "block").alias("b"))
        good = hosts.filter("a > 0 and b = 0").select("host").union(_named(pages, trusted))
        bad = hosts.filter("b = n").select("host").union(_named(pages, blocked))
        back = edges.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
        walks = edges.select(F.lit("trust").alias("walk"), "src", "dst", "n").unionByName(back)
        seeds = good.select(F.lit("trust").alias("walk"), "host").union(bad.select(F.lit("distrust").alias("walk"), "host"))
        found = materialise(propagate(walks, seeds), "ranks")
        scores = {k: found.filter(F.col("walk") == k).drop("walk") for k in scores}
    out = ruled
    for name, found in scores.items():
        if found is None:
            out = out.withColumn(name, F.lit(0.0))
        else:
            out = out.join(found.withColumnRenamed("score", name), "host", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    suspect = (F.col("distrust") >= LEAST_DISTRUST) & (F.col("distrust") > MARGIN * F.col("trust"))
    by_host = F.when(suspect, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruling", by_host).alias("verdict"), "trust", "distrust")


def _named(pages: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    return pages.sparkSession.createDataFrame([(h,) for h in hosts], "host string")


def op1_urls(spark, sf_dir: str) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the host's trust and distrust."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
