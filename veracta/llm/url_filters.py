"""Verdicts on urls: host and path rules first, then trust and distrust spread over the host graph.

Hosts are linked by the pages' absolute hyperlinks and, since a subdomain is
set up by its parent, by edges both ways between a host and the nearest parent
that occurs too. Trust is a personalised PageRank from hosts whose pages the
rules allow; distrust is one over reversed edges from hosts with blocked pages.
A host is blocked where its distrust outweighs its trust.

Null urls, and urls without ``://``, have an empty host and path, fit no rule
and are allowed. Null html has no links. Repeated rows stay; extra columns are
ignored; an empty table gives an empty result. Without seeds all is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

#: (verdict, rule) as the contract states them. Fixed values.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, ROUNDS, RATIO = 0.85, 20, 1.0
_LABEL = r"(?i)\bhref\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(_lower(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for judged, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, sep, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(sep + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(judged)).otherwise(verdict)
    return rule, verdict


def host_edges(hosts: DataFrame, pages: DataFrame) -> DataFrame:
    """``src, dst, weight`` between different hosts of the table ``hosts(host)``."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LABEL), 1)).alias("dst"))
    links = links.select("src", _lower("dst").alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    # every parent domain of a host: one row for each of its labels
    parts = hosts.select("host", F.split("host", r"\.").alias("p"))
    ups = parts.select("host", F.posexplode(F.transform(F.sequence(F.lit(2), F.greatest(F.size("p"), F.lit(2))), lambda i: F.array_join(F.slice("p", i, F.greatest(F.size("p") - i + 1, F.lit(0))), "."))).alias("up", "parent"))
    known = ups.join(hosts.select(F.col("host").alias("parent")), "parent").where("parent <> '' and parent <> host")
    near = known.groupBy("host").agg(F.min(F.struct("up", "parent")).alias("near")).select("host", F.col("near.parent").alias("parent"))
    both = near.select(F.col("host").alias("src"), F.col("parent").alias("dst"), F.lit(1.0).alias("weight")).union(near.select(F.col("parent").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("weight")))
    known_links = links.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")
    return known_links.union(both).where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host, score``: PageRank with restarts at ``seeds(host, mass)``, over ``edges(src, dst, weight)``.

    What a host without edges has goes nowhere. The edges' shares are written once; each round's
    hosts are written too when the graph is deep, so that a plan never spans more than five rounds.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    share = materialise(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")), "shares")
    start = materialise(seeds.select("host", F.col("mass").alias("score")), "seeds")
    if not share.head(1) or not start.head(1):
        return start.select("host", (F.lit(1 - damping) * F.col("score")).alias("score"))
    score = start
    for k in range(rounds):
        moved = score.join(share, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host")).agg(F.sum(F.lit(damping) * F.col("score") * F.col("share")).alias("score"))
        restart = start.select("host", (F.lit(1 - damping) * F.col("score")).alias("score"))
        score = moved.union(restart).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 5 == 4:
            score = materialise(score, "ranks")
    return score


def judged(pages: DataFrame, rules=RULES, ratio: float = RATIO, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for each row of ``pages(page_id, url, html)``."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    hosts = materialise(
        rows.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")), "hosts"
    )
    edges = materialise(host_edges(hosts.select("host"), rows), "edges")
    sums = hosts.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    trust = propagate(hosts.where("good > 0").select("host", (F.col("good") / F.lit(float(sums.g or 1))).alias("mass")), edges, damping, rounds)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(hosts.where("bad > 0").select("host", (F.col("bad") / F.lit(float(sums.b or 1))).alias("mass")), back, damping, rounds)
    score = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0), F.col("score")))
    score = score.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    out = rows.drop("html").join(score, "host", "left").na.fill(0.0, ["trust", "distrust"])
    # a billionth of the trust apart counts as even, whatever order the sums were taken in; scores shrink with the table
    worse = (F.col("distrust") > 0) & (F.col("distrust") > F.lit(ratio * (1 + 1e-9)) * F.col("trust"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(worse, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
