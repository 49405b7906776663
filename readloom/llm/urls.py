"""URL filters: rules on host and path, and trust that spreads over host links (operator 9). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: (host and path, verdict); a rule fits its host and all subdomains, where the url's path begins with the rule's.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Share of the rank that follows links; rounds; a host is blocked where distrust is over this multiple of its trust.
DAMPING, ROUNDS, RATIO = 0.85, 12, 2.0
#: A written table cuts the lineage after so many rounds.
CUT = 6


def host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z in lower case; '' for a null url or one without '://'."""
    got = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(got, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last that fits is the longest
        h, _, p = text.partition("/")
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith("/" + p)
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links of a host's pages to other hosts, and a host to its parent domain and back (weight 1 each).

    Relative links stay on their host and add nothing. Links are counted for each pair of hosts before the shuffle.
    """
    hrefs = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]*)"), F.lit(1))
    links = pages.filter(F.col("host") != "").select(F.col("host").alias("src"), F.explode(hrefs).alias("to"))
    links = links.select("src", host(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))).alias("dst"))
    links = links.filter((F.col("dst") != "") & (F.col("dst") != F.col("src"))).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    names = pages.filter(F.col("host").contains(".")).select("host").distinct()
    up = names.select("host", F.regexp_extract("host", r"^[^.]*\.(.*\..*)$", 1).alias("parent")).filter("parent <> ''")
    both = up.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("parent").alias("dst")), F.struct(F.col("parent").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.src", "e.dst").distinct()
    return links.unionByName(both.withColumn("weight", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank: node, rank. ``seeds``: node, seed (its teleport weight).

    What reaches a node without links is lost, as in a walk that ends there, so ranks sum to
    the seeds' sum at most. Every round is one join on the source and one
    pre-aggregated sum for each target. Without seeds there are no ranks.
    """
    spark = edges.sparkSession
    out = edges.groupBy("src").agg(F.sum("weight").alias("_all"))
    step = store.keep(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_all")).alias("share")), "links")
    seeds = store.keep(seeds.select("node", "seed"), "seeds")
    rank, held = seeds.withColumnRenamed("seed", "rank"), [seeds, step]
    for i in range(rounds):
        moved = rank.join(step, rank["node"] == step["src"]).select(F.col("dst").alias("node"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        back = seeds.select("node", (F.col("seed") * (1 - damping)).alias("rank"))
        rank = moved.unionByName(back).groupBy("node").agg(F.sum("rank").alias("rank"))
        if (i + 1) % CUT == 0 and i + 1 < rounds:
            rank = store.keep(rank, "ranks")
            held.append(rank)
    out = store.keep(rank, "ranks")
    store.drop(spark, *held)
    return out


def judge(pages: DataFrame, *, rules=RULES, url: str = "url", html: str = "html", page_id: str = "page_id", ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    The longest rule that fits a url decides. Elsewhere the host does: seeds of trust are hosts by their share of pages that a
    rule allows, seeds of distrust by those that one blocks; trust spreads along links and distrust against them, and a host
    is blocked where its distrust is above ``ratio`` times its trust. A host that neither reaches is allowed, as are pages
    without a host. Null urls have empty hosts and paths and fit no rule; repeated pages are judged alike.
    """
    h, p = host(F.col(f"`{url}`")), path(F.col(f"`{url}`"))
    parsed = pages.select(F.col(f"`{page_id}`").alias("page_id"), h.alias("host"), p.alias("path"), F.col(f"`{html}`").alias("html"))
    name, what = rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("page_id", "host", "path", name.alias("rule"), what.alias("_ruled"))
    spark = pages.sparkSession
    edges = store.keep(host_edges(parsed), "edges")
    seeds = store.keep(
        ruled.filter((F.col("host") != "") & F.col("_ruled").isNotNull()).groupBy("host").agg(F.sum((F.col("_ruled") == "allow").cast("double")).alias("good"), F.sum((F.col("_ruled") == "block").cast("double")).alias("bad")), "host-seeds"
    )
    share = lambda c: seeds.filter(F.col(c) > 0).select(F.col("host").alias("node"), (F.col(c) / (F.col("good") + F.col("bad"))).alias("seed"))
    trust = spread(edges, share("good"))
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = spread(reverse, share("bad"))
    scores = trust.select("node", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("node", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust")))
    scores = store.keep(scores.groupBy(F.col("node").alias("host")).agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "host-scores")
    store.drop(spark, edges, seeds, trust, distrust)
    out = ruled.join(scores, "host", "left")
    own = F.when(F.coalesce(F.col("distrust"), F.lit(0.0)) > ratio * F.coalesce(F.col("trust"), F.lit(0.0)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce(F.col("_ruled"), own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
