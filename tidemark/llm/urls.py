"""URL rules, and for pages without one, trust and distrust propagated over the graph of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written

UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path); a rule fits the host and its subdomains where the path starts with the rule's.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER_LETTERS, LOWER_LETTERS)
    return host, F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame, domain_weight: float = 0.5) -> DataFrame:
    """(src, dst, w): w pages of src link to the other host dst; and a host and the domain above it, down to three labels (two
    may be a suffix that strangers share), are linked both ways with domain_weight, as they are in one hand."""
    links = pages.select("host", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER_LETTERS, LOWER_LETTERS)))).alias("dst"))
    links = links.where("host <> '' AND dst <> host").groupBy(F.col("host").alias("src"), "dst").agg(F.count("*").cast("double").alias("w"))
    hosts = pages.select("host").union(links.select("dst")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    above = hosts.select(labels.alias("l")).where(F.size("l") > 3)
    steps = above.select("l", F.explode(F.sequence(F.lit(1), F.least(F.size("l") - 3, F.lit(8)))).alias("i"))
    name = lambda i: F.array_join(F.slice("l", i, F.size("l")), ".")
    pairs = steps.select(name(F.col("i")).alias("src"), name(F.col("i") + 1).alias("dst")).distinct()
    both = pairs.union(pairs.select("dst", "src")).select("src", "dst", F.lit(float(domain_weight)).alias("w"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagated(edges: DataFrame, seeds: DataFrame, keep: Written, tolerance: float = 1e-3, damping: float = 0.85, cut: int = 5, most: int = 200) -> DataFrame:
    """(kind, host, rank): for each kind of its own, PageRank over edges(kind, src, dst, w) personalised to seeds(kind, host, mass).

    Rounds go on until what later ones could still move is under the tolerance, of a mass of 1, in every kind (the change over `cut`
    rounds bounds it), `most` rounds at most. Mass that comes to a host without edges goes back to the seeds: all other ranks only grow in
    proportion by that, so a kind's ranks are scaled to sum 1 at the end. Written down every `cut` rounds, so plans stay short and lost
    work small."""
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    shares = keep(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("w") / F.col("all")).alias("share")), "shares")
    total = seeds.groupBy("kind").agg(F.sum("mass").alias("all"))
    start = keep(seeds.join(total, "kind").select("kind", "host", (F.col("mass") / F.col("all")).alias("rank")), "start")
    base = start.withColumn("rank", (1 - damping) * F.col("rank"))
    ranks = last = start
    for i in range(1, most + 1):
        sent = ranks.join(shares, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
        ranks = sent.unionByName(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % cut == 0:
            ranks = keep(ranks, f"ranks{i // cut % 2}")
            moved = ranks.unionByName(last.withColumn("rank", -F.col("rank"))).groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("by"))
            ahead = moved.groupBy("kind").agg((F.sum("by") * (damping**cut / (1 - damping**cut))).alias("ahead"))
            if ahead.where(F.col("ahead") > tolerance).isEmpty():
                break
            last = ranks
    whole = ranks.groupBy("kind").agg(F.sum("rank").alias("all"))
    return ranks.join(whole, "kind").select("kind", "host", (F.col("rank") / F.col("all")).alias("rank"))


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages(page_id, url, html).

    Pages without absolute links give no edges between strangers; then only hosts of one domain reach each other. Trust flows from the hosts of allowed pages along links, distrust from the hosts of blocked pages against them. Both are held against the
    host's share of all pages: it is blocked if distrust / (trust + distrust + share) is above the threshold; one that
    distrust doesn't reach is allowed, as is the empty host of null urls. Null html has no links. Repeated rows each give a row, and count as a page each. An empty table gives an
    empty result; other columns are ignored."""
    keep = Written(pages.sparkSession)
    host, path = split_url(F.col("url"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    judged = keep(rows.drop("html").withColumn("rule", text).withColumn("by_rule", verdict), "judged")
    edges = keep(host_edges(rows), "edges")
    seeds = keep(judged.where("by_rule IS NOT NULL AND host <> ''").groupBy(F.col("by_rule").alias("kind"), "host").agg(F.count("*").cast("double").alias("mass")), "seeds")
    forth = edges.select(F.lit("allow").alias("kind"), "src", "dst", "w")
    back = edges.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    ranks = propagated(forth.unionByName(back), seeds, keep)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    ranks = ranks.groupBy("host").agg(of("allow").alias("t"), of("block").alias("d"))
    own = judged.groupBy("host").agg(F.count("*").alias("n"))
    part = F.round(F.col("d") / (F.col("t") + F.col("d") + F.col("n") / F.lit(max(1, judged.count()))), 9)  # so that the order of sums doesn't matter
    hosts = ranks.join(own, "host").select("host", F.when(part > threshold, "block").otherwise("allow").alias("by_links"))
    hosts = keep(hosts, "hosts")
    keep.only("judged", "hosts")
    out = judged.join(hosts, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_links", F.lit("allow")).alias("verdict"))
