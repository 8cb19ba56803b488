"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def components(links: DataFrame, keep: Written) -> DataFrame:
    """(node, component) for every end of links(a long, b long); the component is its smallest node.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the hooks to their ends by doubling,
    and goes on with the links between the ends. At least half the nodes of a component are gone after a round, so rounds
    and doublings are logarithmic. Hubs only ever meet minima that are taken before the shuffle, and joins that can split."""
    both = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    since = keep.n
    edges, labels = keep(both, "edges"), None
    while not edges.isEmpty():
        hooks = keep(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("top")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("top"), F.col("top").alias("next"))
            further = keep(hooks.join(up, "top").select("node", F.col("next").alias("top"), (F.col("next") != F.col("top")).alias("moved")), "hooks")
            still = not further.where("moved").isEmpty()
            hooks = further.select("node", "top")
            if not still:
                break
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("top"), F.col("top").alias("next"))
            labels = keep(labels.join(up, "top", "left").select("node", F.coalesce("next", "top").alias("top")), "labels")
        a, b = hooks.toDF("a", "ta"), hooks.toDF("b", "tb")
        edges = keep(edges.join(a, "a").join(b, "b").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "edges")
    found = keep(edges.toDF("node", "top") if labels is None else labels, "components").toDF("node", "component")
    keep.only("components", since=since)
    return found
