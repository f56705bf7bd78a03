"""Connected components as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earnlens.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """``links`` (``a, b``) to ``v, component`` for every linked vertex, where
    ``component`` is the smallest vertex reachable.

    Each round maps a vertex to its smallest neighbour (or itself), follows
    the map once more, and contracts the edges; the number of rounds grows
    with the logarithm of a path's length. A vertex of very many links costs
    one pre-aggregated minimum. Edges and labels are stages of the shared
    folder, so a lost executor never restarts earlier rounds.
    """
    one = links.where("a <> b").select("a", "b")
    edges = stage(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = None
    while edges.limit(1).count():
        low = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p"))
        low = stage(low, "cc-low")
        up = low.select(F.col("v").alias("p"), F.col("p").alias("q"))
        jump = stage(low.join(up, "p").select("v", F.col("q").alias("to")), "cc-jump")
        if labels is None:
            labels = jump.select("v", F.col("to").alias("component"))
        else:
            at = jump.select(F.col("v").alias("component"), "to")
            labels = labels.join(at, "component", "left").select("v", F.coalesce("to", "component").alias("component"))
        labels = stage(labels, "cc-labels")
        ja = jump.select(F.col("v").alias("a"), F.col("to").alias("ta"))
        jb = jump.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        edges = stage(edges.join(ja, "a").join(jb, "b").where("ta <> tb")
                      .select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "cc-edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return labels
