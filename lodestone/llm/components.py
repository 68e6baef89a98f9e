"""Connected components by alternating star contraction, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.chunks import checkpoint


#: A node is a hub with more than one in SHARE of the edges, and with more than LEAST: then there are at most 2 SHARE hubs.
SHARE, LEAST = 1000, 500


def _with_least(edges: DataFrame, key: str, low: DataFrame, limit: int, most: int) -> DataFrame:
    """edges (a, b) with m, the least that low (id, m, n) has for the node in their column ``key``; n: how many edges have it
    there, ``most`` at most. The few hubs, those with more than ``limit``, whose number is bounded, are broadcast, and their
    edges go to the tasks of the other end; so no task gets all edges of one."""
    if most <= limit:
        return edges.join(low.select(F.col("id").alias(key), "m").hint("merge"), key).select("a", "b", "m")
    hubs = low.where(F.col("n") > limit).select(F.col("id").alias(key), F.col("m").alias("of_hub"))
    tagged = edges.join(F.broadcast(hubs), key, "left").withColumn("at", F.when(F.col("of_hub").isNull(), F.col(key)).otherwise(F.col("b" if key == "a" else "a")))
    joined = tagged.join(low.select(F.col("id").alias("at"), "m").hint("merge"), "at", "left")
    return joined.select("a", "b", F.coalesce("of_hub", "m").alias("m"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every node of edges (a, b): the smallest node that it can reach.

    Large-star and small-star steps (Kiveris et al. 2014): each ties nodes to the least of their neighbours; the
    number of edges never grows, and a few rounds suffice for long chains. Edges are kept from the larger end (a) to the
    smaller (b) and never doubled: a node's least neighbour is the least b of its own edges, as all others are larger. Least
    neighbours are found by partial aggregation and joined back once a step, for hubs by broadcast, so a node with very many
    neighbours isn't gathered in one task. Every step is checkpointed, so that no step is computed twice; the driver sees only
    counts. It ends when every node has one edge or only edges from such nodes; a round in which no node has two smaller
    neighbours needs no small star. Plans are not adapted meanwhile, as each of the many steps would be told to listeners anew.
    Null ends and loops are left out; an edge list may hold repeats. Raises if ``rounds`` don't suffice, which would mean an
    error here.
    """
    spark = edges.sparkSession
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    at = checkpoint(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a is not null and b is not null and a != b").distinct())
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for _ in range(rounds):
            ends = at.select(F.col("a").alias("id"), "b", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(at.select(F.col("b").alias("id"), F.lit(None).cast("long").alias("b"), F.lit(0).alias("up"), F.lit(1).alias("down")))
            nodes = ends.groupBy("id").agg(F.min("b").alias("m"), F.sum("up").alias("up"), F.sum("down").alias("down"))
            total, up, down, chained = nodes.agg(F.sum("up"), F.max("up"), F.max("down"), F.max((F.col("up") > 0) & (F.col("down") > 0))).first()
            if not total or up == 1 and not chained:
                break
            limit = max(LEAST, total // SHARE)
            # large star: every larger neighbour of a node is tied to the least of the node and its neighbours
            low = nodes.where("down > 0").select("id", F.coalesce("m", "id").alias("m"), F.col("down").alias("n"))
            large = _with_least(at, "b", low, limit, down).select("a", F.col("m").alias("b"))
            if up == 1:
                at = checkpoint(large)
                continue
            at = checkpoint(large.distinct())
            # small star: a node and its smaller neighbours are tied to the least of these
            low = at.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
            tied = _with_least(at, "a", low, limit, up).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            at = checkpoint(tied.unionByName(low.select(F.col("id").alias("a"), F.col("m").alias("b"))).distinct())
        else:
            raise RuntimeError("components did not settle")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    roots = at.select(F.col("b").alias("a"), "b").distinct()
    return at.unionByName(roots).select(F.col("a").alias("id"), F.col("b").alias("component"))
