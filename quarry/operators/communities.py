"""Communities by modularity: local moves, refinement into connected parts, aggregation.

Everything is a table and each step a few joins. In a round, nodes take the community of
the neighbour weight that gains most; a node moves only to a smaller community number in
odd rounds and to a larger one in even rounds, so that two nodes don't just swap. At the
end of a level each community is split into its connected parts, and parts are the next
level's nodes. A community's id is its smallest node id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.recursive import kept


def _symmetric(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst", "weight").unionAll(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def connected_parts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, part): the smallest id that links (src, dst, both ways) reach."""
    labels = kept(nodes.select("id", F.col("id").alias("part")))
    while True:
        near = links.join(labels.select(F.col("id").alias("dst"), F.col("part").alias("near")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("near").alias("near"))
        moved = labels.join(near, "id", "left").select("id", F.col("part").alias("old"), F.least("part", F.coalesce("near", "part")).alias("part"))
        jump = labels.select(F.col("id").alias("part"), F.col("part").alias("further"))
        after = kept(moved.join(jump, "part", "left").select("id", "old", F.least("part", F.coalesce("further", "part")).alias("part")))
        labels = after.select("id", "part")
        if after.filter("old <> part").isEmpty():
            return labels


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of communities (id, community) over edges taken both ways."""
    both = _symmetric(edges)
    total = both.agg(F.sum("weight")).first()[0] or 1.0
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("a")), labels.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    inside = both.join(a, "src").join(b, "dst").filter("a = b").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    squares = both.join(a, "src").groupBy("a").agg(F.sum("weight").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
    return inside / total - resolution * squares / total / total


def communities(edges: DataFrame, resolution: float = 1.0, levels: int = 2, rounds: int = 8) -> DataFrame:
    """(id, community) for the ends of edges (src, dst, weight)."""
    graph = kept(_symmetric(edges))
    total = graph.agg(F.sum("weight")).first()[0] or 1.0
    members = kept(graph.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("node")))
    for _ in range(levels):
        strength = kept(graph.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")))
        labels = kept(strength.select("id", F.col("id").alias("community")))
        for r in range(rounds):
            mass = labels.join(strength, "id").groupBy("community").agg(F.sum("k").alias("mass"))
            to = graph.filter("src <> dst").join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("weight").alias("w"))
            own = labels.withColumnRenamed("community", "now").join(strength, "id")
            offers = to.join(own, "id").join(mass, "community")
            less = F.when(F.col("community") == F.col("now"), F.col("k")).otherwise(0.0)
            gain = F.col("w") - resolution * F.col("k") * (F.col("mass") - less) / total
            stay = own.join(mass.withColumnRenamed("community", "now"), "now").select("id", F.col("now").alias("community"), (-resolution * F.col("k") * (F.col("mass") - F.col("k")) / total).alias("gain"), "now")
            ranked = offers.select("id", "community", gain.alias("gain"), "now").unionByName(stay)
            best = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("gain", 9)), "community"))).filter("_n = 1")
            allowed = (F.col("community") < F.col("now")) if r % 2 == 0 else (F.col("community") > F.col("now"))
            moved = kept(best.select("id", F.when(allowed, F.col("community")).otherwise(F.col("now")).alias("community"), "now"))
            labels = moved.select("id", "community")
            if r and moved.filter("community <> now").isEmpty():
                break
        # refinement: parts of a community that its own edges connect
        a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("a")), labels.select(F.col("id").alias("dst"), F.col("community").alias("b"))
        inside = kept(graph.filter("src <> dst").join(a, "src").join(b, "dst").filter("a = b").select("src", "dst"))
        parts = connected_parts(labels, inside)
        members = kept(members.join(parts.select(F.col("id").alias("node"), "part"), "node").select("id", F.col("part").alias("node")))
        graph = kept(
            graph.join(parts.select(F.col("id").alias("src"), F.col("part").alias("s")), "src")
            .join(parts.select(F.col("id").alias("dst"), F.col("part").alias("d")), "dst")
            .groupBy(F.col("s").alias("src"), F.col("d").alias("dst"))
            .agg(F.sum("weight").alias("weight"))
        )
    smallest = members.groupBy("node").agg(F.min("id").alias("community"))
    return members.join(smallest, "node").select("id", "community")
