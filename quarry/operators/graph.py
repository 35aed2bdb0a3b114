"""Property graphs over tables: traversals, paths, neighbours, degrees and communities.

Edges are (src, dst, type, weight, ...). A traversal is a few joins, one for each hop;
edges are filtered before, and rows that repeat a (source, node, step) are dropped after
each hop, so that a frontier has at most sources x nodes rows and not one for each path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.recursive import kept
from quarry.operators.tables import upsert


@dataclass(frozen=True)
class Hop:
    """A band of a pattern: an edge type (None: any), a direction (out, in or both), least and
    most steps (most None: until nothing is new), and a condition on edges."""

    kind: str | None = None
    direction: str = "out"
    least: int = 1
    most: int | None = 1
    condition: Column | None = None


def swapped(edges: DataFrame) -> DataFrame:
    """Edges the other way round, columns in the same order."""
    other = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    return edges.select(*(other.get(c, F.col(c)) for c in edges.columns))


def oriented(edges: DataFrame, hop: Hop, undirected: frozenset[str] = frozenset()) -> DataFrame:
    """Edges as the hop may walk them; those of undirected types go both ways always."""
    own = edges if hop.kind is None else edges.filter(F.col("type") == hop.kind)
    if hop.condition is not None:
        own = own.filter(hop.condition)
    back = swapped(own)
    if hop.direction == "both" or hop.kind in undirected:
        return own.unionAll(back)
    if hop.direction == "out":
        out = own
        if undirected and hop.kind is None:
            out = own.unionAll(back.filter(F.col("type").isin(sorted(undirected))))
        return out
    if hop.direction != "in":
        raise ValueError(f"unknown direction: {hop.direction!r}")
    return back.unionAll(own.filter(F.col("type").isin(sorted(undirected)))) if undirected and hop.kind is None else back


def check_types(hops: list[Hop], known: frozenset[str]) -> None:
    for hop in hops:
        if hop.kind is not None and hop.kind not in known:
            raise ValueError(f"unknown edge type: {hop.kind!r}")


def traverse(seeds: DataFrame, edges: DataFrame, hops: list[Hop], undirected: frozenset[str] = frozenset(), include_intermediate: bool = False) -> DataFrame:
    """(source, node, steps): nodes at the pattern's end for each seed, with the least number
    of steps of its last band. seeds: a column `id`. include_intermediate: ends of earlier
    bands too, with their `band`."""
    ends = seeds.select(F.col("id").alias("source"), F.col("id").alias("node")).distinct()
    found = []
    for band, hop in enumerate(hops):
        ends = _band(ends, oriented(edges, hop, undirected).select("src", "dst"), hop)
        found.append(ends.withColumn("band", F.lit(band)))
        ends = ends.select("source", "node", "steps")
    if include_intermediate:
        out = found[0]
        for f in found[1:]:
            out = out.unionAll(f)
        return out
    return ends


def _band(starts: DataFrame, edges: DataFrame, hop: Hop) -> DataFrame:
    frontier = starts.select("source", "node").distinct()
    out = frontier.withColumn("steps", F.lit(0)) if hop.least == 0 else None
    seen, step = (out, 0)
    while hop.most is None or step < hop.most:
        step += 1
        frontier = frontier.join(edges, frontier["node"] == edges["src"]).select("source", F.col("dst").alias("node")).distinct()
        if step >= hop.least:
            if hop.most is None and seen is not None:  # only what is new goes on
                frontier = frontier.join(seen.select("source", "node"), ["source", "node"], "left_anti")
            if hop.most is None or step % 4 == 0:
                frontier = kept(frontier)
            if hop.most is None and frontier.isEmpty():
                break
            own = frontier.withColumn("steps", F.lit(step))
            out = own if out is None else out.unionAll(own)
            seen = out if hop.most is None else None
    return out.groupBy("source", "node").agg(F.min("steps").alias("steps"))


def bfs(seeds: DataFrame, edges: DataFrame, depth: int | None, direction: str = "out") -> DataFrame:
    """(source, node, depth): all nodes within a depth, the seed itself with 0. A node goes
    on once, from where it was first met."""
    walk = oriented(edges, Hop(direction=direction)).select("src", "dst")
    frontier = kept(seeds.select(F.col("id").alias("source"), F.col("id").alias("node")).distinct().withColumn("depth", F.lit(0)))
    seen, step = [frontier], 0
    while depth is None or step < depth:
        step += 1
        new = frontier.join(walk, frontier["node"] == walk["src"]).select("source", F.col("dst").alias("node")).distinct()
        for s in seen:
            new = new.join(s, ["source", "node"], "left_anti")
        frontier = kept(new.withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            break
        seen.append(frontier)
    out = seen[0]
    for s in seen[1:]:
        out = out.unionAll(s)
    return out


def shortest_paths(seeds: DataFrame, edges: DataFrame, hop: Hop, undirected: frozenset[str] = frozenset()) -> DataFrame:
    """(source, target, path): one shortest path to each node, with nodes, edge types and
    weights hop by hop; of equally short ones the first by its nodes and types. hop.most
    must be given."""
    if hop.most is None:
        raise ValueError("a shortest path needs a bound on its steps")
    walk = oriented(edges, hop, undirected).select("src", "dst", "type", F.col("weight").cast("float").alias("weight"))
    path = F.struct(F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edge_types"), F.array().cast("array<float>").alias("edge_weights"))
    frontier = seeds.select(F.col("id").alias("source"), F.col("id").alias("target"), path.alias("path"))
    out = frontier.limit(0)
    for step in range(1, hop.most + 1):
        grown = frontier.join(walk, frontier["target"] == walk["src"]).select(
            "source",
            F.col("dst").alias("target"),
            F.struct(
                F.array_append("path.nodes", F.col("dst")).alias("nodes"),
                F.array_append("path.edge_types", F.col("type")).alias("edge_types"),
                F.array_append("path.edge_weights", F.col("weight")).alias("edge_weights"),
            ).alias("path"),
        )
        new = grown.groupBy("source", "target").agg(F.min("path").alias("path"))
        new = new.join(out.select("source", "target"), ["source", "target"], "left_anti")
        frontier = kept(new) if step < hop.most else new
        if step >= hop.least:
            out = out.unionAll(frontier)
    return out


def paths(seeds: DataFrame, edges: DataFrame, hops: list[Hop], undirected: frozenset[str] = frozenset()) -> DataFrame:
    """(source, node, path): each path of a pattern of single edges, with its nodes, edge
    types and weights in order. There is a row for each path, not for each end."""
    start = F.struct(F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edge_types"), F.array().cast("array<double>").alias("edge_weights"))
    rows = seeds.select(F.col("id").alias("source"), F.col("id").alias("node"), start.alias("path"))
    for hop in hops:
        if (hop.least, hop.most) != (1, 1):
            raise ValueError("paths are of single edges; shortest_paths has bands of several steps")
        walk = oriented(edges, hop, undirected).select("src", "dst", "type", "weight")
        grown = F.struct(F.array_append("path.nodes", F.col("dst")).alias("nodes"), F.array_append("path.edge_types", F.col("type")).alias("edge_types"), F.array_append("path.edge_weights", F.col("weight")).alias("edge_weights"))
        rows = rows.join(walk, rows["node"] == walk["src"]).select("source", F.col("dst").alias("node"), grown.alias("path"))
    return rows


def neighbours(edges: DataFrame, ids: DataFrame, direction: str = "out", kind: str | None = None) -> DataFrame:
    walk = oriented(edges, Hop(kind, direction))
    return walk.join(ids.select(F.col("id").alias("src")), "src", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in)."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def centrality(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, centrality): incoming edges over the largest number of them, 0 without any."""
    n = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("most"))
    return vertices.select("id").join(n, "id", "left").crossJoin(F.broadcast(most)).select("id", F.coalesce(F.col("n") / F.col("most"), F.lit(0.0)).alias("centrality"))


def statistics(edges: DataFrame) -> DataFrame:
    """Edges and distinct ends for each type."""
    return edges.groupBy("type").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"), F.avg("weight").alias("mean_weight"))


def common_neighbours(edges: DataFrame, origin: str, kind: str | None = None, candidates: int | None = None, evidence: int | None = None) -> DataFrame:
    """(candidate_id, evidence_id, edge_type, shared_count) for nodes that share targets with
    the origin, itself included; the best candidates by shared count, and for each the
    first evidence."""
    own = edges if kind is None else edges.filter(F.col("type") == kind)
    shared = own.filter(F.col("src") == origin).select(F.col("dst").alias("evidence_id"), F.col("type").alias("edge_type")).distinct()
    rows = own.select(F.col("src").alias("candidate_id"), F.col("dst").alias("evidence_id"), F.col("type").alias("edge_type")).distinct().join(shared, ["evidence_id", "edge_type"])
    counts = rows.groupBy("candidate_id").agg(F.countDistinct("evidence_id").alias("shared_count"))
    if candidates is not None:
        counts = counts.orderBy(F.desc("shared_count"), "candidate_id").limit(candidates)
    out = rows.join(counts, "candidate_id")
    if evidence is not None:
        first = Window.partitionBy("candidate_id").orderBy("evidence_id", "edge_type")
        out = out.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= evidence).drop("_n")
    return out.select("candidate_id", "evidence_id", "edge_type", "shared_count")


def delete_vertices(vertices: DataFrame, edges: DataFrame, ids: DataFrame, detach: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges without the given ids; without detach it is an error that one has edges."""
    ends = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").unionByName(edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi"))
    if not detach and not ends.isEmpty():
        raise ValueError("a vertex has edges: detach it, or delete these first")
    rest = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return vertices.join(ids.select("id"), "id", "left_anti"), rest


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by (src, dst, type), new ones in place of old ones."""
    return edges.join(new.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti").select(new.columns).unionAll(new)


def merge_vertices(vertices: DataFrame, new: DataFrame, on_create: dict[str, Column] | None = None, on_match: dict[str, Column] | None = None) -> DataFrame:
    """Vertices by id, with new ones added. on_create: columns of added ones; on_match: columns
    of those that are there, with old.x and excluded.x for both sides' columns."""
    return upsert(vertices, new.withColumns(on_create or {}), ["id"], on_match or {})
