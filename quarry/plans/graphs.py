"""Graph queries over edges made of the tables: PLACED customer to order, CONTAINS order to
part (weight: quantity), SUPPLIED_BY part to supplier, IN_NATION and IN_REGION."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.operators.communities import communities
from quarry.operators.graph import Hop
from quarry.sources.tables import read

TYPES = frozenset({"PLACED", "CONTAINS", "SUPPLIED_BY", "IN_NATION", "IN_REGION"})


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, type, weight); ids have the kind of their node before them."""

    def edge(table: str, src: str, a: str, dst: str, b: str, kind: str, weight=None) -> DataFrame:
        w = F.lit(1.0) if weight is None else F.col(weight)
        return read(spark, folder, table).select(F.concat(F.lit(a), F.col(src).cast("string")).alias("src"), F.concat(F.lit(b), F.col(dst).cast("string")).alias("dst"), F.lit(kind).alias("type"), w.cast("double").alias("weight"))

    out = edge("orders", "o_custkey", "c", "o_orderkey", "o", "PLACED")
    out = out.unionAll(edge("lineitem", "l_orderkey", "o", "l_partkey", "p", "CONTAINS", "l_quantity"))
    out = out.unionAll(edge("lineitem", "l_partkey", "p", "l_suppkey", "s", "SUPPLIED_BY").distinct())
    out = out.unionAll(edge("customer", "c_custkey", "c", "c_nationkey", "n", "IN_NATION")).unionAll(edge("supplier", "s_suppkey", "s", "s_nationkey", "n", "IN_NATION"))
    return out.unionAll(edge("nation", "n_nationkey", "n", "n_regionkey", "r", "IN_REGION"))


def seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def graph_1hop(spark: SparkSession, folder: str) -> DataFrame:
    return graph.neighbours(edges(spark, folder), seeds(spark, "c1", "c2"), kind="PLACED").select("src", "dst", "type", "weight")


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    e = edges(spark, folder)
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().groupBy(F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


def graph_pattern(spark: SparkSession, folder: str) -> DataFrame:
    """(c)-[:PLACED]->(o)-[:CONTAINS {weight > 25}]->(p)-[:SUPPLIED_BY]->(s), last nodes."""
    hops = [Hop("PLACED"), Hop("CONTAINS", condition=F.col("weight") > 25), Hop("SUPPLIED_BY")]
    graph.check_types(hops, TYPES)
    return graph.traverse(seeds(spark, "c1", "c7", "c40"), edges(spark, folder), hops).select("source", "node")


def graph_variable(spark: SparkSession, folder: str) -> DataFrame:
    """(o)-[*1..3]->(x) with the least number of steps."""
    return graph.traverse(seeds(spark, "o1", "o2"), edges(spark, folder), [Hop(None, "out", 1, 3)]).select("source", "node", "steps")


def graph_unbounded(spark: SparkSession, folder: str) -> DataFrame:
    return graph.traverse(seeds(spark, "p5", "s3"), edges(spark, folder), [Hop(None, "out", 1, None)]).select("source", "node", "steps")


def graph_both_ways(spark: SparkSession, folder: str) -> DataFrame:
    return graph.traverse(seeds(spark, "n3"), edges(spark, folder), [Hop("IN_NATION", "in"), Hop("SUPPLIED_BY", "in")]).select("source", "node")


def graph_bfs(spark: SparkSession, folder: str) -> DataFrame:
    own = edges(spark, folder).filter("type in ('SUPPLIED_BY', 'IN_NATION', 'IN_REGION')")
    return graph.bfs(seeds(spark, "s1"), own, 3, "both").select("source", "node", "depth")


def graph_exists(spark: SparkSession, folder: str) -> DataFrame:
    """Customers that placed an order with more than 49 of a part."""
    found = edges(spark, folder).filter("type = 'CONTAINS' and weight > 49")
    placed = edges(spark, folder).filter("type = 'PLACED'").join(found.select(F.col("src").alias("dst")), "dst", "left_semi")
    return read(spark, folder, "customer").withColumn("id", F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).join(placed.select(F.col("src").alias("id")), "id", "left_semi").select("c_custkey")


def optional_match(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer of a nation with its large orders, or null."""
    own = read(spark, folder, "customer").filter("c_nationkey = 4").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    large = read(spark, folder, "orders").filter("o_totalprice > 400000").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    ends = graph.traverse(own.select("id"), edges(spark, folder), [Hop("PLACED")]).join(large, "node", "left_semi")
    return own.join(ends.select(F.col("source").alias("id"), "node"), "id", "left").select("c_custkey", "node")


def common_neighbour(spark: SparkSession, folder: str) -> DataFrame:
    """The suppliers with the most parts in common with s1."""
    parts = graph.swapped(edges(spark, folder).filter("type = 'SUPPLIED_BY'"))
    return graph.common_neighbours(parts, "s1", "SUPPLIED_BY", candidates=5, evidence=3)


def graph_centrality(spark: SparkSession, folder: str) -> DataFrame:
    own = edges(spark, folder).filter("type = 'IN_NATION'")
    vertices = read(spark, folder, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    return graph.centrality(own, vertices).select("id", F.round("centrality", 8).alias("centrality"))


def graph_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(edges(spark, folder).filter("type in ('IN_NATION', 'IN_REGION')"))


def graph_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return graph.statistics(edges(spark, folder)).withColumn("mean_weight", F.round("mean_weight", 4))


def shortest_path(spark: SparkSession, folder: str) -> DataFrame:
    own = edges(spark, folder).filter("type <> 'CONTAINS' and type <> 'PLACED'")
    found = graph.shortest_paths(seeds(spark, "p1", "p2"), own, Hop(None, "out", 1, 4))
    return found.select("source", "target", F.array_join("path.nodes", ">").alias("nodes"), F.array_join("path.edge_types", ">").alias("types"))


def graph_paths(spark: SparkSession, folder: str) -> DataFrame:
    """p = (s)-[:IN_NATION]->(n)-[:IN_REGION]->(r), with its nodes, types and length."""
    found = graph.paths(seeds(spark, "s1", "s2", "s3"), edges(spark, folder), [Hop("IN_NATION"), Hop("IN_REGION")])
    return found.select("source", F.array_join("path.nodes", ">").alias("nodes"), F.array_join("path.edge_types", ">").alias("types"), F.size("path.edge_types").cast("long").alias("length"))


def vertex_merge(spark: SparkSession, folder: str) -> DataFrame:
    """MERGE of a vertex that is there and of one that isn't, with what to set for each."""
    own = read(spark, folder, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit(1).cast("long").alias("visits"))
    new = spark.createDataFrame([("n3", "again"), ("n99", "fresh")], "id string, name string").withColumn("visits", F.lit(0).cast("long"))
    return graph.merge_vertices(own, new, {"visits": F.lit(10).cast("long")}, {"visits": F.col("old.visits") + 1})


def pattern_comprehension(spark: SparkSession, folder: str) -> DataFrame:
    """For each region its nations' ids in order, empty without any."""
    own = edges(spark, folder).filter("type = 'IN_REGION'").select(F.col("dst").alias("id"), F.col("src").alias("nation"))
    regions = read(spark, folder, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    rows = regions.join(own.filter("nation > 'n2'"), "id", "left").groupBy("id").agg(F.array_sort(F.collect_list("nation")).alias("nations"))
    return rows.select("id", F.array_join("nations", ",").alias("nations"), F.size("nations").cast("long").alias("n"))


def edge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    own = edges(spark, folder).filter("type = 'IN_REGION'")
    new = spark.createDataFrame([("n0", "r0", "IN_REGION", 9.0), ("n99", "r1", "IN_REGION", 2.0)], "src string, dst string, type string, weight double")
    return graph.upsert_edges(own, new)


def detach_delete(spark: SparkSession, folder: str) -> DataFrame:
    own = edges(spark, folder).filter("type in ('IN_REGION', 'IN_NATION')")
    vertices = read(spark, folder, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    _, rest = graph.delete_vertices(vertices, own, seeds(spark, "n1", "n2"), detach=True)
    return rest.groupBy("type").agg(F.count("*").alias("n"))


def _places(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers with their nations, and these with their regions, by weight."""
    own = edges(spark, folder).filter("type = 'IN_REGION' or type = 'IN_NATION' and src like 's%'")
    return own.select("src", "dst", "weight")


def leiden(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of suppliers, nations and regions."""
    return communities(_places(spark, folder))


def leiden_join(spark: SparkSession, folder: str) -> DataFrame:
    """Communities joined back to a table: suppliers' balances by community."""
    own = read(spark, folder, "supplier").withColumn("id", F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).join(leiden(spark, folder), "id")
    return own.groupBy("community").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


def graph_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregates over the ends of a traversal: customers' parts and what these weigh."""
    own = edges(spark, folder)
    ends = graph.traverse(read(spark, folder, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")), own, [Hop("PLACED"), Hop("CONTAINS")])
    sizes = read(spark, folder, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), "p_size")
    return ends.join(sizes, "node").groupBy("source").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


def graph_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(c:customer {segment: BUILDING})-[:PLACED]->(o:order {status: F}): labels and properties of nodes."""
    c = read(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    o = read(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.traverse(c, edges(spark, folder), [Hop("PLACED")]).join(o, "node", "left_semi").select("source", "node")


_E = """(SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'PLACED' AS type, 1.0::DOUBLE AS weight FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'CONTAINS', l_quantity FROM lineitem
  UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'SUPPLIED_BY', 1.0::DOUBLE FROM lineitem
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'IN_NATION', 1.0::DOUBLE FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'IN_NATION', 1.0::DOUBLE FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'IN_REGION', 1.0::DOUBLE FROM nation)"""
_WITH = f"WITH RECURSIVE e AS {_E}, "


def _walk(start: str, most: int, where: str = "true", both: bool = False) -> str:
    way = "f" if both else "e2"
    twice = "f AS (SELECT src, dst, type FROM e UNION ALL SELECT dst, src, type FROM e), " if both else ""
    return f"""{_WITH}{twice}e2 AS (SELECT * FROM e WHERE {where}),
      w AS (SELECT id AS source, id AS node, 0 AS steps FROM (VALUES {start}) v(id) UNION SELECT w.source, x.dst, w.steps + 1 FROM w JOIN {way} x ON x.src = w.node WHERE w.steps < {most} AND {where})"""


FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "graph_1hop": (graph_1hop, f"WITH e AS {_E} SELECT * FROM e WHERE type = 'PLACED' AND src IN ('c1', 'c2')"),
    "graph_nodes": (graph_nodes, f"WITH e AS {_E} SELECT substr(id, 1, 1) AS kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) t GROUP BY 1"),
    "graph_pattern": (
        graph_pattern,
        f"WITH e AS {_E} SELECT DISTINCT a.src AS source, c.dst AS node FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst WHERE a.src IN ('c1', 'c7', 'c40') AND a.type = 'PLACED' AND b.type = 'CONTAINS' AND b.weight > 25 AND c.type = 'SUPPLIED_BY'",
    ),
    "graph_variable": (graph_variable, _walk("('o1'), ('o2')", 3) + " SELECT source, node, min(steps) AS steps FROM w WHERE steps > 0 GROUP BY source, node"),
    "graph_unbounded": (graph_unbounded, _walk("('p5'), ('s3')", 9) + " SELECT source, node, min(steps) AS steps FROM w WHERE steps > 0 GROUP BY source, node"),
    "graph_both_ways": (graph_both_ways, f"WITH e AS {_E} SELECT DISTINCT 'n3' AS source, b.src AS node FROM e a JOIN e b ON b.dst = a.src WHERE a.dst = 'n3' AND a.type = 'IN_NATION' AND b.type = 'SUPPLIED_BY'"),
    "graph_bfs": (graph_bfs, _walk("('s1')", 3, "x.type IN ('SUPPLIED_BY', 'IN_NATION', 'IN_REGION')", True).replace("e2 AS (SELECT * FROM e WHERE x.type IN ('SUPPLIED_BY', 'IN_NATION', 'IN_REGION')),", "") + " SELECT source, node, min(steps) AS depth FROM w GROUP BY source, node"),
    "graph_exists": (graph_exists, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 49)"),
    "optional_match": (optional_match, "SELECT c_custkey, 'o' || o_orderkey AS node FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON o_custkey = c_custkey WHERE c_nationkey = 4"),
    "common_neighbour": (
        common_neighbour,
        f"""WITH e AS {_E}, x AS (SELECT dst AS s, src AS p FROM e WHERE type = 'SUPPLIED_BY'),
          c AS (SELECT x.s AS candidate_id, x.p AS evidence_id FROM x JOIN x o ON o.p = x.p AND o.s = 's1'),
          n AS (SELECT candidate_id, count(*) AS shared_count FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
          SELECT candidate_id, evidence_id, 'SUPPLIED_BY' AS edge_type, CAST(shared_count AS BIGINT) AS shared_count FROM c JOIN n USING (candidate_id)
          QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY evidence_id) <= 3""",
    ),
    "graph_centrality": (
        graph_centrality,
        f"""WITH e AS {_E}, d AS (SELECT dst, count(*) AS n FROM e WHERE type = 'IN_NATION' GROUP BY dst)
          SELECT 'n' || n_nationkey AS id, round(coalesce(n / (SELECT max(n) FROM d), 0), 8) AS centrality FROM nation LEFT JOIN d ON dst = 'n' || n_nationkey""",
    ),
    "graph_degrees": (graph_degrees, f"WITH e AS (SELECT * FROM {_E} e WHERE type IN ('IN_NATION', 'IN_REGION')) SELECT id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) t GROUP BY id"),
    "graph_statistics": (graph_statistics, f"WITH e AS {_E} SELECT type, CAST(count(*) AS BIGINT) AS edges, CAST(count(DISTINCT src) AS BIGINT) AS sources, CAST(count(DISTINCT dst) AS BIGINT) AS targets, round(avg(weight), 4) AS mean_weight FROM e GROUP BY type"),
    "shortest_path": (
        shortest_path,
        f"""{_WITH}g AS (SELECT * FROM e WHERE type NOT IN ('CONTAINS', 'PLACED')),
          w AS (SELECT id AS source, id AS target, [id] AS nodes, CAST([] AS VARCHAR[]) AS types FROM (VALUES ('p1'), ('p2')) v(id)
            UNION ALL SELECT w.source, g.dst, list_append(nodes, g.dst), list_append(types, g.type) FROM w JOIN g ON g.src = w.target WHERE len(types) < 4)
          SELECT source, target, array_to_string(nodes, '>') AS nodes, array_to_string(types, '>') AS types FROM w WHERE len(types) > 0
          QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY len(types), nodes, types) = 1""",
    ),
    "pattern_comprehension": (
        pattern_comprehension,
        "SELECT 'r' || r_regionkey AS id, coalesce(string_agg(n, ',' ORDER BY n), '') AS nations, CAST(count(n) AS BIGINT) AS n FROM region LEFT JOIN (SELECT 'n' || n_nationkey AS n, n_regionkey FROM nation) x ON n_regionkey = r_regionkey AND n > 'n2' GROUP BY 1",
    ),
    "graph_paths": (
        graph_paths,
        "SELECT 's' || s_suppkey AS source, 's' || s_suppkey || '>n' || s_nationkey || '>r' || n_regionkey AS nodes, 'IN_NATION>IN_REGION' AS types, CAST(2 AS BIGINT) AS length FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (1, 2, 3)",
    ),
    "vertex_merge": (vertex_merge, "SELECT 'n' || n_nationkey AS id, n_name AS name, CAST(CASE WHEN n_nationkey = 3 THEN 2 ELSE 1 END AS BIGINT) AS visits FROM nation UNION ALL SELECT 'n99', 'fresh', 10"),
    "edge_upsert": (edge_upsert, "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'IN_REGION' AS type, CASE WHEN n_nationkey = 0 AND n_regionkey = 0 THEN 9.0 ELSE 1.0 END::DOUBLE AS weight FROM nation UNION ALL SELECT 'n99', 'r1', 'IN_REGION', 2.0::DOUBLE"),
    "detach_delete": (detach_delete, f"SELECT type, CAST(count(*) AS BIGINT) AS n FROM {_E} e WHERE type IN ('IN_REGION', 'IN_NATION') AND src NOT IN ('n1', 'n2') AND dst NOT IN ('n1', 'n2') GROUP BY type"),
    "leiden": (leiden, None),
    "leiden_join": (leiden_join, None),
    "graph_aggregate": (
        graph_aggregate,
        "SELECT 'c' || o_custkey AS source, CAST(count(*) AS BIGINT) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) t JOIN part ON p_partkey = l_partkey GROUP BY o_custkey",
    ),
    "graph_labels": (graph_labels, "SELECT 'c' || c_custkey AS source, 'o' || o_orderkey AS node FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: text for k, (_, text) in FRAMES.items() if text}
