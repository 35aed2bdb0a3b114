"""Projection, filter, join, aggregation, window, sort, set and recursive queries.

SAME holds texts that mean the same to Spark and to the checking engine; PAIRS those that
have to be put differently, with Spark's text first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.aggregates import array_agg
from quarry.operators.filters import Query, parse_value, where
from quarry.operators.recursive import closure
from quarry.operators.retrieval import global_rank
from quarry.sources.tables import read, sql

SAME = {
    # scans and predicates
    "scan_full": "SELECT * FROM nation",
    "point_lookup": "SELECT * FROM orders WHERE o_orderkey = 4242",
    "key_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderkey < 180 ORDER BY o_orderkey DESC",
    "rowless": "SELECT 1 + 2 AS three, CASE WHEN 2 > 1 THEN 'yes' ELSE 'no' END AS answer",
    "filter_project": """
        SELECT o_orderkey AS id, o_totalprice * 0.9 AS reduced, o_orderpriority AS priority FROM orders
        WHERE o_totalprice BETWEEN 50000 AND 150000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT (o_orderstatus = 'F')
          AND o_orderpriority LIKE '%-_RG%' AND o_custkey IS NOT NULL""",
    "predicates_null": """
        SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer
        WHERE (CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END) IS NULL OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""",
    "ilike": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' AND p_size NOT BETWEEN 10 AND 40",
    "nullif_case_cast": """
        SELECT p_partkey, NULLIF(p_size, 1) AS size_or_null, CAST(floor(p_retailprice) AS BIGINT) AS whole, CAST(p_size AS DOUBLE) AS size_d,
               p_name || ':' || p_brand AS label FROM part""",
    "json_filter_scan": "SELECT event_id, event_type FROM events WHERE event_type = 'purchase' AND value > 20",
    # joins
    "join_inner": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_left": """
        SELECT c_custkey, o_orderkey FROM customer LEFT JOIN
          (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_totalprice > 300000) o ON c_custkey = o_custkey""",
    "join_right": """
        SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000) o
        RIGHT JOIN customer ON c_custkey = o_custkey""",
    "join_full": """
        SELECT a.c_custkey AS left_key, b.c_custkey AS right_key FROM (SELECT * FROM customer WHERE c_acctbal > 2000) a
        FULL OUTER JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') b ON a.c_custkey = b.c_custkey""",
    "join_cross": "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region",
    "join_theta": """
        SELECT a.p_partkey AS small, b.p_partkey AS large FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size < b.p_size
        WHERE a.p_brand = 'Brand#2' AND b.p_size > 45""",
    "join_literal_on": "SELECT n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey AND n_name < 'K' AND s_acctbal > 5000",
    "join_chain": """
        SELECT r_name, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_name""",
    "semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)",
    "anti_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')",
    "anti_not_in_null": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_acctbal < 0 THEN NULL ELSE s_nationkey END FROM supplier)",
    "exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)",
    "anti_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "scalar_subquery": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P') AS top FROM customer c",
    "derived_table": "SELECT seg, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_mktsegment AS seg FROM customer WHERE c_acctbal > 0) d GROUP BY seg",
    "cte_join": """
        WITH big AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey),
             rich AS (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000)
        SELECT c_custkey, c_name, n FROM rich JOIN big ON c_custkey = o_custkey""",
    # aggregation
    "agg_group_having": """
        SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(count(l_tax) AS BIGINT) AS n_tax, round(sum(l_quantity), 2) AS qty,
               round(avg(l_extendedprice), 2) AS avg_price, min(l_discount) AS low, max(l_discount) AS high
        FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""",
    "agg_scalar": "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders",
    "agg_empty": "SELECT CAST(count(*) AS BIGINT) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean FROM orders WHERE o_orderkey < 0",
    "agg_distinct": """
        SELECT o_orderpriority, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS sum_keys
        FROM orders GROUP BY o_orderpriority""",
    "agg_expression": "SELECT o_orderstatus, round(sum(o_totalprice) / count(*), 2) AS mean, CAST(max(o_orderkey) - min(o_orderkey) AS BIGINT) AS span FROM orders GROUP BY o_orderstatus",
    "agg_null_group": """
        SELECT seg, CAST(count(*) AS BIGINT) AS n, CAST(count(seg) AS BIGINT) AS n_seg
        FROM (SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer) t GROUP BY seg""",
    "percentile_cont": """
        SELECT o_orderpriority, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS median,
               round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90
        FROM orders GROUP BY o_orderpriority""",
    "percentile_disc": "SELECT o_orderpriority, percentile_disc(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS q1 FROM orders GROUP BY o_orderpriority",
    "mode": "SELECT mode() WITHIN GROUP (ORDER BY o_orderstatus) AS status FROM orders",
    "agg_rollup": """
        SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(grouping(o_orderpriority) AS BIGINT) AS is_total
        FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
    "agg_cube": "SELECT c_mktsegment, c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)",
    "agg_grouping_sets": "SELECT p_brand, p_type, CAST(max(p_size) AS BIGINT) AS largest FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())",
    # functions
    "functions_text": """
        SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_name) AS n, substr(p_name, 2, 4) AS part, replace(p_name, 'e', '') AS less, trim('  x ') AS bare,
               lpad(p_brand, 10, '*') AS padded, reverse(p_type) AS turned, split_part(p_name, ' ', 2) AS second, concat(p_brand, '/', p_type) AS both, repeat('ab', 2) AS twice FROM part""",
    "functions_math": """
        SELECT p_partkey, abs(-p_size) AS a, round(sqrt(p_size), 6) AS s, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(ln(p_size), 6) AS l, round(exp(p_size / 50.0), 6) AS e,
               round(power(p_size, 2), 2) AS p, CAST(sign(p_size - 25.0) AS INTEGER) AS g, greatest(p_size, 10) AS most, least(p_size, 10) AS fewest, coalesce(NULLIF(p_size, 3), 0) AS c0 FROM part""",
    "functions_date": """
        SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day, CAST(o_orderdate + INTERVAL 3 DAY AS DATE) AS later,
               EXTRACT(quarter FROM o_orderdate) AS q, last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders""",
    "functions_session": "SELECT current_database() IS NOT NULL AS db, current_schema() IS NOT NULL AS own_schema, version() IS NOT NULL AS release, now() IS NOT NULL AS at, current_date IS NOT NULL AS today",
    # windows
    "win_rank": """
        SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey)""",
    "win_peers": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders",
    "win_distribution": """
        SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 8) AS pr,
               round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 8) AS cd FROM orders""",
    "win_ntile": "SELECT o_orderkey, ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS tile FROM orders",
    "win_lag_lead": """
        SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey, 2) OVER w AS after_next, lag(o_totalprice, 1, 0.0) OVER w AS price_before
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "win_rows": """
        SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS near,
               CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS BIGINT) AS later FROM orders""",
    "win_range": """
        SELECT p_partkey, CAST(count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS close,
               max(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size) AS top_so_far FROM part""",
    "win_whole": "SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS nation_mean, min(c_acctbal) OVER (PARTITION BY c_nationkey) AS low FROM customer",
    "win_over_group": """
        SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS place
        FROM customer GROUP BY c_mktsegment""",
    "win_nulls": """
        SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY NULLIF(c_mktsegment, 'BUILDING') ASC NULLS FIRST, c_custkey) AS first_place,
               row_number() OVER (PARTITION BY c_nationkey ORDER BY NULLIF(c_mktsegment, 'BUILDING') DESC NULLS LAST, c_custkey) AS last_place FROM customer""",
    # order and limit
    "order_by": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT p_partkey, p_retailprice - p_size AS margin FROM part ORDER BY margin, p_partkey LIMIT 20 OFFSET 10",
    "limit_zero": "SELECT p_partkey FROM part LIMIT 0",
    "distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    # sets
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT p_size AS k FROM part EXCEPT SELECT n_nationkey FROM nation",
    "except_all": "SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT n_nationkey FROM nation",
    "cte": """
        WITH a AS (SELECT o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100), b AS (SELECT * FROM a WHERE o_custkey < 700)
        SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY o_custkey""",
    "recursive_cte": """
        WITH RECURSIVE chain AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS depth UNION ALL SELECT c.id + o.o_custkey % 7 + 1, c.depth + 1 FROM chain c JOIN orders o ON o.o_orderkey = c.id WHERE c.depth < 20)
        SELECT id, depth FROM chain""",
    "system_aggregate": "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT r_name FROM region UNION ALL SELECT n_name FROM nation) names",
}

#: Spark's text, the checking engine's text.
PAIRS = {
    "integer_division": (
        "SELECT o_orderkey, o_custkey DIV 7 AS q, o_custkey % 7 AS r, shiftleft(o_orderkey, 2) AS up, o_custkey >> 1 AS down FROM orders",
        "SELECT o_orderkey, CAST(o_custkey // 7 AS BIGINT) AS q, o_custkey % 7 AS r, o_orderkey << 2 AS up, o_custkey >> 1 AS down FROM orders",
    ),
    "join_lateral": (
        "SELECT c_custkey, o_orderkey, o_orderdate FROM customer c JOIN LATERAL (SELECT o_orderkey, o_orderdate FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)",
        "SELECT c_custkey, o_orderkey, o_orderdate FROM customer c, LATERAL (SELECT o_orderkey, o_orderdate FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) l",
    ),
    "functions_nested": (
        """SELECT p_partkey, size(split(p_name, ' ')) AS n, array_join(array_sort(split(p_name, ' ')), '+') AS sorted, array_contains(split(p_name, ' '), 'red') AS red, map('a', p_size)['a'] AS from_map,
           array_join(transform(split(p_name, ' '), x -> upper(x)), ' ') AS upped, size(filter(split(p_name, ' '), x -> length(x) > 4)) AS long FROM part""",
        """SELECT p_partkey, CAST(len(w) AS INTEGER) AS n, array_to_string(list_sort(w), '+') AS sorted, list_contains(w, 'red') AS red, p_size AS from_map,
           array_to_string(list_transform(w, lambda x: upper(x)), ' ') AS upped, CAST(len(list_filter(w, lambda x: len(x) > 4)) AS INTEGER) AS long FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)""",
    ),
    "string_agg": (
        "SELECT p_brand, listagg(p_name, ',') WITHIN GROUP (ORDER BY p_name, p_partkey) AS names FROM part WHERE p_size < 5 GROUP BY p_brand",
        "SELECT p_brand, string_agg(p_name, ',' ORDER BY p_name, p_partkey) AS names FROM part WHERE p_size < 5 GROUP BY p_brand",
    ),
}


def parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Named parameters, among them a list."""
    text = "SELECT o_orderkey, :mark AS mark FROM orders WHERE o_totalprice > :least AND array_contains(:kinds, o_orderpriority)"
    return sql(spark, folder, text, {"least": 480000.0, "kinds": F.array(F.lit("1-URGENT"), F.lit("5-LOW")), "mark": "p"})


def agg_parameter(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregates of parameters."""
    text = "SELECT o_orderstatus, CAST(sum(:step) AS BIGINT) AS total, max(:mark) AS mark, round(avg(o_totalprice * :rate), 4) AS mean FROM orders GROUP BY o_orderstatus"
    return sql(spark, folder, text, {"step": 3, "mark": "p", "rate": 0.5})


def filter_parser(spark: SparkSession, folder: str) -> DataFrame:
    """Conditions whose values come as text."""
    condition = where().gte("p_size", parse_value("45", "int")).eq("p_brand", parse_value("Brand#2")).contains_any("kinds", parse_value("[ECONOMY, STANDARD]", "string[]"))
    rows = read(spark, folder, "part").withColumn("kinds", F.array("p_type"))
    return Query(rows).where(condition).list().select("p_partkey", "p_size", "p_type")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """A listing in chunks of 400 rows by key: each chunk's number, first and last key."""
    rows = global_rank(read(spark, folder, "orders").select("o_orderkey"), [F.asc("o_orderkey")])
    return rows.groupBy(F.floor((F.col("place") - 1) / 400).alias("chunk")).agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.count("*").alias("n"))


def array_agg_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Elements in order, nulls kept; shown as text."""
    x = F.when(F.col("p_size") % 2 == 0, F.col("p_size"))
    found = read(spark, folder, "part").filter("p_size < 9").groupBy("p_brand").agg(array_agg(x, "p_partkey").alias("sizes"))
    return found.select("p_brand", F.array_join("sizes", ",", "-").alias("sizes"), F.size("sizes").cast("long").alias("n"))


def recursive_union(spark: SparkSession, folder: str) -> DataFrame:
    """A closure over a graph with cycles, which ends since rows don't repeat."""
    steps = read(spark, folder, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7 % 1499).alias("dst"))
    start = spark.range(1).select(F.lit(7).cast("long").alias("id"))
    return closure(start, lambda new: new.join(steps, new["id"] == steps["src"]).select(F.col("dst").alias("id")))


def filter_builder(spark: SparkSession, folder: str) -> DataFrame:
    """The fluent filter builder: nested and, or, not; strict bounds."""
    condition = where().eq("p_brand", "Brand#2").or_().gt("p_size", 45).between("p_retailprice", 900, 905).end().not_().eq("p_type", "ECONOMY").end()
    return Query(read(spark, folder, "part")).where(condition).list().select("p_partkey", "p_type", "p_size")


def filter_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Containment: any, all, and the same elements in any order."""
    words = read(spark, folder, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    flags = [
        where().contains_any("words", ["red", "blue"]).column().alias("any"),
        where().contains_all("words", ["red", "widget"]).column().alias("all"),
        where().exact_match("words", ["widget", "red"]).column().alias("exact"),
    ]
    return words.select("p_partkey", *flags)


def grouped_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Implicit grouping by what isn't an aggregate, then order, skip and limit."""
    orders = read(spark, folder, "orders")
    n = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return n.filter("n > 10").orderBy(F.desc("n"), "o_orderpriority", "o_orderstatus").offset(2).limit(5)


def rank_unordered(spark: SparkSession, folder: str) -> DataFrame:
    """RANK without an order is 1 for all rows."""
    everything = Window.partitionBy("n_regionkey")
    return read(spark, folder, "nation").select("n_nationkey", F.lit(1).alias("rk"), F.count("*").over(everything).alias("n"))


FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "agg_parameter": (agg_parameter, "SELECT o_orderstatus, CAST(sum(3) AS BIGINT) AS total, 'p' AS mark, round(avg(o_totalprice * 0.5), 4) AS mean FROM orders GROUP BY o_orderstatus"),
    "filter_parser": (filter_parser, "SELECT p_partkey, p_size, p_type FROM part WHERE p_size >= 45 AND p_brand = 'Brand#2' AND p_type IN ('ECONOMY', 'STANDARD')"),
    "chunks": (
        chunks,
        "SELECT CAST(chunk AS BIGINT) AS chunk, min(o_orderkey) AS first, max(o_orderkey) AS last, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 400 AS chunk FROM orders) t GROUP BY chunk",
    ),
    "parameters": (parameters, "SELECT o_orderkey, 'p' AS mark FROM orders WHERE o_totalprice > 480000.0 AND o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "array_agg_nulls": (
        array_agg_nulls,
        "SELECT p_brand, string_agg(CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '-' END, ',' ORDER BY p_partkey) AS sizes, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_size < 9 GROUP BY p_brand",
    ),
    "recursive_union": (
        recursive_union,
        "WITH RECURSIVE t AS (SELECT CAST(7 AS BIGINT) AS id UNION SELECT o.o_orderkey * 7 % 1499 FROM t JOIN orders o ON o.o_custkey = t.id) SELECT id FROM t",
    ),
    "filter_builder": (filter_builder, "SELECT p_partkey, p_type, p_size FROM part WHERE p_brand = 'Brand#2' AND (p_size > 45 OR p_retailprice BETWEEN 900 AND 905) AND NOT (p_type = 'ECONOMY')"),
    "filter_arrays": (
        filter_arrays,
        """SELECT p_partkey, list_has_any(w, ['red', 'blue']) AS "any", list_has_all(w, ['red', 'widget']) AS "all", list_sort(w) = ['red', 'widget'] AS exact
           FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""",
    ),
    "grouped_terms": (
        grouped_terms,
        "SELECT o_orderpriority, o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL HAVING count(*) > 10 ORDER BY n DESC, o_orderpriority, o_orderstatus LIMIT 5 OFFSET 2",
    ),
    "rank_unordered": (rank_unordered, "SELECT n_nationkey, 1 AS rk, CAST(count(*) OVER (PARTITION BY n_regionkey) AS BIGINT) AS n FROM nation"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    texts = SAME | {k: spark_text for k, (spark_text, _) in PAIRS.items()}
    return {k: (lambda spark, folder, text=v: sql(spark, folder, text)) for k, v in texts.items()} | {k: f for k, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return SAME | {k: other for k, (_, other) in PAIRS.items()} | {k: text for k, (_, text) in FRAMES.items()}
