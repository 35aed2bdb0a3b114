"""History, changes, catalogue, text files and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.operators import tables as t
from quarry.operators.recursive import shared_dir
from quarry.sources.files import copy_in, copy_out, export_json, markdown_lines
from quarry.sources.tables import NAMES, read
from quarry.streaming.ingest import files, ingest, ingest_state, latest, run_to_memory, run_to_table, sessions, windowed


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """Changes to customers: each order sets its customer's last status; commits are orders."""
    return read(spark, folder, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus", "o_totalprice", F.col("o_orderkey").alias("lsn"))


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").select(F.col("o_orderkey").alias("lsn"), (F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00")) + F.make_dt_interval(mins=F.col("o_orderkey").cast("int"))).alias("ts"))


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return t.history(_log(spark, folder), ["id"])


def as_of_lsn(spark: SparkSession, folder: str) -> DataFrame:
    return t.as_of(_history(spark, folder), 700).select("id", "o_orderstatus", "begin_lsn")


def as_of_time(spark: SparkSession, folder: str) -> DataFrame:
    lsn = t.lsn_at(_commits(spark, folder), F.to_timestamp_ntz(F.lit("2020-01-01 08:20:30")))
    return t.as_of(_history(spark, folder), lsn).select("id", "o_orderstatus", "begin_lsn")


def versions_of(spark: SparkSession, folder: str) -> DataFrame:
    at = lambda s: F.to_timestamp_ntz(F.lit(s))
    found = t.versions_between(_history(spark, folder), _commits(spark, folder), at("2020-01-01 05:00:00"), at("2020-01-01 06:00:00"))
    return found.select("id", "begin_lsn", "end_lsn", "version_start", "version_end")


def retention(spark: SparkSession, folder: str) -> DataFrame:
    return t.retain(_history(spark, folder), 900).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def history_commit(spark: SparkSession, folder: str) -> DataFrame:
    """One commit on top: a change, a new row and a deletion."""
    new = spark.createDataFrame([(1, "X", 1.0, False), (2, None, None, True), (999999, "N", 2.0, False)], "id long, o_orderstatus string, o_totalprice double, gone boolean")
    after = t.commit(_history(spark, folder), new, ["id"], 9_000_000, "gone")
    return after.filter("id in (1, 2, 999999)").select("id", "o_orderstatus", "begin_lsn", "end_lsn")


def vector_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """Scores over vectors that were current at a commit."""
    from quarry.functions.vectors import score
    from quarry.plans.retrieval import probe

    rows = read(spark, folder, "embeddings").join(t.as_of(_history(spark, folder), 700).select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    return rows.withColumn("score", score(F.col("embedding"), probe(spark, folder))).orderBy(F.desc("score"), "vec_id").limit(5).select("vec_id", F.round("score", 4).alias("score"))


def graph_at_lsn(spark: SparkSession, folder: str) -> DataFrame:
    """A traversal over the edges that were current at a commit: customers' last orders by
    then, and these orders' parts."""
    orders = t.as_of(_history(spark, folder), 700).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("begin_lsn").cast("string")).alias("dst"), F.lit("LAST").alias("type"))
    lines = read(spark, folder, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("CONTAINS").alias("type"))
    seeds = orders.select(F.col("src").alias("id")).distinct()
    return graph.traverse(seeds, orders.unionAll(lines), [graph.Hop("LAST"), graph.Hop("CONTAINS")]).select("source", "node")


def rrf_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """Fused ranks of two signals over rows that were current at a commit."""
    from quarry.functions.vectors import score
    from quarry.operators.retrieval import rank_fusion
    from quarry.plans.retrieval import probe

    now = t.as_of(_history(spark, folder), 700).select(F.col("id").alias("vec_id"), "o_totalprice")
    first = read(spark, folder, "embeddings").join(now, "vec_id", "left_semi").select("vec_id", F.round(score(F.col("embedding"), probe(spark, folder)), 4).alias("value"))
    return rank_fusion([first, now.select("vec_id", F.col("o_totalprice").alias("value"))], "vec_id").select("vec_id", F.round("score", 8).alias("score"))


def checked(spark: SparkSession, folder: str) -> DataFrame:
    """Constraints that hold: a check (null passes), no nulls, unique, and a reference."""
    own = read(spark, folder, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    own = t.check_unique(t.check_not_null(t.check(own, F.col("c_acctbal") > 0), "c_name"), "c_custkey")
    own = t.check_reference(own, t.ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)), read(spark, folder, "nation"))
    return own.select("c_custkey", "c_acctbal")


def compare_and_set(spark: SparkSession, folder: str) -> DataFrame:
    """A row changes if it has the version that was read."""
    rows = read(spark, folder, "supplier").select("s_suppkey", "s_acctbal", F.lit(1).cast("long").alias("version"))
    once = t.update_if_version(rows, F.col("s_suppkey") == 3, 1, {"s_acctbal": F.lit(1.5)})
    return t.update_if_version(once, F.col("s_suppkey") == 3, 2, {"s_acctbal": F.col("s_acctbal") * 2})


def overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Staged changes with save points: the second is rolled back, the third stays."""
    own = t.Overlay(read(spark, folder, "supplier").select("s_suppkey", "s_acctbal"), ["s_suppkey"])
    own.stage(lambda df: t.update(df, {"s_acctbal": F.lit(0.0)}, F.col("s_acctbal") < 0)).savepoint("clean")
    own.stage(lambda df: t.delete(df, F.col("s_suppkey") > 2)).rollback_to("clean")
    return own.stage(lambda df: t.delete(df, F.col("s_suppkey") == 1)).release("clean").current


def json_export(spark: SparkSession, folder: str) -> DataFrame:
    """Orders out as JSON lines and in again."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    own = read(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).alias("priority"), "o_totalprice")
    export_json(own, path)
    return spark.read.schema(own.schema).json(path)


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    own = read(spark, folder, "events").select("event_type", "user_id", "value", F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("at"))
    own.repartition(3, "user_id").write.parquet(base)
    return files(spark, base, own.schema, per_batch=3)


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by event type and hour of event time, from a stream."""
    rows = windowed(_event_stream(spark, folder), "at", "1 hour", "1 day", ["event_type"], F.count("*").alias("n"))
    found = run_to_memory(rows, f"windows_{uuid.uuid4().hex}")
    return found.select("event_type", F.unix_timestamp("window.start").alias("start"), "n")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Users' sessions, which half an hour without events ends, from a stream."""
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    found = run_to_table(sessions(_event_stream(spark, folder), "at", "30 minutes", "1 day", ["user_id"], F.count("*").alias("n")), f"{base}/out", f"{base}/checkpoint")
    return found.select("user_id", F.unix_timestamp("session.start").alias("start"), "n")


def stream_totals(spark: SparkSession, folder: str) -> DataFrame:
    """A running state for each user, kept by a function of our own: events and best value."""
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    ingest_state(_event_stream(spark, folder), f"{base}/out", f"{base}/checkpoint")
    return latest(spark.read.parquet(f"{base}/out"), ["user_id"]).select("user_id", "n", F.round("best", 4).alias("best"))


def catalogue_references(spark: SparkSession, folder: str) -> DataFrame:
    """What pg_constraint would tell of declared references, with whether each holds."""
    keys = {
        "nation": t.ForeignKey(("n_regionkey",), "region", ("r_regionkey",)), "customer": t.ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)), "supplier": t.ForeignKey(("s_nationkey",), "nation", ("n_nationkey",)),
        "orders": t.ForeignKey(("o_custkey",), "customer", ("c_custkey",)), "lineitem": t.ForeignKey(("l_orderkey",), "orders", ("o_orderkey",)),
    }
    out = []
    for name, fk in keys.items():
        own, parent = read(spark, folder, name), read(spark, folder, fk.parent)
        missing = own.join(parent, F.col(fk.columns[0]) == F.col(fk.parent_key[0]), "left_anti").agg(F.count("*").alias("n_missing"))
        out.append(missing.select(F.lit(name).alias("table_name"), F.lit(fk.columns[0]).alias("column_name"), F.lit(fk.parent).alias("parent"), "n_missing"))
    return reduce(DataFrame.unionAll, out)


def _new_customers(spark: SparkSession, folder: str) -> DataFrame:
    own = read(spark, folder, "customer")
    return own.filter("c_custkey < 10").withColumns({"c_custkey": F.col("c_custkey") + 1495, "c_acctbal": F.lit(0.5), "c_name": F.concat(F.lit("New"), F.col("c_custkey").cast("string"))})


def insert_nothing(spark: SparkSession, folder: str) -> DataFrame:
    return t.insert(read(spark, folder, "customer"), _new_customers(spark, folder), ["c_custkey"], "nothing").select("c_custkey", "c_name", "c_acctbal")


def upsert(spark: SparkSession, folder: str) -> DataFrame:
    own = t.upsert(read(spark, folder, "customer"), _new_customers(spark, folder), ["c_custkey"], {"c_name": F.col("excluded.c_name"), "c_acctbal": F.col("old.c_acctbal") + F.col("excluded.c_acctbal")}, F.col("old.c_acctbal") > 0)
    return own.select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


def update(spark: SparkSession, folder: str) -> DataFrame:
    changes = {"c_acctbal": F.col("c_acctbal") * 2, "c_mktsegment": F.when(F.col("c_acctbal") > 5000, "RICH").otherwise(F.col("c_mktsegment"))}
    return t.update(read(spark, folder, "customer"), changes, F.col("c_nationkey") == 4).select("c_custkey", "c_acctbal", "c_mktsegment")


def delete(spark: SparkSession, folder: str) -> DataFrame:
    return t.delete(read(spark, folder, "customer"), F.col("c_mktsegment") == "BUILDING").select("c_custkey")


def returning(spark: SparkSession, folder: str) -> DataFrame:
    before = read(spark, folder, "supplier")
    return t.returning(before, t.update(before, {"s_acctbal": F.lit(0.0)}, F.col("s_nationkey") < 3), ["s_suppkey"], ["s_suppkey", "s_acctbal"])


def fk_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """A nation goes: its customers with it, their orders and these orders' lines; its suppliers lose it."""
    own = {n: read(spark, folder, n) for n in ("nation", "customer", "supplier", "orders", "lineitem")}
    fk = t.ForeignKey
    keys = {
        "customer": [fk(("c_nationkey",), "nation", ("n_nationkey",), "cascade")],
        "supplier": [fk(("s_nationkey",), "nation", ("n_nationkey",), "set null")],
        "orders": [fk(("o_custkey",), "customer", ("c_custkey",), "cascade")],
        "lineitem": [fk(("l_orderkey",), "orders", ("o_orderkey",), "cascade")],
    }
    left = t.delete_cascade(own, keys, "nation", F.col("n_nationkey") == 3)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in left.items()]
    counts.append(left["supplier"].filter("s_nationkey is null").agg(F.count("*").alias("n")).select(F.lit("supplier_null").alias("name"), "n"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out


def catalogue_columns(spark: SparkSession, folder: str) -> DataFrame:
    """What information_schema.columns holds, from the tables' own schemas."""
    rows = [(n, f.name, i + 1) for n in NAMES for i, f in enumerate(read(spark, folder, n).schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int")


def copy_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Customers out to delimited text and in again, with a null and a quote among them."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    own = read(spark, folder, "customer").select("c_custkey", F.when(F.col("c_nationkey") > 3, F.concat(F.col("c_name"), F.lit(', "x"'))).alias("name"), "c_acctbal")
    copy_out(own, path, header=True)
    return copy_in(spark, path, "c_custkey long, name string, c_acctbal double", header=True, key="c_custkey")


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    return markdown_lines(read(spark, folder, "region"))


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream of files into a table, counted there."""
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    own = read(spark, folder, "events")
    own.repartition(4, "event_id").write.parquet(f"{base}/in")
    ingest(files(spark, f"{base}/in", own.schema), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches of users' events; the later batch wins."""
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    own = read(spark, folder, "events").select("user_id", "event_id").groupBy("user_id")
    for k, rows in enumerate((own.agg(F.min("event_id").alias("event_id")), own.agg(F.max("event_id").alias("event_id")))):
        rows.coalesce(1).write.parquet(f"{base}/out/batch={k}")
    return latest(spark.read.parquet(f"{base}/out"), ["user_id"]).select("user_id", "event_id")


_H = "(SELECT o_custkey AS id, o_orderstatus, o_orderkey AS begin_lsn, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS end_lsn FROM orders)"
_AT = "SELECT id, o_orderstatus, begin_lsn FROM " + _H + " h WHERE begin_lsn <= {0} AND (end_lsn IS NULL OR end_lsn > {0})"
_NEW = "(SELECT c_custkey + 1495 AS c_custkey, 'New' || c_custkey AS c_name, 0.5::DOUBLE AS c_acctbal FROM customer WHERE c_custkey < 10)"
FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "as_of_lsn": (as_of_lsn, _AT.format(700)),
    "as_of_time": (as_of_time, _AT.format(500)),
    "versions_of": (
        versions_of,
        f"""SELECT id, begin_lsn, end_lsn, TIMESTAMP '2020-01-01' + to_minutes(begin_lsn) AS version_start, TIMESTAMP '2020-01-01' + to_minutes(end_lsn) AS version_end
            FROM {_H} h WHERE begin_lsn <= 360 AND (end_lsn IS NULL OR end_lsn > 300)""",
    ),
    "retention": (retention, f"SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM {_H} h WHERE end_lsn IS NULL OR end_lsn > 900 GROUP BY o_orderstatus"),
    "history_commit": (
        history_commit,
        f"""SELECT id, o_orderstatus, begin_lsn, CASE WHEN end_lsn IS NULL THEN 9000000 ELSE end_lsn END AS end_lsn FROM {_H} h WHERE id IN (1, 2)
            UNION ALL SELECT * FROM (VALUES (1, 'X', 9000000, NULL), (999999, 'N', 9000000, NULL)) v""",
    ),
    "vector_as_of": (
        vector_as_of,
        f"""SELECT vec_id, round(CAST(list_cosine_similarity(embedding, q) AS DOUBLE), 4) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
            WHERE vec_id IN (SELECT id FROM {_H} h WHERE begin_lsn <= 700) ORDER BY list_cosine_similarity(embedding, q) DESC, vec_id LIMIT 5""",
    ),
    "graph_at_lsn": (graph_at_lsn, f"SELECT DISTINCT 'c' || id AS source, 'p' || l_partkey AS node FROM {_H} h JOIN lineitem ON l_orderkey = begin_lsn WHERE begin_lsn <= 700 AND (end_lsn IS NULL OR end_lsn > 700)"),
    "rrf_as_of": (
        rrf_as_of,
        f"""WITH h AS (SELECT id, o_totalprice AS price FROM {_H.replace("o_orderstatus,", "o_orderstatus, o_totalprice,")} h WHERE begin_lsn <= 700 AND (end_lsn IS NULL OR end_lsn > 700)),
            r AS (SELECT vec_id, round(CAST(list_cosine_similarity(embedding, q) AS DOUBLE), 4) AS c FROM embeddings JOIN h ON id = vec_id, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)),
            a AS (SELECT vec_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY c DESC, vec_id)) AS p FROM r), b AS (SELECT id AS vec_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY price DESC, id)) AS p FROM h)
            SELECT vec_id, round(sum(p), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) t GROUP BY vec_id""",
    ),
    "checked": (checked, "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal FROM customer"),
    "compare_and_set": (compare_and_set, "SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 3.0 ELSE s_acctbal END AS s_acctbal, CAST(CASE WHEN s_suppkey = 3 THEN 3 ELSE 1 END AS BIGINT) AS version FROM supplier"),
    "overlay": (overlay, "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey <> 1"),
    "json_export": (json_export, "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority END AS priority, o_totalprice FROM orders"),
    "stream_windows": (stream_windows, "SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2"),
    "stream_sessions": (
        stream_sessions,
        """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
            b AS (SELECT user_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) < 1800 THEN 0 ELSE 1 END AS new_one FROM e),
            g AS (SELECT user_id, s, sum(new_one) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM b)
            SELECT user_id, min(s) AS start, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, k""",
    ),
    "stream_totals": (stream_totals, "SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(max(value), 4) AS best FROM events GROUP BY user_id"),
    "catalogue_references": (
        catalogue_references,
        "SELECT * FROM (VALUES ('nation', 'n_regionkey', 'region'), ('customer', 'c_nationkey', 'nation'), ('supplier', 's_nationkey', 'nation'), ('orders', 'o_custkey', 'customer'), ('lineitem', 'l_orderkey', 'orders')) v(table_name, column_name, parent), (SELECT CAST(0 AS BIGINT) AS n_missing)",
    ),
    "insert_nothing": (insert_nothing, f"SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT * FROM {_NEW} n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)"),
    "upsert": (
        upsert,
        f"""SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL OR (n.c_custkey IS NOT NULL AND o.c_acctbal > 0) THEN n.c_name ELSE o.c_name END AS c_name,
            round(CASE WHEN o.c_custkey IS NULL THEN n.c_acctbal WHEN n.c_custkey IS NOT NULL AND o.c_acctbal > 0 THEN o.c_acctbal + n.c_acctbal ELSE o.c_acctbal END, 2) AS c_acctbal
            FROM customer o FULL JOIN {_NEW} n ON o.c_custkey = n.c_custkey""",
    ),
    "update": (update, "SELECT c_custkey, CASE WHEN c_nationkey = 4 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 4 AND c_acctbal > 5000 THEN 'RICH' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "delete": (delete, "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "returning": (returning, "SELECT s_suppkey, 0.0::DOUBLE AS s_acctbal FROM supplier WHERE s_nationkey < 3 AND s_acctbal <> 0"),
    "fk_cascade": (
        fk_cascade,
        """WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey <> 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
           SELECT 'nation' AS name, CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'supplier', count(*) FROM supplier
           UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)
           UNION ALL SELECT 'supplier_null', count(*) FROM supplier WHERE s_nationkey = 3""",
    ),
    "catalogue_columns": (
        catalogue_columns,
        "SELECT table_name, column_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position) AS INTEGER) AS ordinal_position FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN (" + ", ".join(f"'{n}'" for n in NAMES) + ")",
    ),
    "copy_round_trip": (copy_round_trip, "SELECT c_custkey, CASE WHEN c_nationkey > 3 THEN c_name || ', \"x\"' END AS name, c_acctbal FROM customer"),
    "markdown": (
        markdown,
        "SELECT 0 AS part, unnest(['| r_regionkey | r_name |', '| --- | --- |']) AS value UNION ALL SELECT 1, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region",
    ),
    "stream_ingest": (stream_ingest, "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type"),
    "stream_upsert": (stream_upsert, "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: text for k, (_, text) in FRAMES.items()}
