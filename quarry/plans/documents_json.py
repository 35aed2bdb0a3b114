"""JSON queries over events.props and documents made of table columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import jsonb
from quarry.sources.tables import read


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """{"k": .., "tag": .., "list": [user, event], "in": {"deep": ..}}"""
    tag = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "tag": "'), F.col("event_type"), F.lit('", "list": ['), F.col("user_id").cast("string"), F.lit(', "x"], "in": {"deep": '), (F.col("event_id") % 5).cast("string"), F.lit("}}"))
    return read(spark, folder, "events").select("event_id", "event_type", "user_id", "props", tag.alias("doc"), jsonb.parse(tag).alias("v"))


def json_extract(spark: SparkSession, folder: str) -> DataFrame:
    v = jsonb.parse(F.col("props"))
    return read(spark, folder, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), jsonb.get_text(v, "missing").alias("none"))


def json_paths(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("v")
    return _events(spark, folder).select("event_id", jsonb.get_text(v, *jsonb.path_of("{in,deep}")).alias("deep"), jsonb.get_text(v, "list", 0).alias("first"), jsonb.get_text(v, "tag").alias("tag"))


def json_contains(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).filter(jsonb.contains(F.col("v"), '{"tag": "click", "in": {"deep": 3}, "list": ["x"]}')).select("event_id")


def json_keys(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("v")
    return _events(spark, folder).select("event_id", jsonb.has_key(v, "k").alias("has"), jsonb.has_any(v, ["no", "in"]).alias("any"), jsonb.has_all(v, ["no", "in"]).alias("all"), jsonb.has_key(jsonb.get(v, "list"), "x").alias("inside"))


def json_path_filter(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("v")
    found = jsonb.path_exists(v, "$.in ? (@.deep > 2 && @.deep != 4)") & jsonb.path_exists(v, "$.list[*] ? (@ > 100)")
    return _events(spark, folder).filter(found).select("event_id")


def json_path_methods(spark: SparkSession, folder: str) -> DataFrame:
    """Descent to any depth, and methods."""
    v = F.col("v")
    first = lambda path: jsonb.get_text(F.element_at(jsonb.path_values(v, path), 1))
    return _events(spark, folder).select(
        "event_id", first("$..deep").alias("deep"), F.size(jsonb.path_values(v, "$..*")).cast("long").alias("n_all"), first("$.list.size()").alias("n_list"), first("$.in.type()").alias("kind"), first("$.tag.length()").alias("n_tag"),
        first("$.list[-1]").alias("last"), F.size(jsonb.path_values(v, "$.list[0 to 1]")).cast("long").alias("n_range"),
    )


def json_types(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("v")
    kinds = [jsonb.type_of(jsonb.get(v, k)).alias(f"t_{k}") for k in ("k", "tag", "list", "in")]
    return _events(spark, folder).select("event_id", *kinds, jsonb.array_length(jsonb.get(v, "list")).cast("long").alias("n"), F.array_join(jsonb.object_keys(v), ",").alias("keys"))


def json_each(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder)
    out = rows.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("event_id", "key", F.to_json("value").alias("value"))
    return out


def json_elements(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).select("event_id", F.explode(jsonb.elements(jsonb.get(F.col("v"), "list"))).alias("e"))
    return rows.select("event_id", jsonb.get_text(F.col("e")).alias("element"))


def json_record(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select("event_id", F.from_json("doc", "k BIGINT, tag STRING").alias("r")).select("event_id", "r.k", "r.tag")


def json_build(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.array("n_nationkey", "n_regionkey").alias("ids"))).alias("doc"))


def json_change(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder)
    doc = jsonb.set_path(jsonb.delete_path(F.col("doc"), ["in", "deep"]), ["tag"], "new")
    return rows.select("event_id", jsonb.insert_path(doc, ["list", 0], True).alias("doc"))


def json_merge(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select("event_id", jsonb.merge(F.col("props"), F.lit('{"z": [1]}')).alias("doc"))


_E = """(SELECT event_id, event_type, user_id, json_extract_string(props, '$.k') AS k, event_id % 5 AS deep,
  '{"k": ' || json_extract_string(props, '$.k') || ', "tag": "' || event_type || '", "list": [' || user_id || ', "x"], "in": {"deep": ' || (event_id % 5) || '}}' AS doc FROM events) e"""
FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "json_extract": (json_extract, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS none FROM events"),
    "json_paths": (json_paths, f"SELECT event_id, json_extract_string(doc, '$.in.deep') AS deep, json_extract_string(doc, '$.list[0]') AS first, json_extract_string(doc, '$.tag') AS tag FROM {_E}"),
    "json_contains": (json_contains, f"SELECT event_id FROM {_E} WHERE json_contains(doc, '{{\"tag\": \"click\", \"in\": {{\"deep\": 3}}, \"list\": [\"x\"]}}')"),
    "json_keys": (json_keys, 'SELECT event_id, true AS has, true AS "any", false AS "all", true AS inside FROM events'),
    "json_path_filter": (json_path_filter, f"SELECT event_id FROM {_E} WHERE deep = 3 AND user_id > 100"),
    "json_path_methods": (
        json_path_methods,
        "SELECT event_id, CAST(event_id % 5 AS VARCHAR) AS deep, CAST(7 AS BIGINT) AS n_all, '2' AS n_list, 'object' AS kind, CAST(len(event_type) AS VARCHAR) AS n_tag, 'x' AS last, CAST(2 AS BIGINT) AS n_range FROM events",
    ),
    "json_types": (json_types, "SELECT event_id, 'number' AS t_k, 'string' AS t_tag, 'array' AS t_list, 'object' AS t_in, CAST(2 AS BIGINT) AS n, 'in,k,list,tag' AS keys FROM events"),
    "json_each": (
        json_each,
        f"""SELECT event_id, key, CASE key WHEN 'k' THEN k WHEN 'tag' THEN '"' || event_type || '"' WHEN 'list' THEN '[' || user_id || ',"x"]' ELSE '{{"deep":' || deep || '}}' END AS value
            FROM {_E}, (SELECT unnest(['k', 'tag', 'list', 'in']) AS key)""",
    ),
    "json_elements": (json_elements, f"SELECT event_id, unnest([CAST(user_id AS VARCHAR), 'x']) AS element FROM {_E}"),
    "json_record": (json_record, f"SELECT event_id, CAST(k AS BIGINT) AS k, event_type AS tag FROM {_E}"),
    "json_build": (json_build, """SELECT n_nationkey, '{"name":"' || n_name || '","ids":[' || n_nationkey || ',' || n_regionkey || ']}' AS doc FROM nation"""),
    "json_change": (json_change, f"""SELECT event_id, '{{"in":{{}},"k":' || k || ',"list":[true,' || user_id || ',"x"],"tag":"new"}}' AS doc FROM {_E}"""),
    "json_merge": (json_merge, """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"z":[1]}' AS doc FROM events"""),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: text for k, (_, text) in FRAMES.items() if text}
