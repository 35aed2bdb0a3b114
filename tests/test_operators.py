from __future__ import annotations

import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import fts, jsonb, vectors
from quarry.functions.aggregates import array_agg, vector_avg
from quarry.operators import graph, tables
from quarry.operators.communities import communities, modularity
from quarry.operators.filters import Query, parse_value, where
from quarry.operators.graph import Hop
from quarry.operators.recursive import closure
from quarry.operators.retrieval import Cells, global_rank, knn, knn_join, product_codebooks, product_codes, product_distance, rank_fusion, search
from quarry.streaming.ingest import files, ingest, run_to_memory, run_to_table, sessions, windowed


def test_window_rows(spark):
    rows = spark.createDataFrame([("a1", "a", 10), ("a2", "a", 20), ("a3", "a", 20), ("b1", "b", 7), ("b2", "b", 5)], "id string, category string, score int")
    w = Window.partitionBy("category").orderBy(F.desc("score"))
    got = {r["id"]: (r["rk"], r["dr"]) for r in rows.select("id", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr")).collect()}
    assert got == {"a1": (3, 2), "a2": (1, 1), "a3": (1, 1), "b1": (1, 1), "b2": (2, 2)}


def test_array_agg_keeps_nulls(spark):
    rows = spark.createDataFrame([("a1", "a", "Ada"), ("a2", "a", "Grace"), ("a3", "a", None), ("b1", "b", "Linus")], "id string, c string, name string")
    got = {r["c"]: r["n"] for r in rows.groupBy("c").agg(array_agg("name", "id").alias("n")).collect()}
    assert got == {"a": ["Ada", "Grace", None], "b": ["Linus"]}
    assert rows.filter("false").agg(array_agg("name", "id").alias("n")).first()["n"] is None


def test_vector_avg(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("a", [3.0, 4.0, 5.0]), ("b", [10.0, 20.0, 30.0]), ("b", None), ("b", [])], "c string, v array<float>")
    assert {r["c"]: r["m"] for r in vector_avg(rows, ["c"], "v", "m").collect()} == {"a": [2.0, 3.0, 4.0], "b": [10.0, 20.0, 30.0]}


def test_closure_ends_on_cycle(spark):
    steps = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "id long")
    got = closure(start, lambda new: new.join(steps, new["id"] == steps["src"]).select(F.col("dst").alias("id")))
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3]


def test_filters(spark):
    rows = spark.createDataFrame([(1, 5.0, ["a", "b"]), (2, 7.0, ["b"]), (3, None, None)], "id int, price double, tags array<string>")
    ids = lambda f: sorted(r["id"] for r in Query(rows).where(f).list().collect())
    assert ids(where().gt("price", 5.0)) == [2] and ids(where().gte("price", 5.0)) == [1, 2]
    assert ids(where().not_().eq("price", 5.0).end()) == [2]
    assert ids(where().contains_any("tags", ["a"])) == [1] and ids(where().exact_match("tags", ["b", "a"])) == [1]
    with pytest.raises(ValueError):
        where().or_().column()
    assert parse_value("3") == 3 and parse_value("2.5") == 2.5 and parse_value("true") is True and parse_value("x") == "x"
    assert parse_value("[1, 2]", "int[]") == [1, 2]


def test_rank_fusion_and_global_rank(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", None)], "id string, value double")
    b = spark.createDataFrame([("y", 9.0)], "id string, value double")
    got = {r["id"]: r["score"] for r in rank_fusion([a, b], "id").collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61})
    many = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("id"))
    assert all(r["place"] == r["id"] + 1 for r in global_rank(many, [F.asc("id")]).collect())


def test_knn_join_equals_knn(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    queries = rows.filter("vec_id % 100 = 0")
    got = {(r["query"], r["place"]): r["id"] for r in knn_join(queries, rows, 5, "vec_id", "vec_id", block_bytes=2048).collect()}
    for q in queries.collect():
        want = [r["vec_id"] for r in knn(rows, [float(x) for x in q["embedding"]], 5, "vec_id").collect()]
        assert [got[q["vec_id"], k] for k in range(1, 6)] == want


def clustered(spark, n=20_000, size=16, groups=40):
    """Vectors about centres, as embeddings of texts are."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(groups, size))
    rows = centres[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, size))
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": rows.tolist()})).cache()


def brute_recall(rows, queries, search, k=10):
    table = rows.select("vec_id", "embedding").toPandas()
    matrix, ids = np.stack(table["embedding"].to_numpy()), table["vec_id"].to_numpy()
    hit = 0
    for q in queries:
        v = np.array(q, float)
        s = ((matrix - v) ** 2).sum(1)
        hit += len(set(ids[np.lexsort((ids, s))[:k]].tolist()) & {r["vec_id"] for r in search([float(x) for x in q]).collect()})
    return hit / (k * len(queries))


def test_cells_recall_where_most_are_not_read(spark, tmp_path):
    """A fifth of the cells is read; queries are rows whose id is divisible by 100 (a part of them here)."""
    rows = clustered(spark)
    Cells.build(rows, 40, str(tmp_path / "cells"), sample=5000)
    cells = Cells.open(spark, str(tmp_path / "cells"))
    assert cells.rows.count() == rows.count()
    queries = [r["embedding"] for r in rows.filter("vec_id % 1000 = 0").collect()]
    found = lambda v: cells.search(v, 10, "vec_id", probes=8, metric="l2")
    assert brute_recall(rows, queries, found) >= 0.9
    plan = found([float(x) for x in queries[0]])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("PartitionFilters: [isnotnull(cell", "PartitionFilters: [cell")


def test_product_codes_recall(spark):
    rows = clustered(spark, 6000)
    books = product_codebooks(rows, 8, 32, sample=3000)
    coded = rows.withColumn("codes", product_codes(F.col("embedding"), books, spark)).cache()
    found = lambda v: knn(coded.orderBy(product_distance(F.col("codes"), v, books), "vec_id").limit(200), v, 10, "vec_id", metric="l2")
    queries = [r["embedding"] for r in rows.filter("vec_id % 300 = 0").collect()]
    assert brute_recall(rows, queries, found) >= 0.9


def test_search_is_exact_below_a_size(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    v = [float(x) for x in rows.first()["embedding"]]
    cells = Cells.build(rows, 5)
    ids = lambda df: [r["vec_id"] for r in df.collect()]
    assert ids(search(rows, v, 5, "vec_id", cells, exact_below=10**6)) == ids(knn(rows, v, 5, "vec_id"))
    assert ids(search(rows, v, 5, "vec_id", cells, exact_below=1, probes=1)) == ids(cells.search(v, 5, "vec_id", probes=1))
    assert ids(search(rows, v, 5, "vec_id", exact_below=1)) == ids(knn(rows, v, 5, "vec_id"))


def test_communities_of_suppliers(spark, folder):
    from quarry.plans import graphs

    edges = graphs._places(spark, folder)
    found = communities(edges)
    one = found.select("id", F.lit("0").alias("community"))
    assert modularity(edges, found) > max(0.6, modularity(edges, one))


def test_full_text(spark):
    rows = spark.createDataFrame([("d1", "security incident response"), ("d2", "security vector search"), ("d3", "gardening notes"), ("d4", None)], "id string, content string")
    v = fts.vector(F.col("content"), "english")
    ids = lambda q: sorted(r["id"] for r in rows.filter(fts.matches(v, q)).collect())
    assert ids(fts.plain_query("the security incidents", "english")) == ["d1"]
    assert ids(fts.query("security & !vector", "english")) == ["d1"]
    assert ids(fts.query("gard:* | (vector <-> search)", "simple")) == ["d2", "d3"]
    assert ids(fts.web_query('"incident response" OR notes -security', "english")) == ["d1", "d3"]
    assert ids(None) == []
    assert rows.filter("id = 'd2'").select(fts.vector_text(fts.vector(F.lit("To be searching, searched"), "english")).alias("t")).first()["t"] == "search:3,4"
    assert rows.filter("id = 'd2'").select(fts.rank(fts.vector(F.lit("a b a")), fts.query("a | b")).alias("r")).first()["r"] == 1.0


def test_json(spark):
    docs = [("d1", '{"name":"Ada","roles":["admin","editor"],"profile":{"active":true},"scores":[0,2,4],"n":null}'), ("d2", '{"name":"Grace","roles":["viewer"],"profile":{"active":false},"scores":[0,1]}'), ("d3", None)]
    rows = spark.createDataFrame(docs, "id string, doc string").withColumn("v", jsonb.parse(F.col("doc")))
    ids = lambda c: sorted(r["id"] for r in rows.filter(c).collect())
    v = F.col("v")
    assert ids(jsonb.contains(v, '{"profile":{"active":true},"roles":["admin"]}')) == ["d1"]
    assert ids(jsonb.contains(v, {"scores": [2.0]})) == ["d1"]
    assert ids(jsonb.path_exists(v, "$.scores[*] ? (@ > 2)")) == ["d1"] and ids(jsonb.path_exists(v, "$.roles[0]")) == ["d1", "d2"]
    assert ids(jsonb.has_key(v, "n")) == ["d1"] and ids(jsonb.type_of(jsonb.get(v, "n")) == "null") == ["d1"]
    one = rows.filter("id = 'd2'").select(jsonb.delete_path(F.col("doc"), ["scores", -1]).alias("a"), jsonb.set_path(F.col("doc"), ["profile", "x"], 1, create=False).alias("b"), jsonb.merge(F.lit("[1]"), F.lit("2")).alias("c")).first()
    assert '"scores":[0]' in one["a"] and '"x"' not in one["b"] and one["c"] == "[1,2]"


def test_json_paths_at_any_depth(spark):
    doc = {"a": {"k": 1, "b": [{"k": 2}, {"c": {"k": [3, 4]}}]}, "k": 5, "s": "text"}
    rows = spark.createDataFrame([(json.dumps(doc),), ("null",), (None,)], "doc string").withColumn("v", jsonb.parse(F.col("doc")))

    def values(path):
        out = rows.select(F.transform(jsonb.path_values(F.col("v"), path), lambda e: F.to_json(e)).alias("x")).first()["x"]
        return sorted(out)

    assert values("$..k") == ["1", "2", "5", "[3,4]"] and values("$..b[*].k") == ["2"] and values("$..c.k[-1]") == ["4"]
    assert len(values("$..*")) == 12 and values("$.a.*") == sorted(["1", '[{"k":2},{"c":{"k":[3,4]}}]'])
    assert values("$.a.type()") == ['"object"'] and values("$.a.b.size()") == ["2"] and values("$.s.length()") == ["4"] and values("$.length()") == ["3"]
    assert values("$.a.b[0 to 5].k") == ["2"] and values('$["k"]') == ["5"] and values("$.s.size()") == []
    assert [r["n"] for r in rows.select(F.size(jsonb.path_values(F.col("v"), "$..k")).alias("n")).collect()] == [4, 0, 0]
    with pytest.raises(ValueError):
        jsonb.path_values(F.col("v"), "$.a.keyvalue()")


def changed_brute(doc, path, change):
    node = doc
    for key in path[:-1]:
        node = node[int(key)] if isinstance(node, list) else node[key]
    change(node, path[-1])
    return doc


def test_json_changes(spark):
    doc = '{"a":{"b":[1,{"c":2},"x"]},"k":null,"é":"ü"}'
    rows = spark.createDataFrame([(doc,), (None,), ("[1,2]",)], "doc string")
    d = F.col("doc")
    cases = [
        (jsonb.set_path(d, ["a", "b", 1, "c"], {"z": [1]}), '{"a":{"b":[1,{"c":{"z":[1]}},"x"]},"k":null,"é":"ü"}', "[1,2]"),
        (jsonb.set_path(d, ["a", "b", -1], None), '{"a":{"b":[1,{"c":2},null]},"k":null,"é":"ü"}', "[1,2]"),
        (jsonb.set_path(d, ["a", "b", 9], True), '{"a":{"b":[1,{"c":2},"x",true]},"k":null,"é":"ü"}', "[1,2]"),
        (jsonb.set_path(d, ["a", "b", -9], True), '{"a":{"b":[true,1,{"c":2},"x"]},"k":null,"é":"ü"}', "[1,2]"),
        (jsonb.set_path(d, ["no", "b"], 1), doc, "[1,2]"), (jsonb.set_path(d, ["new"], 1.5, create=False), doc, "[1,2]"), (jsonb.set_path(d, ["k"], "v"), '{"a":{"b":[1,{"c":2},"x"]},"k":"v","é":"ü"}', "[1,2]"),
        (jsonb.delete_path(d, ["a", "b", 0]), '{"a":{"b":[{"c":2},"x"]},"k":null,"é":"ü"}', "[1,2]"), (jsonb.delete_path(d, [-1]), doc, "[1]"), (jsonb.delete_path(d, ["k"]), '{"a":{"b":[1,{"c":2},"x"]},"é":"ü"}', "[1,2]"),
        (jsonb.insert_path(d, ["a", "b", 0], 7, after=True), '{"a":{"b":[1,7,{"c":2},"x"]},"k":null,"é":"ü"}', "[1,2]"), (jsonb.insert_path(d, ["a", "b"], 7), doc, "[1,2]"), (jsonb.insert_path(d, [5], 7), '{"5":7,"a":{"b":[1,{"c":2},"x"]},"k":null,"é":"ü"}', "[1,2,7]"),
        (jsonb.merge(d, F.lit('{"k":1,"q":[]}')), '{"a":{"b":[1,{"c":2},"x"]},"k":1,"q":[],"é":"ü"}', '[1,2,{"k":1,"q":[]}]'), (jsonb.merge(d, F.lit("[3]")), f"[{doc},3]", "[1,2,3]"),
    ]
    got = rows.select(*(c.alias(f"c{k}") for k, (c, *_) in enumerate(cases))).collect()
    for k, (_, first, last) in enumerate(cases):
        assert (got[0][k], got[1][k], got[2][k]) == (first, None, last), k


def test_graph_patterns(spark):
    e = spark.createDataFrame([("a", "b", "K", 1.0), ("b", "c", "K", 2.0), ("c", "a", "K", 3.0), ("a", "d", "U", 1.0)], "src string, dst string, type string, weight double")
    seeds = spark.createDataFrame([("a",)], "id string")
    ends = lambda *hops, **kw: sorted((r["node"], r["steps"]) for r in graph.traverse(seeds, e, list(hops), **kw).collect())
    assert ends(Hop("K", "out", 2, 3)) == [("a", 3), ("c", 2)]  # a node met before `least` counts again
    assert ends(Hop("K", "out", 1, None)) == [("a", 3), ("b", 1), ("c", 2)]
    assert ends(Hop("K", "in")) == [("c", 1)]
    assert ends(Hop("U", "in"), undirected=frozenset({"U"})) == [("d", 1)]
    assert ends(Hop("K", condition=F.col("weight") > 1)) == []
    paths = {r["target"]: r["path"]["nodes"] for r in graph.shortest_paths(seeds, e, Hop("K", "out", 1, 3)).collect()}
    assert paths["c"] == ["a", "b", "c"] and paths["b"] == ["a", "b"]
    with pytest.raises(ValueError):
        graph.check_types([Hop("X")], frozenset({"K"}))
    with pytest.raises(ValueError):
        graph.delete_vertices(seeds, e, seeds)


def test_communities_of_two_cliques(spark):
    cliques = [(a, b, 1.0) for base in (0, 10) for a, b in itertools.combinations(range(base, base + 5), 2)] + [(4, 10, 1.0)]
    e = spark.createDataFrame(cliques, "src long, dst long, weight double")
    found = communities(e)
    assert {r["id"]: r["community"] for r in found.collect()} == {**{i: 0 for i in range(5)}, **{i: 10 for i in range(10, 15)}}
    assert modularity(e, found) > 0.4


def test_constraints(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    rows = spark.createDataFrame([(10, 1, None), (11, None, 5)], "id int, parent int, score int")
    fk = tables.ForeignKey(("parent",), "parents", ("id",))
    tables.check_reference(rows, fk, parents)
    tables.check(rows, F.col("score") > 0)
    for bad in (lambda: tables.check(rows, F.col("score") > 9), lambda: tables.check_not_null(rows, "score"), lambda: tables.check_unique(rows.union(rows), "id"), lambda: tables.insert(rows, rows, ["id"])):
        with pytest.raises(tables.ConstraintError):
            bad()
    with pytest.raises(tables.ConstraintError):
        tables.delete_cascade({"parents": parents, "rows": rows}, {"rows": [fk]}, "parents", F.col("id") == 1)
    with pytest.raises(ValueError):
        tables.delete(rows, None)
    with pytest.raises(ValueError):
        tables.as_of(rows, 1, oldest=5)


def test_cascades_by_key(spark):
    own = {"a": spark.createDataFrame([(1,), (2,), (3,)], "id int"), "b": spark.createDataFrame([(10, 1, None), (11, 2, 10), (12, None, 11), (11, 3, 10), (13, 3, 13)], "id int, a int, up int")}
    keys = {"b": [tables.ForeignKey(("a",), "a", ("id",), "cascade"), tables.ForeignKey(("up",), "b", ("id",), "cascade")]}
    out = tables.delete_cascade(own, keys, "a", F.col("id") == 1)
    assert sorted(r["id"] for r in out["a"].collect()) == [2, 3] and sorted(map(tuple, out["b"].collect())) == [(13, 3, 13)]
    keys = {"b": [tables.ForeignKey(("a",), "a", ("id",), "set default")]}
    out = tables.delete_cascade(own, keys, "a", F.col("id") > 1, defaults={"b": {"a": 1}})
    assert sorted(str(r["a"]) for r in out["b"].collect()) == ["1", "1", "1", "1", "None"]


def test_returning(spark):
    before = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, x string")
    after = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "id int, x string")
    assert sorted(tuple(r) for r in tables.returning(before, after, ["id"], ["id"]).collect()) == [(2,), (4,)]


def test_overlay_and_versions(spark):
    base = spark.createDataFrame([(1, "a", 1)], "id int, x string, version int")
    o = tables.Overlay(base, ["id"]).savepoint("s").stage(lambda df: tables.update(df, {"x": F.lit("b")}, F.col("id") == 1))
    assert o.current.first()["x"] == "b" and o.rollback_to("s").current.first()["x"] == "a"
    assert tables.update_if_version(base, F.col("id") == 1, 1, {"x": F.lit("c")}).first()["version"] == 2
    with pytest.raises(tables.ConstraintError):
        tables.update_if_version(base, F.col("id") == 1, 7, {"x": F.lit("c")})


def test_quantisers(spark):
    rows = spark.createDataFrame([([0.0, 10.0],), ([1.0, 20.0],), ([0.5, 12.0],)], "v array<float>")
    low, high = vectors.scalar_ranges(rows, "v")
    codes = vectors.scalar_quantise(F.col("v"), low, high)
    back = [r["b"] for r in rows.select(vectors.scalar_restore(codes, low, high).alias("b")).collect()]
    assert back[2] == pytest.approx([0.5, 12.0], abs=0.05)
    assert all(abs(x) <= 1 for r in rows.select(vectors.finite_quantise(F.col("v"), [5]).alias("f")).collect() for x in r["f"])


def test_streams(spark, folder, tmp_path):
    own = spark.read.parquet(f"{folder}/events.parquet")
    own.repartition(3, "event_id").write.parquet(str(tmp_path / "in"))
    calls = []
    ingest(files(spark, str(tmp_path / "in"), own.schema), str(tmp_path / "out"), str(tmp_path / "c"), lambda b, n: calls.append(n))
    assert spark.read.parquet(str(tmp_path / "out")).count() == own.count() and len(calls) == 3
    again = ingest(files(spark, str(tmp_path / "in"), own.schema), str(tmp_path / "out"), str(tmp_path / "c"))
    assert sum(b["rows"] for b in again) == 0
    stream = files(spark, str(tmp_path / "in"), own.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_to_memory(windowed(stream, "ts", "1 hour", "10 minutes", ["event_type"], F.count("*").alias("n")), "hours")
    assert out.agg(F.sum("n")).first()[0] == own.count()


def test_sessions_that_only_touch_stay_apart(spark, tmp_path):
    """F1: exactly the gap between two events ends a session; a microsecond less doesn't."""
    at = ["2024-01-01 10:00:00", "2024-01-01 10:30:00", "2024-01-01 10:59:59.999999", "2024-01-01 12:00:00"]
    own = spark.createDataFrame([(1, x) for x in at] + [(2, at[0])], "user_id int, at string").withColumn("at", F.to_timestamp("at"))
    own.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = sessions(files(spark, str(tmp_path / "in"), own.schema), "at", "30 minutes", "1 day", ["user_id"], F.count("*").alias("n"))
    found = run_to_memory(rows, "touching").select("user_id", F.date_format("session.start", "HH:mm:ss").alias("start"), F.date_format("session.end", "HH:mm:ss.SSSSSS").alias("end"), "n")
    assert sorted(map(tuple, found.collect())) == [(1, "10:00:00", "10:30:00.000000", 1), (1, "10:30:00", "11:29:59.999999", 2), (1, "12:00:00", "12:30:00.000000", 1), (2, "10:00:00", "10:30:00.000000", 1)]


def test_chained_json_changes_are_worked_out_once(spark):
    """each change parses its document once, however many others it takes."""
    rows = spark.createDataFrame([('{"in":{"deep":7},"list":["x"]}',), ("[1]",), (None,)], "doc string")
    plan = lambda c: rows.select(c)._jdf.queryExecution().optimizedPlan().toString()
    one = plan(jsonb.delete_path(F.col("doc"), ["in", "deep"]))
    assert one.count("parseJson") == 1
    d = F.col("doc")
    for _ in range(3):
        d = jsonb.insert_path(jsonb.set_path(jsonb.delete_path(d, ["in", "deep"]), ["in", "deep"], 1), ["list", 0], True)
    d = jsonb.merge(d, F.lit('{"in":2}'))
    assert len(plan(d)) < 20 * len(one)
    assert [r["doc"] for r in rows.select(d.alias("doc")).collect()] == ['{"in":2,"list":[true,true,true,"x"]}', '[1,{"in":2}]', None]


def test_a_stream_into_a_table(spark, tmp_path):
    """the whole result comes from files that executors write, after several batches too."""
    own = spark.createDataFrame([(k % 3, f"2024-01-01 {k:02}:00:00") for k in range(20)], "user_id int, at string").withColumn("at", F.to_timestamp("at"))
    for k in range(3):
        own.filter(F.hour("at") % 3 == k).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    for hours, expected in ((1, [(0, 7, 7), (1, 7, 7), (2, 6, 6)]), (4, [(0, 1, 7), (1, 1, 7), (2, 1, 6)])):
        rows = sessions(files(spark, str(tmp_path / "in/*"), own.schema), "at", f"{hours} hours", "2 days", ["user_id"], F.count("*").alias("n"))
        found = run_to_table(rows, str(tmp_path / f"out{hours}"), str(tmp_path / f"c{hours}"))
        assert found.inputFiles() and sorted(map(tuple, found.groupBy("user_id").agg(F.count("*"), F.sum("n")).collect())) == expected
