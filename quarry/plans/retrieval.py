"""Vector, hybrid and full-text queries over embeddings and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fts, vectors
from quarry.functions.aggregates import vector_avg
from quarry.operators.filters import Query, where
from quarry.operators.retrieval import Cells, knn, knn_join, product_codebooks, product_codes, product_distance, rank_fusion, search
from quarry.operators.retrieval import max_sim as max_sim_by
from quarry.sources.tables import read, sql

Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def probe(spark: SparkSession, folder: str, vec_id: int = 0) -> list[float]:
    row = read(spark, folder, "embeddings").filter(F.col("vec_id") == vec_id).first()
    return [float(x) for x in row["embedding"]]


def _knn(metric: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = knn(read(spark, folder, "embeddings"), probe(spark, folder), 10, "vec_id", metric=metric)
        return found.select("vec_id", F.round("score", 4).alias("score"))

    return run


def hybrid_knn(spark: SparkSession, folder: str) -> DataFrame:
    found = Query(read(spark, folder, "embeddings")).where(where().eq("label", 3)).with_vector(probe(spark, folder)).limit(10).execute("vec_id")
    return found.select("vec_id", "label", F.round("score", 4).alias("score"))


def knn_threshold(spark: SparkSession, folder: str) -> DataFrame:
    found = Query(read(spark, folder, "embeddings")).with_vector(probe(spark, folder)).with_threshold(0.1).execute("vec_id")
    return found.select("vec_id")


def vector_functions(spark: SparkSession, folder: str) -> DataFrame:
    """The distances as SQL functions."""
    vectors.register_sql(spark)
    text = f"""SELECT vec_id, round(l2_distance(embedding, q), 4) AS l2, round(inner_distance(embedding, q), 4) AS ip,
               round(cosine_distance(embedding, q), 4) AS cos FROM embeddings, {Q}"""
    return sql(spark, folder, text)


def vector_centroid(spark: SparkSession, folder: str) -> DataFrame:
    means = vector_avg(read(spark, folder, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("centroid").alias("at", "x")).select("label", F.col("at").cast("long").alias("component"), F.round(F.col("x").cast("double"), 4).alias("x"))


def hybrid_semijoin(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates from a join, then exact scores."""
    ids = read(spark, folder, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("vec_id"))
    found = Query(read(spark, folder, "embeddings")).within(ids, "vec_id").with_vector(probe(spark, folder)).limit(5).execute("vec_id")
    return found.select("vec_id", F.round("score", 4).alias("score"))


def compound_score(spark: SparkSession, folder: str) -> DataFrame:
    """(1 - distance) times in-degree centrality, over suppliers as nodes."""
    q = probe(spark, folder)
    degree = read(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("vec_id")).agg(F.count("*").alias("n"))
    most = degree.agg(F.max("n").alias("most"))
    central = degree.crossJoin(F.broadcast(most)).select("vec_id", (F.col("n") / F.col("most")).alias("centrality"))
    rows = read(spark, folder, "embeddings").join(central, "vec_id", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    scored = rows.select("vec_id", ((1 - vectors.distance(F.col("embedding"), q)) * F.col("centrality")).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", F.round("score", 4).alias("score"))


def rrf(spark: SparkSession, folder: str) -> DataFrame:
    """Reciprocal ranks of cosine and of a second signal, text length of documents."""
    rows = read(spark, folder, "embeddings").join(read(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars"), "vec_id")
    first = rows.select("vec_id", F.round(vectors.score(F.col("embedding"), probe(spark, folder)), 4).alias("value"))
    second = rows.filter("n_chars > 1000").select("vec_id", F.col("n_chars").cast("double").alias("value"))
    return rank_fusion([first, second], "vec_id").select("vec_id", F.round("score", 8).alias("score"))


def max_sim(spark: SparkSession, folder: str) -> DataFrame:
    """Late interaction: vectors of a label are a document's tokens."""
    query = [probe(spark, folder, 0), probe(spark, folder, 1)]
    return max_sim_by(read(spark, folder, "embeddings"), query, "label").select("label", F.round("score", 4).alias("score"))


def scalar_quantised(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings")
    low, high = vectors.scalar_ranges(rows, "embedding")
    return rows.select("vec_id", F.posexplode(vectors.scalar_quantise(F.col("embedding"), low, high)).alias("at", "code")).groupBy("vec_id").agg(F.sum("code").alias("total"))


def finite_quantised(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings").select("vec_id", vectors.finite_quantise(F.col("embedding"), [8, 5, 5]).alias("x"))
    return rows.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double")), 3).alias("total"))


def cells_search(spark: SparkSession, folder: str) -> DataFrame:
    """A partitioned search; all cells are probed, so it equals the exact one."""
    cells = Cells.build(read(spark, folder, "embeddings"), 8)
    return cells.search(probe(spark, folder), 10, "vec_id", probes=8).select("vec_id", F.round("score", 4).alias("score"))


def auto_search(spark: SparkSession, folder: str) -> DataFrame:
    """Exact or by cells, as the number of rows has it."""
    rows = read(spark, folder, "embeddings")
    found = search(rows, probe(spark, folder), 10, "vec_id", Cells.build(rows, 4), exact_below=1 << 30)
    return found.select("vec_id", F.round("score", 4).alias("score"))


def knn_join_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of each vector whose id is divisible by 100."""
    rows = read(spark, folder, "embeddings")
    found = knn_join(rows.filter("vec_id % 100 = 0"), rows, 5, "vec_id", "vec_id")
    return found.select("query", "id", F.round("score", 4).alias("score"), F.col("place").cast("long").alias("place"))


def product_quantised(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest by codes, then exact scores for the best hundred."""
    rows, q = read(spark, folder, "embeddings"), probe(spark, folder)
    books = product_codebooks(rows, 8, 16)
    near = rows.withColumn("near", product_distance(product_codes(F.col("embedding"), books, spark), q, books)).orderBy("near", "vec_id").limit(100)
    return knn(near, q, 10, "vec_id", metric="l2").select("vec_id", F.round("score", 4).alias("score"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", fts.vector(F.col("text")).alias("v"))


def fts_match(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).filter(fts.matches(F.col("v"), fts.query("eren & !tion"))).select("doc_id")


def fts_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).filter(fts.matches(F.col("v"), fts.phrase_query("of the"))).select("doc_id")


def fts_web(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).filter(fts.matches(F.col("v"), fts.web_query('"in the" OR tion -anon'))).select("doc_id")


def fts_rank(spark: SparkSession, folder: str) -> DataFrame:
    v, q = F.col("v"), fts.plain_query("the anon")
    return _texts(spark, folder).select("doc_id", F.round(fts.rank(v, q), 6).alias("plain"), F.round(fts.rank(v, q, 2), 8).alias("by_words"), F.round(fts.rank(v, q, 1 | 8), 8).alias("both"))


def fts_vector(spark: SparkSession, folder: str) -> DataFrame:
    items = read(spark, folder, "benchmark")
    return items.select("item_id", fts.vector_text(fts.vector(F.col("text"), "english")).alias("vector"))


_WORDS = "(SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}_]+') AS w FROM documents)"
_STOP = "(" + ", ".join(f"'{w}'" for w in fts.STOP_WORDS) + ")"


def _nearest(value: str, rows: str = "embeddings", k: int = 10, extra: str = "") -> str:
    return f"SELECT vec_id{extra}, round({value}, 4) AS score FROM {rows}, {Q} ORDER BY {value} DESC, vec_id LIMIT {k}"


_COS, _L2 = "CAST(list_cosine_similarity(embedding, q) AS DOUBLE)", "1 / (1 + pow(CAST(list_distance(embedding, q) AS DOUBLE), 2))"
FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "knn_cosine": (_knn("cosine"), _nearest(_COS)),
    "knn_l2": (_knn("l2"), _nearest(_L2)),
    "knn_ip": (_knn("ip"), _nearest("CAST(list_inner_product(embedding, q) AS DOUBLE)")),
    "hybrid_knn": (hybrid_knn, _nearest(_COS, "(SELECT * FROM embeddings WHERE label = 3) e", extra=", label")),
    "knn_threshold": (knn_threshold, f"SELECT vec_id FROM embeddings, {Q} WHERE {_COS} >= 0.1"),
    "vector_functions": (
        vector_functions,
        f"""SELECT vec_id, round(pow(CAST(list_distance(embedding, q) AS DOUBLE), 2), 4) AS l2, round(-CAST(list_inner_product(embedding, q) AS DOUBLE), 4) AS ip,
            round(1 - {_COS}, 4) AS cos FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings) e, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)""",
    ),
    "vector_centroid": (
        vector_centroid,
        "SELECT label, CAST(i - 1 AS BIGINT) AS component, round(avg(x), 4) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) t GROUP BY label, i",
    ),
    "hybrid_semijoin": (hybrid_semijoin, _nearest(_COS, "(SELECT * FROM embeddings WHERE vec_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)) e", 5)),
    "compound_score": (
        compound_score,
        f"""WITH d AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey),
            s AS (SELECT vec_id, {_COS} * coalesce(n / (SELECT max(n) FROM d), 0) AS score FROM embeddings LEFT JOIN d ON l_suppkey = vec_id, {Q})
            SELECT vec_id, round(score, 4) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10""",
    ),
    "rrf": (
        rrf,
        f"""WITH r AS (SELECT vec_id, n_chars, round({_COS}, 4) AS c FROM embeddings JOIN documents ON doc_id = vec_id, {Q}),
            a AS (SELECT vec_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY c DESC, vec_id)) AS p FROM r),
            b AS (SELECT vec_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY n_chars DESC, vec_id)) AS p FROM r WHERE n_chars > 1000)
            SELECT vec_id, round(sum(p), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) t GROUP BY vec_id""",
    ),
    "max_sim": (
        max_sim,
        """WITH q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id < 2),
           t AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
           SELECT label, round(sum(best), 4) AS score FROM (SELECT label, qid, max(list_inner_product(e, q)) AS best FROM t, q GROUP BY label, qid) x GROUP BY label""",
    ),
    "scalar_quantised": (
        scalar_quantised,
        """WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
           b AS (SELECT i, min(x) AS low, max(x) AS high FROM x GROUP BY i)
           SELECT vec_id, CAST(sum(round((x - low) / (high - low) * 255)) AS BIGINT) AS total FROM x JOIN b USING (i) GROUP BY vec_id""",
    ),
    "finite_quantised": (
        finite_quantised,
        """WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, [8, 5, 5][(generate_subscripts(embedding, 1) - 1) % 3 + 1] AS n FROM embeddings)
           SELECT vec_id, round(sum(CAST(CAST(round((tanh(x) + 1) / 2 * (n - 1)) / (n - 1) * 2 - 1 AS FLOAT) AS DOUBLE)), 3) AS total FROM x GROUP BY vec_id""",
    ),
    "cells_search": (cells_search, _nearest(_COS)),
    "auto_search": (auto_search, _nearest(_COS)),
    "knn_join": (
        knn_join_queries,
        f"""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS id, CAST(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS DOUBLE) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
            SELECT query, id, round(s, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS place FROM p QUALIFY place <= 5""",
    ),
    "product_quantised": (product_quantised, None),
    "fts_match": (fts_match, f"SELECT doc_id FROM {_WORDS} t WHERE list_contains(w, 'eren') AND NOT list_contains(w, 'tion')"),
    "fts_phrase": (fts_phrase, f"SELECT doc_id FROM {_WORDS} t WHERE list_contains(list_zip(w, w[2:]), ROW('of', 'the'))"),
    "fts_web": (fts_web, f"SELECT doc_id FROM {_WORDS} t WHERE list_contains(list_zip(w, w[2:]), ROW('in', 'the')) OR (list_contains(w, 'tion') AND NOT list_contains(w, 'anon'))"),
    "fts_rank": (
        fts_rank,
        f"""WITH t AS (SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS d, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'anon')) AS b FROM {_WORDS} t),
            s AS (SELECT doc_id, n, d, CASE WHEN a > 0 AND b > 0 THEN (a + b) / 2.0::DOUBLE ELSE 0 END AS r FROM t)
            SELECT doc_id, round(r, 6) AS plain, round(r / greatest(n, 1), 8) AS by_words, round(r / (1 + ln(greatest(n, 1))) / greatest(d, 1), 8) AS "both" FROM s""",
    ),
    "fts_vector": (
        fts_vector,
        f"""WITH w AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{Nd}}_]+') AS w FROM benchmark),
            x AS (SELECT item_id, lower(unnest(w)) AS t, unnest(range(1, len(w) + 1)) AS p FROM w),
            s AS (SELECT item_id, p, CASE WHEN len(t) > 5 AND t LIKE '%ies' THEN left(t, len(t) - 3) || 'y' WHEN len(t) > 5 AND t LIKE '%sses' THEN left(t, len(t) - 2)
                WHEN len(t) > 4 AND t LIKE '%ing' AND regexp_matches(left(t, len(t) - 3), '[aeiouy]') THEN left(t, len(t) - 3) WHEN len(t) > 4 AND t LIKE '%ed' AND regexp_matches(left(t, len(t) - 2), '[aeiouy]') THEN left(t, len(t) - 2)
                WHEN len(t) > 4 AND t LIKE '%es' THEN left(t, len(t) - 2) WHEN len(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, len(t) - 1) ELSE t END AS t FROM x WHERE t NOT IN {_STOP}),
            g AS (SELECT item_id, t || ':' || string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS part, t FROM s GROUP BY item_id, t), v AS (SELECT item_id, string_agg(part, ' ' ORDER BY t) AS vector FROM g GROUP BY item_id)
            SELECT b.item_id, coalesce(vector, '') AS vector FROM benchmark b LEFT JOIN v USING (item_id)""",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: text for k, (_, text) in FRAMES.items() if text}
