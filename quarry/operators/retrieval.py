"""Nearest neighbours, partitioned search, product quantisation and rank fusion."""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import dot, literal, score
from quarry.operators.recursive import kept, shared_dir

#: Rows from which a partitioned search pays; below it exact search reads all vectors.
EXACT_BELOW = 1_000_000
#: Rows on which centres are fitted, and bytes of a block of queries.
SAMPLE, BLOCK_BYTES = 100_000, 64 << 20


def knn(df: DataFrame, vector: list[float], k: int, key: str, column: str = "embedding", metric: str = "cosine") -> DataFrame:
    """The k best rows with their score; each partition keeps k rows before they meet."""
    return df.withColumn("score", score(F.col(column), vector, metric)).filter("score is not null").orderBy(F.desc("score"), key).limit(k)


def _best(table, k: int, metric: str):
    """The k best rows of a task for each query of the broadcast table (ids, matrix)."""

    def run(batches):
        names, matrix = table.value
        best = [np.zeros((0, 2))] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            s = vectors @ matrix.T
            if metric == "cosine":
                s /= np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(matrix, axis=1)
            elif metric == "l2":
                s = 1 / (1 + np.maximum(0, (vectors**2).sum(1)[:, None] + (matrix**2).sum(1) - 2 * s))
            ids = np.arange(len(s)) if k >= len(s) else None
            keys = batch.column("id").to_numpy()
            for j in range(len(names)):
                rows = ids
                if rows is None:  # the k best, and all that equal the last of them
                    rows = np.flatnonzero(s[:, j] >= np.partition(s[:, j], len(s) - k)[len(s) - k])
                own = [*best[j], *((-s[i, j], keys[i]) for i in rows)]
                best[j] = sorted(own, key=tuple)[:k]
        flat = [(q, i, -d) for q, found in zip(names, best) for d, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in flat], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query", "id", "score"])

    return run


def knn_join(queries: DataFrame, df: DataFrame, k: int, key: str, query_key: str, column: str = "embedding", metric: str = "cosine", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best rows for each of a stated set of queries. Queries are broadcast in blocks
    of a bounded size, of which most sets need one; each block is one scan, in which each
    task keeps k rows for a query."""
    rows = kept(queries.select(F.col(query_key).cast("long").alias("query"), F.col(column).cast("array<double>").alias("vector")).filter("query is not null and vector is not null"))
    n, size = rows.count(), rows.select(F.max(F.size("vector"))).first()[0] or 1
    blocks = max(1, math.ceil(n * size * 8 / block_bytes))
    vectors = df.select(F.col(key).cast("long").alias("id"), F.col(column).alias("vector")).filter("vector is not null")
    out = []
    for b in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toArrow()
        if own.num_rows:
            matrix = own["vector"].combine_chunks().flatten().to_numpy().reshape(own.num_rows, -1)
            table = df.sparkSession.sparkContext.broadcast((own["query"].to_pylist(), matrix))
            out.append(vectors.mapInArrow(_best(table, k, metric), "query long, id long, score double"))
    if not out:
        return df.sparkSession.createDataFrame([], "query long, id long, score double, place int")
    place = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return reduce(DataFrame.unionAll, out).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)


def _sampled(df: DataFrame, sample: int, seed: int) -> DataFrame:
    n = df.count()
    return df if n <= sample else df.sample(fraction=sample / n, seed=seed)


class Cells:
    """Vectors in k-means cells: a search reads the `probes` cells nearest to the query, and
    scores exactly inside them. Centres are fitted on about `sample` rows at most; all rows
    are assigned and written by cell, so that a search reads no other cells' files."""

    def __init__(self, rows: DataFrame, centres: np.ndarray, column: str):
        self.rows, self.centres, self.column = rows, centres, column

    @classmethod
    def build(cls, df: DataFrame, cells: int, path: str | None = None, column: str = "embedding", sample: int = SAMPLE, seed: int = 7) -> Cells:
        """Written to `path`, or to a new folder of the shared one."""
        some = _sampled(df.filter(F.col(column).isNotNull()), sample, seed)
        model = KMeans(k=cells, seed=seed, featuresCol="_v", predictionCol="cell").fit(some.select(array_to_vector(F.col(column).cast("array<double>")).alias("_v")))
        spark, path = df.sparkSession, path or f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
        centres = np.array(model.clusterCenters(), np.float64)
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
        assigned = df.withColumn("cell", nearest(F.col(column), centres, spark))
        # a cell has files from several tasks, so that a large one isn't one task
        assigned.repartition("cell", F.pmod(F.xxhash64(column), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/rows")
        return cls.open(spark, path, column)

    @classmethod
    def open(cls, spark: SparkSession, path: str, column: str = "embedding") -> Cells:
        """Cells that were written before."""
        found = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()
        centres = found["centre"].combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
        return cls(spark.read.parquet(f"{path}/rows"), centres, column)

    def search(self, vector: list[float], k: int, key: str, probes: int = 4, metric: str = "cosine") -> DataFrame:
        order = np.argsort(((self.centres - np.array(vector)) ** 2).sum(1), kind="stable")[:probes]
        return knn(self.rows.filter(F.col("cell").isin([int(c) for c in order])), vector, k, key, self.column, metric)


def search(df: DataFrame, vector: list[float], k: int, key: str, cells: Cells | None = None, column: str = "embedding", metric: str = "cosine", exact_below: int = EXACT_BELOW, probes: int = 4) -> DataFrame:
    """The k best rows: exactly where there are fewer than `exact_below`, or no cells; else by
    cells."""
    if cells is None or df.count() < exact_below:
        return knn(df, vector, k, key, column, metric)
    return cells.search(vector, k, key, probes, metric)


def nearest(vector: Column, centres: np.ndarray | list[list[float]], spark: SparkSession) -> Column:
    """The number of the nearest centre; of equally near ones the smaller. Centres are
    broadcast, and each batch of vectors is one product of matrices."""
    table = spark.sparkContext.broadcast(np.array(centres, np.float64))

    @F.pandas_udf("int")
    def run(vectors: pd.Series) -> pd.Series:
        c = table.value
        matrix = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, c.shape[1]))
        return pd.Series(((c**2).sum(1) - 2 * matrix @ c.T).argmin(1).astype(np.int32))

    return F.when(vector.isNotNull(), run(F.coalesce(vector.cast("array<double>"), literal([0.0] * table.value.shape[1]))))


def product_codebooks(df: DataFrame, parts: int, codes: int, column: str = "embedding", sample: int = SAMPLE, seed: int = 7) -> list[list[list[float]]]:
    """k-means centres for each part of the vectors, fitted on about `sample` rows at most."""
    size = df.select(F.size(column)).first()[0] // parts
    some = kept(_sampled(df.select(column), sample, seed))
    out = []
    for p in range(parts):
        own = some.select(array_to_vector(F.slice(F.col(column), p * size + 1, size).cast("array<double>")).alias("_v"))
        out.append([[float(x) for x in c] for c in KMeans(k=codes, seed=seed + p, featuresCol="_v").fit(own).clusterCenters()])
    return out


def product_codes(vector: Column, codebooks: list[list[list[float]]], spark: SparkSession) -> Column:
    size = len(codebooks[0][0])
    return F.array(*[nearest(F.slice(vector, p * size + 1, size), book, spark) for p, book in enumerate(codebooks)])


def product_distance(codes: Column, vector: list[float], codebooks: list[list[list[float]]]) -> Column:
    """Squared L2 between a query and codes, from one table of partial distances a part."""
    size, total = len(codebooks[0][0]), F.lit(0.0)
    for p, book in enumerate(codebooks):
        own = vector[p * size : (p + 1) * size]
        total = total + F.element_at(literal([sum((x - y) ** 2 for x, y in zip(c, own)) for c in book]), F.element_at(codes, p + 1) + 1)
    return total


def max_sim(df: DataFrame, query: list[list[float]], key: str, column: str = "embedding") -> DataFrame:
    """(key, score) by late interaction, over rows that are one vector each: for each query
    vector the best product with a document's vectors, summed. The vectors of a document
    never meet; only their best products do."""
    best = df.groupBy(key).agg(*(F.max(dot(F.col(column), q)).alias(f"_{i}") for i, q in enumerate(query)))
    return best.select(key, reduce(lambda a, b: a + b, [F.col(f"_{i}") for i in range(len(query))]).alias("score"))


def global_rank(df: DataFrame, order: list[Column], name: str = "place", partitions: int | None = None) -> DataFrame:
    """1, 2, ... over all rows in order, without a task that reads them all: rows are dealt
    by ranges of the order, numbered inside each range and moved by the ranges before it.
    The order has to be total."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_own", "_before", "_range")


def rank_fusion(signals: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal ranks of several signals, added up. Each signal has key and `value`, the
    better the larger; null values have no rank."""
    parts = []
    for s in signals:
        ranked = global_rank(s.select(key, "value").filter("value is not null"), [F.desc("value"), F.asc(key)])
        parts.append(ranked.select(key, (1 / (F.lit(k) + F.col("place"))).alias("part")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy(key).agg(F.sum("part").alias("score"))
