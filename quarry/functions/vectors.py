"""Distances, scores and quantisers of vectors, as column expressions.

L2 is squared; inner product distances are negative; cosine distance is 1 minus the true
cosine, whatever the vectors' lengths. Public scores: 1 / (1 + d), the product, and the
cosine held to [-1, 1]. Null or empty vectors give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _vector(v: Column | list[float]) -> Column:
    return v if isinstance(v, Column) else literal(v)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column | list[float]) -> Column:
    return _sum(F.zip_with(a, _vector(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2(a: Column, b: Column | list[float]) -> Column:
    return _sum(F.zip_with(a, _vector(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column | list[float]) -> Column:
    length = sum(x * x for x in b) ** 0.5 if isinstance(b, list) else norm(b)
    return F.try_divide(dot(a, b), norm(a) * length)


def distance(a: Column, b: Column | list[float], metric: str = "cosine") -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric!r}")
    return {"l2": l2, "ip": lambda x, y: -dot(x, y), "cosine": lambda x, y: F.greatest(F.lit(0.0), 1 - cosine(x, y))}[metric](a, b)


def score(a: Column, b: Column | list[float], metric: str = "cosine") -> Column:
    if metric == "l2":
        return 1 / (1 + l2(a, b))
    if metric == "ip":
        return dot(a, b)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))


def _best(tokens: Column, q: list[float]) -> Column:
    return F.array_max(F.transform(tokens, lambda t: dot(t, q)))


def max_sim(query: list[list[float]], tokens: Column) -> Column:
    """Late interaction: for each query vector its best product with a document's vectors, summed."""
    best = [_best(tokens, q) for q in query]
    return sum(best[1:], best[0])


def register_sql(spark: SparkSession) -> None:
    """l2_distance, inner_distance, cosine_distance and similarity for SQL, in Catalyst."""
    d = "DOUBLE"
    inner = "aggregate(zip_with(a, b, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)"
    bodies = {
        "l2_distance": "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), CAST(0 AS DOUBLE), (s, x) -> s + x)",
        "inner_distance": f"-{inner}",
        "cosine_distance": f"1 - {inner} / sqrt({inner.replace('(a, b,', '(a, a,')} * {inner.replace('(a, b,', '(b, b,')})",
        "similarity": f"{inner} / sqrt({inner.replace('(a, b,', '(a, a,')} * {inner.replace('(a, b,', '(b, b,')})",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<{d}>, b ARRAY<{d}>) RETURNS {d} RETURN {body}")


# --- quantisers -------------------------------------------------------------------------


def scalar_ranges(df: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """Least and largest value of each component: one row for each reaches the driver."""
    rows = df.select(F.posexplode(vector).alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()
    return [float(r["low"]) for r in rows], [float(r["high"]) for r in rows]


def scalar_quantise(vector: Column, low: list[float], high: list[float], bits: int = 8) -> Column:
    """Codes from 0 to 2**bits - 1 between each component's bounds."""
    most = (1 << bits) - 1
    bounds = F.arrays_zip(literal(low).alias("low"), literal([h - x for x, h in zip(low, high)]).alias("span"))
    code = lambda x, b: F.when(b["span"] > 0, F.round((x - b["low"]) / b["span"] * most)).otherwise(0.0)
    return F.zip_with(vector, bounds, lambda x, b: F.greatest(F.lit(0), F.least(F.lit(most), code(x, b).cast("int"))))


def scalar_restore(codes: Column, low: list[float], high: list[float], bits: int = 8) -> Column:
    most = (1 << bits) - 1
    bounds = F.arrays_zip(literal(low).alias("low"), literal([h - x for x, h in zip(low, high)]).alias("span"))
    return F.zip_with(codes, bounds, lambda c, b: (b["low"] + c / most * b["span"]).cast("float"))


def finite_quantise(vector: Column, levels: list[int]) -> Column:
    """Finite scalar quantisation: each component is bounded by tanh, rounded to one of its
    levels and scaled back to [-1, 1]; levels are used in turn. There is no codebook."""
    turn = F.array(*map(F.lit, levels))
    level = lambda i: F.element_at(turn, i % len(levels) + 1)
    return F.transform(vector, lambda x, i: (F.round((F.tanh(x.cast("double")) + 1) / 2 * (level(i) - 1)) / (level(i) - 1) * 2 - 1).cast("float"))
