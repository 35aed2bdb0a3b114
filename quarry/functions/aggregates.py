"""Aggregates that built-in ones lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_agg(x: Column | str, *order: str) -> Column:
    """All values by the given order, nulls kept; null where there are no rows."""
    x = F.col(x) if isinstance(x, str) else x
    rows = F.array_sort(F.collect_list(F.struct(*order, x.alias("_x"))))
    return F.when(F.size(rows) > 0, F.transform(rows, lambda r: r["_x"]))


def vector_avg(df: DataFrame, keys: list[str], vector: str, name: str = "centroid") -> DataFrame:
    """The mean of vectors by group, component by component; null and empty vectors don't
    count. Components are summed before they are shuffled: a group sends `size` rows from
    each task and not its vectors."""
    rows = df.filter(F.size(vector) > 0).select(*keys, F.posexplode(vector).alias("_at", "_x"))
    means = rows.groupBy(*keys, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_x")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda r: r["_x"].cast("float")).alias(name))
