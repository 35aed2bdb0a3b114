"""Closures by repeated joins, for recursion in which repeated rows must end it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="quarry-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int | None = None) -> DataFrame:
    """All rows that start and repeated steps reach, each once. Only rows that are new in a
    round go through the next one; each round is a written table, and the union of rounds
    is read back as one. rounds: at most so many steps, else until nothing is new."""
    new = kept(start.distinct())
    tables, k = [new], 0
    while (rounds is None or k < rounds) and not new.isEmpty():
        found = step(new).distinct()
        for old in tables:
            found = found.join(old, [found[c].eqNullSafe(old[c]) for c in found.columns], "left_anti")
        new = kept(found)
        tables.append(new)
        k += 1
        if len(tables) > 8:  # one table for the rounds so far keeps the plan short
            rest = tables[0]
            for t in tables[1:-1]:
                rest = rest.unionAll(t)
            tables = [kept(rest), new]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out
