"""Shared by the operators of this package: inputs, intermediate tables, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.recursive import kept as written  # a table in the shared folder, which outlives lost executors
from quarry.sources.tables import ship

#: White space of the contracts' word classes.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["SPACE", "SPACE_CHARS", "bounded", "discard", "slices", "table", "written"]


def discard(df: DataFrame) -> None:
    """Removes the table behind df, which `written` has made, once nothing reads it any more."""
    spark = df.sparkSession
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices with about `most` bytes of text, one row at least, so that
    what numpy derives from a slice stays small whatever the batch size is."""
    for batch in batches:
        i, n = 0, batch.num_rows
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        while i < n:
            k, total = i, 0
            while k < n and (k == i or total + sizes[k] <= most):
                total += int(sizes[k])
                k += 1
            yield batch.slice(i, k - i)
            i = k


def bounded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """All rows if there are at most `most`; else a sample of about so many, by a hash of
    the key, which is the same in each run. Small enough to be broadcast."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(0.98 * most / n * (1 << 30)))
