"""Tables of a data folder: one Parquet file or folder each."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def ship(spark: SparkSession) -> None:
    """Gives executors this library, once for each session."""
    context = spark.sparkContext
    if not getattr(context, "_quarry", False):
        context._quarry = True
        root = Path(__file__).resolve().parents[1]
        name = f"{tempfile.mkdtemp()}/quarry.zip"
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(name)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql(spark: SparkSession, folder: str, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """A query over the folder's tables by their names, with named parameters. Only tables
    that the text names are looked up; frames add or replace tables."""
    own = {n: read(spark, folder, n) for n in NAMES if n not in frames and n in text} | frames
    for name, df in own.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args) if args else spark.sql(text)
