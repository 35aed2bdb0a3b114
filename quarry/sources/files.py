"""Text in and out: delimited files as COPY has them, JSON lines and Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def copy_in(spark: SparkSession, path: str, schema: str, form: str = "csv", header: bool = False, delimiter: str | None = None, null: str | None = None, quote: str = '"', escape: str = '"', key: str | None = None) -> DataFrame:
    """Rows of delimited text; those without a key are left out. Defaults are COPY's: csv
    has commas and empty nulls, text has tabs and backslash-N."""
    if form not in ("csv", "text"):
        raise ValueError(f"unknown format: {form!r}")
    csv = form == "csv"
    options = {
        "sep": delimiter or ("," if csv else "\t"),
        "nullValue": ("" if csv else "\\N") if null is None else null,
        "header": str(header).lower(),
        "quote": quote if csv else "",
        "escape": escape,
        "mode": "FAILFAST",
    }
    rows = spark.read.options(**options).schema(schema).csv(path)
    return rows if key is None else rows.filter(F.col(key).isNotNull())


def copy_out(df: DataFrame, path: str, form: str = "csv", header: bool = False, delimiter: str | None = None, null: str | None = None) -> None:
    csv = form == "csv"
    df.write.mode("overwrite").options(sep=delimiter or ("," if csv else "\t"), nullValue=("" if csv else "\\N") if null is None else null, header=str(header).lower(), quote='"' if csv else "", escape='"', emptyValue='""' if csv else "").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_lines(df: DataFrame) -> DataFrame:
    """A Markdown table's lines: the head's two with `part` 0, rows with 1."""
    cells = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"([|\\])", r"\\$1") for c in df.columns]
    rows = df.select(F.lit(1).alias("part"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    head = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return df.sparkSession.createDataFrame([(0, h) for h in head], "part int, value string").unionAll(rows)


def export_markdown(df: DataFrame, path: str) -> None:
    lines = markdown_lines(df)
    lines.select("part", "value").write.mode("overwrite").partitionBy("part").text(path)
