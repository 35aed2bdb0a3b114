"""Rows of two engines as comparable text."""

from __future__ import annotations

import math


def norm(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    rel = con.sql(sql)
    names = list(rel.columns)
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
