"""Changes to tables and their history, as DataFrames.

A change takes rows and returns rows; what to write, and where, is the caller's choice.
History has one row for each version: the table's columns, begin_lsn and end_lsn (null:
current). A commit table (lsn, ts) tells the times.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.recursive import kept


class ConstraintError(ValueError):
    """A change would break a constraint."""


# --- changes ----------------------------------------------------------------------------


def insert(df: DataFrame, new: DataFrame, key: list[str], on_conflict: str = "error") -> DataFrame:
    """Rows of both; of a key that is there already the old row with `nothing`, and with
    `error` none may be."""
    if on_conflict == "nothing":
        fresh = new.dropDuplicates(key).join(df.select(key), key, "left_anti")
    elif on_conflict == "error":
        fresh = new
        if not new.groupBy(key).count().filter("count > 1").isEmpty() or not new.join(df.select(key), key, "left_semi").isEmpty():
            raise ConstraintError(f"a row with this {', '.join(key)} exists")
    else:
        raise ValueError(f"unknown choice on conflict: {on_conflict!r}")
    return df.unionByName(fresh.select(df.columns))


def upsert(df: DataFrame, new: DataFrame, key: list[str], update: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """New rows, and old ones with `update` where their key is among the new ones. In the
    expressions the old row's columns are old.x, the new row's excluded.x. Without update
    all columns come from the new row."""
    columns = df.columns
    old, excluded = df.withColumn("_old", F.lit(True)).alias("old"), new.withColumn("_new", F.lit(True)).alias("excluded")
    both = old.join(excluded, [F.col(f"old.{k}").eqNullSafe(F.col(f"excluded.{k}")) for k in key], "full")
    change = F.col("_old") & F.col("_new") & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    update = {c: F.col(f"excluded.{c}") for c in columns if c not in key} if update is None else update
    out = []
    for c in columns:
        kept = F.when(change, update[c]).otherwise(F.col(f"old.{c}")) if c in update else F.col(f"old.{c}")
        out.append(F.when(F.col("_old"), kept).otherwise(F.col(f"excluded.{c}")).alias(c))
    return both.select(out)


def update(df: DataFrame, changes: dict[str, Column], where: Column) -> DataFrame:
    """All expressions see the old row."""
    hit = F.coalesce(where, F.lit(False))
    return df.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns))


def delete(df: DataFrame, where: Column | None) -> DataFrame:
    if where is None:
        raise ValueError("a delete needs a condition")
    return df.filter(~F.coalesce(where, F.lit(False)))


def returning(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows of `after` whose key `before` lacks, or that it has otherwise. The key is unique."""
    old = before.select(*(F.col(c).alias(f"_old_{c}") for c in after.columns), F.lit(True).alias("_there"))
    same = lambda names: reduce(and_, [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in names], F.lit(True))
    both = after.join(old, same(key), "left")
    return both.filter(F.col("_there").isNull() | ~same([c for c in after.columns if c not in key])).select(columns)


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_key: tuple[str, ...]
    on_delete: str = "no action"  # cascade, restrict, set null, set default


def delete_cascade(tables: dict[str, DataFrame], keys: dict[str, list[ForeignKey]], name: str, where: Column, defaults: dict[str, dict] | None = None, depth: int = 16) -> dict[str, DataFrame]:
    """All tables after rows of one are deleted, by the actions of keys that point to them.
    Each step is an anti join by key for each reference. Only the columns of deleted rows
    that others point to are carried on, written once for each level; depth bounds chains of
    tables that point to themselves."""
    out = dict(tables)

    def referred(table: str, rows: DataFrame) -> DataFrame | None:
        columns = sorted({c for own in keys.values() for fk in own if fk.parent == table for c in fk.parent_key})
        return kept(rows.select(columns).distinct()) if columns else None

    hit = F.coalesce(where, F.lit(False))
    out[name] = tables[name].filter(~hit)
    gone: list[tuple[str, DataFrame | None]] = [(name, referred(name, tables[name].filter(hit)))]
    for _ in range(depth):
        following: list[tuple[str, DataFrame | None]] = []
        for table, rows in gone:
            if rows is None:
                continue
            for child, fk in ((child, fk) for child, own in keys.items() for fk in own if fk.parent == table):
                parents = rows.select(*(F.col(p).alias(c) for p, c in zip(fk.parent_key, fk.columns))).distinct()
                own, on = out[child], list(fk.columns)
                if fk.on_delete == "cascade":
                    following.append((child, referred(child, own.join(parents, on, "left_semi"))))
                    out[child] = own.join(parents, on, "left_anti").select(own.columns)
                elif fk.on_delete in ("set null", "set default"):
                    kinds = dict(own.dtypes)
                    values = {c: F.lit((defaults or {}).get(child, {}).get(c) if fk.on_delete == "set default" else None).cast(kinds[c]) for c in on}
                    marked = own.join(parents.withColumn("_gone", F.lit(True)), on, "left")
                    out[child] = marked.select(*(F.when(F.col("_gone"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in own.columns))
                elif not own.join(parents, on, "left_semi").isEmpty():
                    raise ConstraintError(f"{child} has rows that point to {table}")
        gone = [(t, r) for t, r in following if r is not None and not r.isEmpty()]
        if not gone:
            return out
    raise ConstraintError("rows point to each other in a cycle, or too deep")


def check(df: DataFrame, condition: Column, name: str = "check") -> DataFrame:
    """df, if the condition is nowhere false; null passes."""
    if not df.filter(~condition).isEmpty():
        raise ConstraintError(f"{name} fails")
    return df


def check_not_null(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        if not df.filter(F.col(c).isNull()).isEmpty():
            raise ConstraintError(f"{c} has nulls")
    return df


def check_unique(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a null in one of the columns don't count."""
    rows = df.dropna(subset=list(columns))
    if not rows.groupBy(*columns).count().filter("count > 1").isEmpty():
        raise ConstraintError(f"{', '.join(columns)} isn't unique")
    return df


def check_reference(df: DataFrame, fk: ForeignKey, parent: DataFrame) -> DataFrame:
    own = df.dropna(subset=list(fk.columns))
    missing = own.join(parent.select(*(F.col(p).alias(c) for p, c in zip(fk.parent_key, fk.columns))), list(fk.columns), "left_anti")
    if not missing.isEmpty():
        raise ConstraintError(f"{', '.join(fk.columns)} points to rows that {fk.parent} lacks")
    return df


def update_if_version(df: DataFrame, key: Column, version: int, changes: dict[str, Column], column: str = "version") -> DataFrame:
    """Compare and set: an error unless the row has the expected version."""
    if df.filter(key & (F.col(column) == version)).isEmpty():
        raise ConstraintError("the row has another version")
    return update(df, {**changes, column: F.col(column) + 1}, key)


# --- history ----------------------------------------------------------------------------


def history(changes: DataFrame, key: list[str], lsn: str = "lsn", deleted: str | None = None) -> DataFrame:
    """Versions from a log of changes: each row holds until the next one of its key. Rows
    that `deleted` marks end the version before and aren't versions."""
    after = Window.partitionBy(key).orderBy(lsn)
    out = changes.withColumn("end_lsn", F.lead(lsn).over(after)).withColumnRenamed(lsn, "begin_lsn")
    return out if deleted is None else out.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def lsn_at(commits: DataFrame, ts) -> int:
    """The last commit at or before a time; an error before the oldest."""
    found = commits.filter(F.col("ts") <= F.lit(ts)).agg(F.max("lsn")).first()[0]
    if found is None:
        raise ValueError("the time is before the oldest commit")
    return found


def as_of(rows: DataFrame, lsn: int, oldest: int | None = None) -> DataFrame:
    """Rows visible at a commit."""
    if oldest is not None and lsn < oldest:
        raise ValueError("history of this commit wasn't retained")
    return rows.filter((F.col("begin_lsn") <= lsn) & (F.col("end_lsn").isNull() | (F.col("end_lsn") > lsn)))


def versions_between(rows: DataFrame, commits: DataFrame, start, end) -> DataFrame:
    """Versions whose validity meets [start, end], with version_start and version_end."""
    first, last = commits.filter(F.col("ts") <= F.lit(start)).agg(F.max("lsn")).first()[0], lsn_at(commits, end)
    first = -1 if first is None else first
    hit = rows.filter((F.col("begin_lsn") <= last) & (F.col("end_lsn").isNull() | (F.col("end_lsn") > first)))
    begins, ends = commits.select(F.col("lsn").alias("begin_lsn"), F.col("ts").alias("version_start")), commits.select(F.col("lsn").alias("end_lsn"), F.col("ts").alias("version_end"))
    return hit.join(begins, "begin_lsn", "left").join(ends, "end_lsn", "left")


def retain(rows: DataFrame, boundary: int) -> DataFrame:
    """History without versions that ended at or before a commit."""
    return rows.filter(F.col("end_lsn").isNull() | (F.col("end_lsn") > boundary))


def commit(rows: DataFrame, changes: DataFrame, key: list[str], lsn: int, deleted: str | None = None) -> DataFrame:
    """History after a commit: current versions of changed keys end, new ones begin."""
    keys = changes.select(key).distinct().withColumn("_hit", F.lit(True))
    ended = rows.join(keys, key, "left").withColumn("end_lsn", F.when(F.col("_hit") & F.col("end_lsn").isNull(), F.lit(lsn).cast("long")).otherwise(F.col("end_lsn"))).drop("_hit")
    fresh = changes if deleted is None else changes.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)
    fresh = fresh.withColumn("begin_lsn", F.lit(lsn).cast("long")).withColumn("end_lsn", F.lit(None).cast("long"))
    return ended.select(rows.columns).unionByName(fresh.select(rows.columns))


class Overlay:
    """A table with staged changes over it, and save points. Nothing is written before the
    caller writes `current`."""

    def __init__(self, base: DataFrame, key: list[str]):
        self.current, self.key, self._points = base, key, []

    def stage(self, change) -> Overlay:
        self.current = change(self.current)
        return self

    def savepoint(self, name: str) -> Overlay:
        self._points.append((name, self.current))
        return self

    def rollback_to(self, name: str) -> Overlay:
        while self._points and self._points[-1][0] != name:
            self._points.pop()
        if not self._points:
            raise ValueError(f"no save point {name!r}")
        self.current = self._points[-1][1]
        return self

    def release(self, name: str) -> Overlay:
        while self._points and self._points.pop()[0] != name:
            pass
        return self
