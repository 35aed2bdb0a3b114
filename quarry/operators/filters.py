"""Fluent filters and queries: conditions become columns, so pushdown and pruning are Spark's."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Filter:
    """A chain of conditions. `and_`, `or_` and `not_` open a nested chain that `end` closes.
    Missing values never match, also not under `not_`, as in SQL."""

    def __init__(self, kind: str = "and", parent: Filter | None = None):
        self.kind, self.parent, self.parts = kind, parent, []

    def _add(self, condition: Column) -> Filter:
        self.parts.append(condition)
        return self

    def eq(self, name: str, value) -> Filter:
        return self._add(F.col(name) == value)

    def not_eq(self, name: str, value) -> Filter:
        return self._add(F.col(name) != value)

    def gt(self, name: str, value) -> Filter:
        return self._add(F.col(name) > value)

    def gte(self, name: str, value) -> Filter:
        return self._add(F.col(name) >= value)

    def lt(self, name: str, value) -> Filter:
        return self._add(F.col(name) < value)

    def lte(self, name: str, value) -> Filter:
        return self._add(F.col(name) <= value)

    def between(self, name: str, low, high) -> Filter:
        return self._add(F.col(name).between(low, high))

    def is_in(self, name: str, values: list) -> Filter:
        return self._add(F.col(name).isin(values))

    def contains_any(self, name: str, values: list) -> Filter:
        return self._add(F.arrays_overlap(name, F.array(*map(F.lit, values))))

    def contains_all(self, name: str, values: list) -> Filter:
        return self._add(reduce(and_, (F.array_contains(name, v) for v in values), F.lit(True)))

    def exact_match(self, name: str, values: list) -> Filter:
        return self._add(F.sort_array(name) == F.array(*map(F.lit, sorted(values))))

    def and_(self) -> Filter:
        return Filter("and", self)

    def or_(self) -> Filter:
        return Filter("or", self)

    def not_(self) -> Filter:
        return Filter("not", self)

    def end(self) -> Filter:
        if self.parent is None:
            raise ValueError("end() without an open chain")
        return self.parent._add(self._own())

    def _own(self) -> Column:
        if not self.parts:
            return F.lit(True)
        joined = reduce(or_ if self.kind == "or" else and_, self.parts)
        return ~joined if self.kind == "not" else joined

    def column(self) -> Column:
        if self.parent is not None:
            raise ValueError("a nested chain is still open")
        return self._own()


def where() -> Filter:
    return Filter()


class Query:
    """Filters first, then nearest neighbours or a list: exact, with k rows where k exist."""

    def __init__(self, df: DataFrame):
        self.df, self.vector, self.k, self.least, self.metric, self.column = df, None, None, None, "cosine", "embedding"

    def where(self, condition: Filter) -> Query:
        self.df = self.df.filter(condition.column())
        return self

    def within(self, ids: DataFrame, key: str) -> Query:
        """Only rows whose key is among ids, such as the result of a traversal."""
        self.df = self.df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
        return self

    def with_vector(self, vector: list[float], column: str = "embedding", metric: str = "cosine") -> Query:
        self.vector, self.column, self.metric = vector, column, metric
        return self

    def with_threshold(self, least: float) -> Query:
        self.least = least
        return self

    def limit(self, k: int) -> Query:
        self.k = k
        return self

    def list(self) -> DataFrame:
        return self.df if self.k is None else self.df.limit(self.k)

    def execute(self, key: str) -> DataFrame:
        from quarry.functions.vectors import score

        if self.vector is None:
            return self.list()
        found = self.df.withColumn("score", score(F.col(self.column), self.vector, self.metric))
        if self.least is not None:
            found = found.filter(F.col("score") >= self.least)
        return found if self.k is None else found.orderBy(F.desc("score"), key).limit(self.k)


_TRUE, _FALSE = frozenset({"true", "t", "yes", "1"}), frozenset({"false", "f", "no", "0"})


def parse_value(text: str, kind: str | None = None):
    """A value of the kind from text: string, int, float, bool, and arrays of them; without
    a kind it is told from the text."""
    if kind is None:
        for guess in ("int", "float", "bool"):
            try:
                return parse_value(text, guess)
            except ValueError:
                continue
        return text
    if kind.endswith("[]"):
        return [parse_value(x.strip(), kind[:-2]) for x in text.strip("[]").split(",") if x.strip()]
    if kind == "bool":
        low = text.lower()
        if low in _TRUE or low in _FALSE:
            return low in _TRUE
        raise ValueError(f"not a boolean: {text!r}")
    if kind not in ("string", "int", "float"):
        raise ValueError(f"unknown kind: {kind!r}")
    return {"string": str, "int": int, "float": float}[kind](text)
