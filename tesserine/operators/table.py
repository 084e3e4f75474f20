"""A lazy, typed table with method chaining; every method adds to a DataFrame plan and nothing runs until an action.

Lambdas get a row whose attributes are columns and return columns: ``t.where(lambda r: r.qty < 24)``. A result is a
column (named ``value``), a dict of named columns, or for keys a tuple of columns. Tables are unordered unless sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Row:
    """A row of a plan: attributes and items are its columns."""

    def __init__(self, alias: str | None = None):
        self._alias = alias

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return F.col(f"`{self._alias}`.`{name}`" if self._alias else f"`{name}`")

    __getitem__ = __getattr__


Result = Column | dict[str, Any] | tuple
RowFn = Callable[[Row], Result]


def column(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def named(result: Result, single: str = "value") -> list[Column]:
    """The columns of a lambda's result."""
    if isinstance(result, dict):
        return [column(v).alias(k) for k, v in result.items()]
    if isinstance(result, tuple):
        return [column(v).alias(f"_{i}") for i, v in enumerate(result, 1)]
    return [column(result).alias(single)]


def parts(result: Result) -> list[Column]:
    """The columns of a key, without names."""
    return [column(v) for v in (result.values() if isinstance(result, dict) else result if isinstance(result, tuple) else [result])]


def int_average(x: Column) -> Column:
    """The average of whole numbers in their own type: the sum divided without remainder, toward zero; null without rows."""
    return F.call_function("div", F.sum(x), F.nullif(F.count(x), F.lit(0)))


def unused(df: DataFrame, name: str) -> str:
    """A column name like the given one that no column of df has, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def key_names(result: Result) -> list[str]:
    """The names of a key's columns, as named() gives them."""
    return list(result) if isinstance(result, dict) else [f"_{i}" for i, _ in enumerate(result, 1)] if isinstance(result, tuple) else ["key"]


#: What the extremes of an empty table are where the caller asks for the type's own bounds.
EMPTY_MIN = {"int": 2**31 - 1, "bigint": 2**63 - 1, "double": 1.7976931348623157e308}
EMPTY_MAX = {"int": -(2**31), "bigint": -(2**63), "double": -1.7976931348623157e308}


class Table:
    def __init__(self, df: DataFrame, keys: list[Column] | None = None):
        self.df, self._keys = df, keys

    # sources -----------------------------------------------------------------------------------------------

    @classmethod
    def of(cls, spark: SparkSession, rows: list, schema: str | T.StructType) -> Table:
        """Literal rows; scalars make a table of one column. No rows are an empty table."""
        return cls(spark.createDataFrame([r if isinstance(r, (tuple, dict, list)) else (r,) for r in rows], schema))

    @classmethod
    def range(cls, spark: SparkSession, start: int, end: int) -> Table:
        """The whole numbers from start up to end, without end."""
        return cls(spark.range(start, end).withColumnRenamed("id", "value"))

    @classmethod
    def parquet(cls, spark: SparkSession, path: str) -> Table:
        return cls(spark.read.parquet(path))

    # filter and projection ---------------------------------------------------------------------------------

    def where(self, f: Callable[[Row], Column]) -> Table:
        return Table(self.df.filter(f(Row())), self._keys)

    def select(self, f: RowFn) -> Table:
        return Table(self.df.select(*named(f(Row()))))

    def select_many(self, f: Callable[[Row], Column]) -> Table:
        """The elements of each row's array, flattened; rows with empty or null arrays give none, structs their fields."""
        one = self.df.select(f(Row()).alias("value"))
        kind = one.schema["value"].dataType.elementType
        return Table(one.select(F.inline("value") if isinstance(kind, T.StructType) else F.explode("value").alias("value")))

    # aggregates: tables of one row until an action ---------------------------------------------------------

    def aggregate(self, f: RowFn) -> Table:
        """Several aggregates in one pass."""
        return Table(self.df.agg(*named(f(Row()))))

    def sum(self, f: Callable[[Row], Column]) -> Table:
        """The sum; 0 for an empty table."""
        return Table(self.df.agg(F.coalesce(F.sum(f(Row())), F.lit(0)).alias("value")))

    def average(self, f: Callable[[Row], Column]) -> Table:
        return Table(self.df.agg(F.avg(f(Row())).alias("value")))

    def int_average(self, f: Callable[[Row], Column]) -> Table:
        return Table(self.df.agg(int_average(f(Row())).alias("value")))

    def _extreme(self, f: Callable[[Row], Column], agg: Callable, bounds: dict[str, Any], empty: str) -> Table:
        out = self.df.agg(agg(f(Row())).alias("value"))
        if empty == "bound":
            bound = F.lit(bounds.get(kind := out.dtypes[0][1])).cast(kind)
            out = out.select(F.coalesce("value", bound).alias("value"))
        return Table(out)

    def min(self, f: Callable[[Row], Column], empty: str = "null") -> Table:
        """The least value; for an empty table null, or the type's largest value with empty="bound"."""
        return self._extreme(f, F.min, EMPTY_MIN, empty)

    def max(self, f: Callable[[Row], Column], empty: str = "null") -> Table:
        return self._extreme(f, F.max, EMPTY_MAX, empty)

    def reduce(self, f: Callable[[Row], Column], zero: Any, merge: Callable[[Any, Any], Any]) -> Table:
        """The values of f merged by a function of two Python values, which must be associative with zero as its neutral
        element: each partition's first, then theirs. Null values take no part. Prefer an aggregate where one fits."""
        return Table(_merged(self.df.select(f(Row()).alias("value")), zero, merge))

    def for_each(self, f: Callable[[Any], None]) -> None:
        """Runs f on every row, for its effects, where the rows are; a task that is run again repeats them."""
        self.to_df().foreach(f)

    def count(self, p: Callable[[Row], Column] | None = None) -> Table:
        return Table(self.df.agg((F.count(F.lit(1)) if p is None else F.count_if(p(Row()))).alias("value")))

    def first(self) -> Table:
        """The first row in the order of the preceding sort."""
        return Table(self._sorted().limit(1))

    def last(self) -> Table:
        if not self._keys:
            raise ValueError("first and last need an order: sort the table before")
        return Table(self.df.orderBy(*map(_reverse, self._keys)).limit(1))

    # grouping ----------------------------------------------------------------------------------------------

    def group_by(self, f: RowFn) -> Grouped:
        key = f(Row())
        return Grouped(self, named(key, "key"), key_names(key))

    def distinct(self, key: RowFn | None = None, order: RowFn | None = None) -> Table:
        """Distinct rows; with a key, the first row of each key in the given order."""
        if key is None:
            return Table(self.df.distinct())
        if order is None:
            raise ValueError("the first row of a key needs an order")
        best, rank = Window.partitionBy(*parts(key(Row()))).orderBy(*parts(order(Row()))), unused(self.df, "rank")
        return Table(self.df.withColumn(rank, F.row_number().over(best)).filter(F.col(rank) == 1).drop(rank))

    # order and limit ---------------------------------------------------------------------------------------

    def order_by(self, *fs: Callable[[Row], Column]) -> Table:
        return self._by([(f(Row()), True) for f in fs], [])

    def order_by_descending(self, *fs: Callable[[Row], Column]) -> Table:
        return self._by([(f(Row()), False) for f in fs], [])

    def then_by(self, f: Callable[[Row], Column]) -> Table:
        """Refines the sort directly before it."""
        return self._by([(f(Row()), True)], self._need_keys())

    def then_by_descending(self, f: Callable[[Row], Column]) -> Table:
        return self._by([(f(Row()), False)], self._need_keys())

    def _need_keys(self) -> list:
        if not self._keys:
            raise ValueError("then_by must follow a sort")
        return self._keys

    def _by(self, keys: list, before: list) -> Table:
        return Table(self.df, [*before, *keys])

    def _sorted(self) -> DataFrame:
        if not self._keys:
            raise ValueError("first and last need an order: sort the table before")
        return self.df.orderBy(*(c.asc() if up else c.desc() for c, up in self._keys))

    def limit(self, n: int) -> Table:
        """At most n rows; after a sort the first n (planned as a top-n, not a full sort)."""
        return Table((self._sorted() if self._keys else self.df).limit(n))

    take = limit

    def at(self, i: int, order: RowFn) -> Table:
        """The row at position i, from 0, in the given order."""
        return Table(self.df.orderBy(*parts(order(Row()))).offset(i).limit(1))

    # set operations ----------------------------------------------------------------------------------------

    def union(self, other: Table) -> Table:
        """All rows of both (duplicates stay)."""
        return Table(self.df.unionByName(other.df))

    def intersect(self, other: Table) -> Table:
        """The multiset intersection."""
        return Table(self.df.intersectAll(other.df.select(*self.df.columns)))

    def except_(self, other: Table) -> Table:
        """The multiset difference (an extension)."""
        return Table(self.df.exceptAll(other.df.select(*self.df.columns)))

    # joins -------------------------------------------------------------------------------------------------

    def join(self, other: Table) -> Joinable:
        return Joinable(self, other)

    def semi_join(self, other: Table, mine: RowFn, theirs: RowFn, extra: Callable[[Row, Row], Column] | None = None) -> Table:
        """The rows with a partner in the other table."""
        return Table(self.df.alias("x").join(other.df.alias("y"), _equal(mine, theirs, extra), "left_semi"))

    def anti_join(self, other: Table, mine: RowFn, theirs: RowFn) -> Table:
        """The rows without a partner (an extension)."""
        return Table(self.df.alias("x").join(other.df.alias("y"), _equal(mine, theirs), "left_anti"))

    def where_least(self, key: RowFn, value: Callable[[Row], Column]) -> Table:
        """The rows that have their key's least value: a correlated minimum, as a minimum over the key's rows. Rows with a
        null in the key or value equal none, as in SQL."""
        least, v = unused(self.df, "least"), value(Row())
        known = [k.isNotNull() for k in parts(key(Row()))]
        return Table(self.df.filter(reduce(Column.__and__, known)).withColumn(least, F.min(v).over(Window.partitionBy(*parts(key(Row()))))).filter(v == F.col(least)).drop(least))

    # actions -----------------------------------------------------------------------------------------------

    def to_df(self) -> DataFrame:
        return self._sorted() if self._keys else self.df

    def to_array(self) -> list:
        """All rows on the driver: for results that are small by construction."""
        return self.to_df().collect()

    def size(self) -> int:
        return self.df.count()

    def scalar(self) -> Any:
        """The value of a table of one row and column."""
        return self.df.first()[0]


def _reverse(key: tuple[Column, bool]) -> Column:
    return key[0].desc() if key[1] else key[0].asc()


def _equal(mine: RowFn, theirs: RowFn, extra: Callable[[Row, Row], Column] | None = None) -> Column:
    x, y = Row("x"), Row("y")
    left, right = parts(mine(x)), parts(theirs(y))
    if len(left) != len(right):
        raise ValueError("the keys of a join must have as many parts on both sides")
    out = left[0] == right[0]
    for a, b in zip(left[1:], right[1:], strict=True):
        out &= a == b
    return out & extra(x, y) if extra else out


class Joinable:
    """An equi-join in the making: ``a.join(b).where(p).where_eq(ka, kb).select(f)``; Catalyst chooses how it is run."""

    def __init__(self, left: Table, right: Table, on: Column | None = None):
        self.left, self.right, self.on = left, right, on

    def where(self, p: Callable[[Row], Column]) -> Joinable:
        """Filters the second table."""
        return Joinable(self.left, self.right.where(p), self.on)

    def where_eq(self, mine: RowFn, theirs: RowFn) -> Joinable:
        return Joinable(self.left, self.right, _equal(mine, theirs))

    def select(self, f: Callable[[Row, Row], Result], how: str = "inner") -> Table:
        """The joined rows; other kinds of join than inner are an extension."""
        if self.on is None:
            raise ValueError("where_eq must come before select")
        return Table(self.left.df.alias("x").join(self.right.df.alias("y"), self.on, how).select(*named(f(Row("x"), Row("y")))))


class Group:
    """One group inside ``select``: its methods are aggregate columns, so that groups are never built."""

    def __init__(self, key: dict[str, Column], condition: Column | None = None):
        self._key, self._condition = key, condition

    @property
    def key(self) -> Any:
        if len(self._key) == 1:
            return next(iter(self._key.values()))
        return type("Key", (), self._key | {f"_{i}": c for i, c in enumerate(self._key.values(), 1)})

    def where(self, p: Callable[[Row], Column]) -> Group:
        """The rows of the group that satisfy p; what follows is over them alone."""
        return Group(self._key, p(Row()) if self._condition is None else self._condition & p(Row()))

    def _of(self, f: Callable[[Row], Column]) -> Column:
        return f(Row()) if self._condition is None else F.when(self._condition, f(Row()))

    def sum(self, f: Callable[[Row], Column]) -> Column:
        """The sum; 0 where where() leaves the group no rows."""
        total = F.sum(self._of(f))
        return total if self._condition is None else F.when(F.count_if(self._condition) > 0, total).otherwise(F.lit(0))

    def average(self, f: Callable[[Row], Column]) -> Column:
        return F.avg(self._of(f))

    def int_average(self, f: Callable[[Row], Column]) -> Column:
        return int_average(self._of(f))

    def min(self, f: Callable[[Row], Column]) -> Column:
        return F.min(self._of(f))

    def max(self, f: Callable[[Row], Column]) -> Column:
        return F.max(self._of(f))

    def count(self, p: Callable[[Row], Column] | None = None) -> Column:
        tests = [c for c in (self._condition, p(Row()) if p else None) if c is not None]
        if not tests:
            return F.count(F.lit(1))
        return F.count_if(tests[0] if len(tests) == 1 else tests[0] & tests[1])

    def first(self, f: Callable[[Row], Column], order: Callable[[Row], Column]) -> Column:
        return F.min_by(self._of(f), self._of(order))

    def last(self, f: Callable[[Row], Column], order: Callable[[Row], Column]) -> Column:
        return F.max_by(self._of(f), self._of(order))

    def count_distinct(self, f: Callable[[Row], Column]) -> Column:
        return F.count_distinct(self._of(f))

    def values(self, f: Callable[[Row], Column]) -> Column:
        """The group's values as an array, in no particular order; the group's must fit in memory, as in what follows."""
        return F.collect_list(self._of(f))

    def distinct(self, f: Callable[[Row], Column]) -> Column:
        """The group's distinct values, in ascending order."""
        return F.sort_array(F.collect_set(self._of(f)))

    def order_by(self, f: Callable[[Row], Column], order: Callable[[Row], Column]) -> Column:
        """The group's values in the order of another (ties by value)."""
        pairs = F.collect_list(self._of(lambda r: F.struct(order(r).alias("o"), f(r).alias("v"))))
        return F.transform(F.array_sort(pairs), lambda p: p["v"])

    def select_many(self, f: Callable[[Row], Column]) -> Column:
        """The elements of the arrays of all the group's rows, in no particular order."""
        return F.flatten(F.collect_list(self._of(f)))


def _merged(values: DataFrame, zero: Any, merge: Callable[[Any, Any], Any]) -> DataFrame:
    """One row: the values merged, in partitions first. Each partition gives one row, and one task merges these."""
    schema = to_arrow_schema(values.schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = zero
        for batch in batches:
            for x in batch["value"].to_pylist():
                if x is not None:
                    total = merge(total, x)
        yield pa.RecordBatch.from_pylist([{"value": total}], schema)

    return values.mapInArrow(fold, values.schema).repartition(1).mapInArrow(fold, values.schema)


class Grouped:
    def __init__(self, table: Table, key: list[Column], names: list[str]):
        self.table, self._key, self._names = table, key, names

    def _own(self) -> list[str]:
        """Names of the keys that no column of the table has, so that they hide none from the aggregates."""
        return [unused(self.table.df, f"{n}_{i}_of_key") for i, n in enumerate(self._names)]

    def select(self, f: Callable[[Group], Result]) -> Table:
        """One row for each group: partial and final aggregation of everything in one pass."""
        own = self._own()
        result = f(Group({n: F.col(f"`{o}`") for n, o in zip(self._names, own, strict=True)}))
        outputs = key_names(result) if isinstance(result, (dict, tuple)) else ["value"]
        return Table(self.table.df.groupBy(*(c.alias(o) for c, o in zip(self._key, own, strict=True))).agg(*named(result)).select(*(F.col(f"`{o}`") for o in outputs)))

    def select_many(self, f: Callable[[Row], Column]) -> Table:
        """The values of all groups, flattened: grouping moves rows but drops none."""
        return self.table.select(f)

    def reduce(self, f: Callable[[Row], Column], zero: Any, merge: Callable[[Any, Any], Any], salts: int = 32) -> Table:
        """key and value: each group's values merged by an associative function of two Python values with zero as its
        neutral element. A group's rows are dealt over salts first, whose results are merged then; nulls take no part."""
        rows = self.table.df.select(*(c.alias(n) for c, n in zip(self._key, self._names, strict=True)), f(Row()).alias("value"))
        kind = rows.schema
        if "value" in self._names:
            raise ValueError("a key must not be named value")

        def merged(df: DataFrame, extra: list[str]) -> DataFrame:
            def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = zero
                for batch in batches:
                    for x in batch["value"].to_pylist():
                        if x is not None:
                            total = merge(total, x)
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, [*(k.as_py() for k in key[: len(kind) - 1]), total], strict=True))], to_arrow_schema(kind))

            return df.groupBy(*(F.col(f"`{n}`") for n in self._names), *extra).applyInArrow(fold, kind)

        salt = unused(rows, "salt")
        dealt = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        return Table(merged(merged(dealt, [salt]), []))

    def groups(self) -> Table:
        """key and values (an array of the group's rows). Groups must fit in memory; prefer select."""
        key = self._key[0] if len(self._key) == 1 else F.struct(*self._key).alias("key")
        return Table(self.table.df.groupBy(key).agg(F.collect_list(F.struct(*self.table.df.columns)).alias("values")))

    def keys(self) -> Table:
        return Table(self.table.df.select(*self._key).distinct())
