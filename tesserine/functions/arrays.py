"""The parallel collection patterns on array and map columns, all inside the JVM.

Positions start at 0. Reductions must be associative. ``zip`` demands equal lengths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]
Fn2 = Callable[[Column, Column], Column]


def indices(start: Column | int, end: Column | int) -> Column:
    """start up to end, without end; empty if there is none."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))


def from_function(n: Column | int, f: Fn) -> Column:
    return F.transform(indices(0, n), f)


def map_(a: Column, f: Fn) -> Column:
    return F.transform(a, f)


def flat_map(a: Column, f: Fn) -> Column:
    return F.flatten(F.transform(a, f))


def filter_(a: Column, p: Fn, f: Fn | None = None) -> Column:
    kept = F.filter(a, p)
    return F.transform(kept, f) if f else kept


def zip_(a: Column, b: Column, f: Fn2) -> Column:
    """Elementwise f; raises where the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f)).otherwise(F.raise_error(F.lit("zip of unequal lengths")))


def reduce_(a: Column, zero: Column, f: Fn2) -> Column:
    return F.aggregate(a, zero, f)


def map_reduce(a: Column, f: Fn, zero: Column, g: Fn2) -> Column:
    return F.aggregate(F.transform(a, f), zero, g)


def filter_reduce(a: Column, p: Fn, f: Fn, zero: Column, g: Fn2) -> Column:
    return F.aggregate(F.transform(F.filter(a, p), f), zero, g)


def filter_reduce_fold(a: Column, p: Fn, zero: Column, step: Fn2, first: Fn) -> Column:
    """What the first component of an accumulator is after a step for each element that satisfies p; zero is the
    accumulator (a struct) before the first, first gives the result from it."""
    return F.aggregate(F.filter(a, p), zero, step, first)


def map_of(a: Column, key: Fn, value: Fn) -> Column:
    """A map from each key to a value; of elements with equal keys the first one's value stays."""
    keys = F.transform(a, key)
    firsts = F.filter(F.transform(a, lambda x, i: F.struct(key(x).alias("key"), value(x).alias("value"), i.alias("i"))), lambda e: F.array_position(keys, e["key"]) == e["i"] + 1)
    return F.map_from_entries(F.transform(firsts, lambda e: F.struct(e["key"], e["value"])))


def map_entries(m: Column) -> Column:
    """The entries of a map, by key."""
    return F.array_sort(F.map_entries(m))


def map_map(m: Column, f: Fn2) -> Column:
    """A map with the same keys and f(key, value) as values."""
    return F.transform_values(m, f)


def map_filter(m: Column, p: Fn2) -> Column:
    return F.map_filter(m, p)


def map_reduce_values(m: Column, zero: Column, g: Fn2) -> Column:
    return F.aggregate(F.map_values(m), zero, g)


def head(a: Column) -> Column:
    """The first element, null if there is none."""
    return F.get(a, F.lit(0))


def partition(a: Column, p: Fn) -> Column:
    """Two arrays as a struct: the elements that satisfy p and the others (nulls of p included)."""
    holds = lambda x: F.coalesce(p(x), F.lit(False))
    return F.struct(F.filter(a, holds).alias("yes"), F.filter(a, lambda x: ~holds(x)).alias("no"))


def histogram(a: Column, low: float, high: float, bins: int) -> Column:
    """How many elements fall into each of equal bins from low up to high; elements outside count nowhere."""
    width = (high - low) / bins
    at = F.transform(F.filter(a, lambda x: (x >= low) & (x < high)), lambda x: F.least(F.floor((x - low) / width), F.lit(bins - 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(at, lambda x: x == b)))


def arithmetic(a: Column, b: Column, fields: list[str], op: Fn2) -> Column:
    """A record whose fields are op of both records' fields."""
    return F.struct(*(op(a[f], b[f]).alias(f) for f in fields))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(zip_(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def arg_min(a: Column) -> Column:
    """The position of the least element (the first of equals)."""
    return F.array_min(F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i"))))["i"]


def sort_indices(a: Column) -> Column:
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i")))), lambda s: s["i"])


def take(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def sort(a: Column) -> Column:
    return F.sort_array(a)


def update(a: Column, at: int, value: Column) -> Column:
    return F.transform(a, lambda x, i: F.when(i == at, value).otherwise(x))


def insert(a: Column, at: int, value: Column) -> Column:
    return F.array_insert(a, at + 1, value)


def append(a: Column, value: Column) -> Column:
    return F.array_append(a, value)


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def intersect(a: Column, b: Column) -> Column:
    """The multiset intersection, in a's order: the n-th copy of a value stays if b has n copies or more."""
    nth = F.transform(a, lambda x, i: F.struct(x.alias("v"), F.size(F.filter(F.slice(a, F.lit(1), i + 1), lambda y: y == x)).alias("n")))
    return F.transform(F.filter(nth, lambda s: F.size(F.filter(b, lambda y: y == s["v"])) >= s["n"]), lambda s: s["v"])


def make_string(a: Column, separator: str = "") -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), separator)


def bound(a: Column, f: Fn) -> Column:
    """f of a, which is computed once however often f names it."""
    return F.get(F.transform(F.array(a), f), F.lit(0))


def pairs(a: Column) -> Column:
    """Neighbouring elements as structs (src, dst); null for fewer than two."""

    def neighbours(x: Column) -> Column:
        n = F.size(x)
        return F.when(n > 1, F.zip_with(F.slice(x, F.lit(1), n - 1), F.slice(x, F.lit(2), n - 1), lambda p, q: F.struct(p.alias("src"), q.alias("dst"))))

    return bound(a, neighbours)


def group_by(a: Column, key: Fn) -> Column:
    """A map from key to the elements with it."""
    keys = F.array_distinct(F.transform(a, key))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.filter(a, lambda x: key(x) == k))))


def group_by_reduce(a: Column, key: Fn, value: Fn, zero: Column, g: Fn2) -> Column:
    keys = F.array_distinct(F.transform(a, key))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.aggregate(F.transform(F.filter(a, lambda x: key(x) == k), value), zero, g))))


def build_index(a: Column) -> Column:
    """A map from each distinct element to its place among the distinct ones."""
    d = F.array_distinct(a)
    return F.map_from_arrays(d, F.transform(d, lambda x, i: i))


def map_get(m: Column, k: Column) -> Column:
    """The value of a key, null if it is missing."""
    return F.try_element_at(m, k)


def map_contains(m: Column, k: Column) -> Column:
    return F.map_contains_key(m, k)


def find(a: Column, p: Fn) -> Column:
    """The first element that satisfies p, else null."""
    return F.get(F.filter(a, p), F.lit(0))
