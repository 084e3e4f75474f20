"""The collection patterns, on the embeddings' arrays and on plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions import arrays as A
from tesserine.operators.table import Table
from tesserine.plans.registry import Tables, query

#: Whole numbers from the first half of the components and from the second.
INTS = "list_transform(embedding[1:len(embedding)//2], lambda x: CAST(floor(x * 40) AS INTEGER))"


def ints(t: Tables) -> Table:
    def whole(x):
        # SQL multiplies as float; with a whole number Spark would multiply as double, and next to whole numbers floors differ
        return F.floor(x * F.lit(40).cast("float")).cast("int")

    def halves(e):
        half = F.floor(F.size(e.embedding) / 2).cast("int")
        return {"vec_id": e.vec_id, "a": F.transform(F.slice(e.embedding, F.lit(1), half), whole), "b": F.transform(F.slice(e.embedding, half + 1, F.size(e.embedding)), whole)}

    return t.embeddings.select(halves)


BASE = f"WITH v AS (SELECT vec_id, {INTS} AS a, list_transform(embedding[len(embedding)//2+1:], lambda x: CAST(floor(x * 40) AS INTEGER)) AS b FROM embeddings) "


def one(name: str, sql: str, f) -> None:
    """Registers one expression on the arrays a and b."""
    query(f"{BASE}SELECT vec_id, {sql} AS r FROM v", f"arr_{name}")(lambda t: ints(t).select(lambda e: {"vec_id": e.vec_id, "r": f(e)}))


one("map", "list_transform(a, lambda x: x * 2)", lambda e: A.map_(e.a, lambda x: x * 2))
one("flat_map", "flatten(list_transform(a, lambda x: [x, x + 1]))", lambda e: A.flat_map(e.a, lambda x: F.array(x, x + 1)))
one("from_function", "list_transform(range(0, len(a)), lambda i: CAST(i * i AS INTEGER))", lambda e: A.from_function(F.size(e.a), lambda i: i * i))
one("filter", "list_transform(list_filter(a, lambda x: x > 0), lambda x: x + 10)", lambda e: A.filter_(e.a, lambda x: x > 0, lambda x: x + 10))
one("zip", "list_transform(range(1, len(a) + 1), lambda i: a[i] - b[i])", lambda e: A.zip_(e.a, e.b, lambda x, y: x - y))
one("reduce", "CAST(list_sum(a) AS INTEGER)", lambda e: A.reduce_(e.a, F.lit(0), lambda s, x: s + x))
one("map_reduce", "CAST(list_sum(list_transform(a, lambda x: x * x)) AS INTEGER)", lambda e: A.map_reduce(e.a, lambda x: x * x, F.lit(0), lambda s, x: s + x))
one("filter_reduce", "CAST(coalesce(list_sum(list_filter(a, lambda x: x > 0)), 0) AS INTEGER)", lambda e: A.filter_reduce(e.a, lambda x: x > 0, lambda x: x, F.lit(0), lambda s, x: s + x))
one("zip_reduce", "CAST(list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i])) AS DOUBLE)", lambda e: A.dot(e.a, e.b))
one("arg_min", "CAST(list_position(a, list_min(a)) - 1 AS INTEGER)", lambda e: A.arg_min(e.a))
one("sort", "list_sort(a)", lambda e: A.sort(e.a))
one("sort_indices", "list_transform(list_sort(list_transform(range(0, len(a)), lambda i: struct_pack(v := a[i + 1], i := i))), lambda s: CAST(s.i AS INTEGER))", lambda e: A.sort_indices(e.a))
one("take", "a[1:3]", lambda e: A.take(e.a, 3))
one("length", "CAST(len(a) AS INTEGER)", lambda e: F.size(e.a))
one("apply", "a[3]", lambda e: F.get(e.a, F.lit(2)))
one("update", "list_concat(a[1:2], list_concat([CAST(99 AS INTEGER)], a[4:]))", lambda e: A.update(e.a, 2, F.lit(99)))
one("insert", "list_concat(a[1:2], list_concat([CAST(99 AS INTEGER)], a[3:]))", lambda e: A.insert(e.a, 2, F.lit(99)))
one("append", "list_append(a, CAST(7 AS INTEGER))", lambda e: A.append(e.a, F.lit(7)))
one("union", "list_concat(a, b)", lambda e: A.concat(e.a, e.b))
one("mk_string", "array_to_string(a, ',')", lambda e: A.make_string(e.a, ","))
one("find", "list_filter(a, lambda x: x > 0)[1]", lambda e: A.find(e.a, lambda x: x > 0))
one("group_by", "list_sort(list_filter(a, lambda x: x % 2 = 0))", lambda e: F.sort_array(F.coalesce(A.map_get(A.group_by(e.a, lambda x: x % 2 == 0), F.lit(True)), F.array().cast("array<int>"))))
one("group_by_reduce", "CAST(coalesce(list_sum(list_filter(a, lambda x: x % 2 = 0)), 0) AS INTEGER)", lambda e: F.coalesce(A.map_get(A.group_by_reduce(e.a, lambda x: x % 2 == 0, lambda x: x, F.lit(0), lambda s, x: s + x), F.lit(True)), F.lit(0)))
one("map_size", "CAST(len(list_distinct(a)) AS INTEGER)", lambda e: F.size(A.build_index(e.a)))
one("map_contains", "list_contains(a, 0)", lambda e: A.map_contains(A.build_index(e.a), F.lit(0)))
one("map_keys", "list_sort(list_distinct(a))", lambda e: F.sort_array(F.map_keys(A.build_index(e.a))))
one("map_values", "list_transform(range(0, len(list_distinct(a))), lambda i: CAST(i AS INTEGER))", lambda e: F.sort_array(F.map_values(A.build_index(e.a))))
one("filter_reduce_fold", "CAST(coalesce(list_sum(list_filter(a, lambda x: x > 0)), 0) AS INTEGER)", lambda e: A.filter_reduce_fold(e.a, lambda x: x > 0, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + 1).alias("n")), lambda s: s["sum"]))
one("map_build", "list_sort(list_distinct(list_transform(a, lambda x: x % 3)))", lambda e: F.sort_array(F.map_keys(A.map_of(e.a, lambda x: x % 3, lambda x: x))))
one("map_first_wins", "list_filter(a, lambda x: x % 3 = 0)[1]", lambda e: A.map_get(A.map_of(e.a, lambda x: x % 3, lambda x: x), F.lit(0)))
one("map_entries", "list_transform(list_sort(list_distinct(a)), lambda x: CAST(x * 100 + list_position(list_distinct_kept, x) AS INTEGER))".replace("list_distinct_kept", "list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda y: y IS NOT NULL)"), lambda e: F.transform(A.map_entries(A.build_index(e.a)), lambda x: x["key"] * 100 + x["value"] + 1))
one("map_reduce_values", "CAST(len(list_distinct(a)) * (len(list_distinct(a)) - 1) / 2 AS INTEGER)", lambda e: A.map_reduce_values(A.build_index(e.a), F.lit(0), lambda s, x: s + x))
one("map_filter_map", "CAST(coalesce(list_sum(list_filter(list_distinct(a), lambda x: x > 0)), 0) * 2 AS INTEGER)", lambda e: A.map_reduce_values(A.map_map(A.map_filter(A.build_index(e.a), lambda k, v: k > 0), lambda k, v: k * 2), F.lit(0), lambda s, x: s + x))
one("head", "a[1]", lambda e: A.head(e.a))
one("partition", "list_concat(list_filter(a, lambda x: x > 0), list_filter(a, lambda x: x <= 0))", lambda e: (lambda p: A.concat(p["yes"], p["no"]))(A.partition(e.a, lambda x: x > 0)))
one("histogram", "[CAST(len(list_filter(a, lambda x: x >= -4 AND x < 0)) AS INTEGER), CAST(len(list_filter(a, lambda x: x >= 0 AND x < 4)) AS INTEGER)]", lambda e: A.histogram(e.a, -4, 4, 2))
one("record_arithmetic", "CAST((a[1] + b[1]) * 1000 + a[2] + b[2] AS INTEGER)", lambda e: (lambda r: r["x"] * 1000 + r["y"])(A.arithmetic(F.struct(F.get(e.a, F.lit(0)).alias("x"), F.get(e.a, F.lit(1)).alias("y")), F.struct(F.get(e.b, F.lit(0)).alias("x"), F.get(e.b, F.lit(1)).alias("y")), ["x", "y"], lambda x, y: x + y)))


@query("SELECT CAST(bit_xor(l_orderkey * 8 + l_linenumber) AS BIGINT) AS value FROM lineitem")
def col_reduce(t: Tables) -> Table:
    """A reduction by a function of two values."""
    return t.lineitem.reduce(lambda l: l.l_orderkey * 8 + l.l_linenumber, 0, lambda a, b: a ^ b)


@query("SELECT l_returnflag AS key, CAST(bit_xor(l_orderkey * 8 + l_linenumber) AS BIGINT) AS value FROM lineitem GROUP BY 1")
def col_group_reduce(t: Tables) -> Table:
    return t.lineitem.group_by(lambda l: l.l_returnflag).reduce(lambda l: l.l_orderkey * 8 + l.l_linenumber, 0, lambda a, b: a ^ b)


@query("SELECT CAST(sum(range * range) AS BIGINT) AS total, count(*) AS n FROM range(0, 1000)")
def col_indexed_loop(t: Tables) -> DataFrame:
    """A loop over positions with effects and two reductions taken out of it: the effects are accumulators."""
    total, n = t.spark.sparkContext.accumulator(0), t.spark.sparkContext.accumulator(0)

    def body(r: object) -> None:
        total.add(r["value"] ** 2)
        n.add(1)

    Table.range(t.spark, 0, 1000).for_each(body)
    return t.spark.createDataFrame([(total.value, n.value)], "total long, n long")


@query("SELECT r_name AS k, list_sort(list(DISTINCT n_name)) AS names, count(DISTINCT n_nationkey) AS n, list_sort(list(substr(n_name, 1, 1))) AS letters, CAST(coalesce(sum(n_nationkey) FILTER (WHERE n_nationkey > 20), 0) AS BIGINT) AS large FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def col_group_as_table(t: Tables) -> Table:
    rows = t.nation.join(t.region).where_eq(lambda n: n.n_regionkey, lambda r: r.r_regionkey).select(lambda n, r: {"r_name": r.r_name, "n_name": n.n_name, "n_nationkey": n.n_nationkey})
    return rows.group_by(lambda x: x.r_name).select(lambda g: {"k": g.key, "names": g.distinct(lambda x: x.n_name), "n": g.count_distinct(lambda x: x.n_nationkey), "letters": F.sort_array(g.select_many(lambda x: F.array(F.substring(x.n_name, 1, 1)))), "large": g.where(lambda x: x.n_nationkey > 20).sum(lambda x: x.n_nationkey)})


@query(f"""{BASE}, x AS (SELECT vec_id, y, count(*) AS n FROM (SELECT vec_id, unnest(a) AS y FROM v) GROUP BY ALL),
z AS (SELECT vec_id, y, count(*) AS n FROM (SELECT vec_id, unnest(b) AS y FROM v) GROUP BY ALL),
m AS (SELECT vec_id, CAST(sum(least(x.n, z.n)) AS INTEGER) AS n FROM x JOIN z USING (vec_id, y) GROUP BY 1)
SELECT v.vec_id, coalesce(m.n, 0) AS r FROM v LEFT JOIN m USING (vec_id)""")
def arr_intersect(t: Tables) -> Table:
    return ints(t).select(lambda e: {"vec_id": e.vec_id, "r": F.size(A.intersect(e.a, e.b))})


@query("SELECT CAST(sum(a.range * b.range) AS BIGINT) AS r FROM range(0, 1000) a JOIN range(0, 1000) b ON a.range = b.range")
def col_zip_reduce(t: Tables) -> Table:
    a, b = Table.range(t.spark, 0, 1000), Table.range(t.spark, 0, 1000)
    return a.join(b).where_eq(lambda x: x.value, lambda y: y.value).select(lambda x, y: {"p": x.value * y.value}).aggregate(lambda r: {"r": F.sum(r.p)})


@query("SELECT CAST(range % 10 AS BIGINT) AS k, CAST(sum(range) AS BIGINT) AS s FROM range(0, 10000) WHERE range % 3 = 0 GROUP BY 1")
def col_group_by_reduce(t: Tables) -> Table:
    return Table.range(t.spark, 0, 10_000).where(lambda r: r.value % 3 == 0).group_by(lambda r: r.value % 10).select(lambda g: {"k": g.key, "s": g.sum(lambda r: r.value)})


@query("SELECT max_by(p_partkey, p_retailprice * 1000000 - p_partkey) AS best, max(p_retailprice) AS price FROM part")
def col_arg_max(t: Tables) -> Table:
    return t.part.aggregate(lambda p: {"best": F.max_by(p.p_partkey, p.p_retailprice * 1000000 - p.p_partkey), "price": F.max(p.p_retailprice)})


@query("SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT p_brand AS key FROM part)")
def col_build_index(t: Tables) -> DataFrame:
    from tesserine.sources.readers import renumber

    keys = t.part.group_by(lambda p: p.p_brand).keys().df
    return renumber(keys.select(F.col("key").alias("src"), F.col("key").alias("dst")))[1].select(F.col("node").alias("key"), F.col("id").cast("long").alias("id"))
