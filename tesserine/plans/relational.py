"""One query for each relational operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.functions import arrays as A
from tesserine.functions import scalars as S
from tesserine.operators.table import Table
from tesserine.plans.registry import Tables, query
from tesserine.sources import readers


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F'")
def op_where(t: Tables) -> Table:
    return t.orders.where(lambda o: (o.o_totalprice > 200000) & (o.o_orderstatus != "F")).select(lambda o: {"o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice})


@query("SELECT round(p_retailprice * p_size, 2) AS value FROM part")
def op_select_scalar(t: Tables) -> Table:
    return t.part.select(lambda p: F.round(p.p_retailprice * p.p_size, 2))


@query("SELECT p_partkey, p_brand || '/' || p_type AS kind, p_size + 1 AS bigger FROM part")
def op_select_record(t: Tables) -> Table:
    return t.part.select(lambda p: {"p_partkey": p.p_partkey, "kind": F.concat(p.p_brand, F.lit("/"), p.p_type), "bigger": p.p_size + 1})


@query("SELECT p_partkey, struct_pack(b := p_brand, s := p_size) AS r FROM part")
def op_select_struct(t: Tables) -> Table:
    return t.part.select(lambda p: {"p_partkey": p.p_partkey, "r": F.struct(p.p_brand.alias("b"), p.p_size.alias("s"))})


@query("SELECT unnest(string_split(p_name, ' ')) AS value FROM part")
def op_select_many(t: Tables) -> Table:
    return t.part.select_many(lambda p: F.split(p.p_name, " "))


@query("SELECT e.vec_id, i AS at, e.embedding[i + 1] AS x FROM embeddings e, range(0, 4) r(i)")
def op_select_many_records(t: Tables) -> Table:
    return t.embeddings.select_many(lambda e: F.transform(A.indices(0, 4), lambda i: F.struct(e.vec_id, i.cast("long").alias("at"), F.get(e.embedding, i).alias("x"))))


@query("SELECT sum(l_quantity) AS value FROM lineitem")
def op_sum(t: Tables) -> Table:
    return t.lineitem.sum(lambda l: l.l_quantity)


@query("SELECT CAST(coalesce(sum(p_size), 0) AS BIGINT) AS value FROM part WHERE p_size < 0")
def op_sum_empty(t: Tables) -> Table:
    return t.part.where(lambda p: p.p_size < 0).sum(lambda p: p.p_size)


@query("SELECT round(avg(o_totalprice), 4) AS value FROM orders")
def op_avg(t: Tables) -> Table:
    return t.orders.average(lambda o: o.o_totalprice).select(lambda r: F.round(r.value, 4))


@query("SELECT CAST(sum(p_size) // count(p_size) AS BIGINT) AS value FROM part")
def op_int_average(t: Tables) -> Table:
    return t.part.int_average(lambda p: p.p_size)


@query("SELECT min(o_totalprice) AS value FROM orders")
def op_min(t: Tables) -> Table:
    return t.orders.min(lambda o: o.o_totalprice)


@query("SELECT max(o_orderdate) AS value FROM orders")
def op_max(t: Tables) -> Table:
    return t.orders.max(lambda o: o.o_orderdate)


@query("SELECT CAST(2147483647 AS INTEGER) AS least, CAST(-2147483648 AS INTEGER) AS largest")
def op_extremes_of_empty(t: Tables) -> DataFrame:
    none = t.part.where(lambda p: p.p_size < 0)
    return none.min(lambda p: p.p_size, empty="bound").select(lambda r: {"least": r.value}).df.crossJoin(none.max(lambda p: p.p_size, empty="bound").select(lambda r: {"largest": r.value}).df)


@query("SELECT count(*) AS value FROM events")
def op_count(t: Tables) -> Table:
    return t.events.count()


@query("SELECT count(*) FILTER (WHERE value > 50) AS value FROM events")
def op_count_if(t: Tables) -> Table:
    return t.events.count(lambda e: e.value > 50)


@query("SELECT count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, round(sum(l_extendedprice), 2) AS total FROM lineitem")
def op_aggregate_many(t: Tables) -> Table:
    return t.lineitem.aggregate(lambda l: {"n": F.count(F.lit(1)), "lo": F.min(l.l_quantity), "hi": F.max(l.l_quantity), "total": F.round(F.sum(l.l_extendedprice), 2)})


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def op_first(t: Tables) -> Table:
    return t.orders.select(lambda o: {"o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice}).order_by(lambda o: o.o_totalprice, lambda o: o.o_orderkey).first()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1")
def op_last(t: Tables) -> Table:
    return t.orders.select(lambda o: {"o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice}).order_by(lambda o: o.o_totalprice, lambda o: o.o_orderkey).last()


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 7")
def op_row_at(t: Tables) -> Table:
    return t.customer.select(lambda c: {"c_custkey": c.c_custkey, "c_name": c.c_name}).at(7, lambda c: c.c_custkey)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def op_distinct(t: Tables) -> Table:
    return t.lineitem.select(lambda l: {"l_returnflag": l.l_returnflag, "l_linestatus": l.l_linestatus}).distinct()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def op_distinct_by(t: Tables) -> Table:
    return t.orders.distinct(lambda o: o.o_custkey, order=lambda o: (o.o_orderdate, o.o_orderkey)).select(lambda o: {"o_custkey": o.o_custkey, "o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice})


@query("SELECT l_returnflag AS flag, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, count(*) AS n, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY 1")
def op_group_by(t: Tables) -> Table:
    return t.lineitem.group_by(lambda l: l.l_returnflag).select(lambda g: {"flag": g.key, "qty": F.round(g.sum(lambda l: l.l_quantity), 2), "price": F.round(g.average(lambda l: l.l_extendedprice), 4), "n": g.count(), "lo": g.min(lambda l: l.l_shipdate), "hi": g.max(lambda l: l.l_shipdate)})


@query("SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1, 2")
def op_group_key_struct(t: Tables) -> Table:
    return t.customer.group_by(lambda c: {"nation": c.c_nationkey, "segment": c.c_mktsegment}).select(lambda g: {"nation": g.key.nation, "segment": g.key.segment, "n": g.count()})


@query("SELECT event_type, round(sum(value) FILTER (WHERE value > 10), 4) AS s, count(*) FILTER (WHERE value > 10) AS n FROM events GROUP BY 1")
def op_group_filter_sum(t: Tables) -> Table:
    return t.events.group_by(lambda e: e.event_type).select(lambda g: {"event_type": g.key, "s": F.round(g.where(lambda e: e.value > 10).sum(lambda e: e.value), 4), "n": g.where(lambda e: e.value > 10).count()})


@query("SELECT n_regionkey AS region, list(n_nationkey ORDER BY n_nationkey) AS nations FROM nation GROUP BY 1")
def op_group_values(t: Tables) -> Table:
    return t.nation.group_by(lambda n: n.n_regionkey).select(lambda g: {"region": g.key, "nations": F.sort_array(g.values(lambda n: n.n_nationkey))})


@query("SELECT n_regionkey AS key, count(*) AS n FROM nation GROUP BY 1")
def op_groups(t: Tables) -> Table:
    return t.nation.group_by(lambda n: n.n_regionkey).groups().select(lambda r: {"key": r.key, "n": F.size(r.values).cast("long")})


@query("SELECT c_acctbal AS value FROM customer WHERE c_acctbal > 5000")
def op_group_flatten(t: Tables) -> Table:
    return t.customer.where(lambda c: c.c_acctbal > 5000).group_by(lambda c: c.c_mktsegment).select_many(lambda c: c.c_acctbal)


@query("SELECT DISTINCT p_brand AS key FROM part")
def op_group_keys(t: Tables) -> Table:
    return t.part.group_by(lambda p: p.p_brand).keys()


@query("SELECT o_custkey AS cust, min_by(o_orderkey, o_orderkey) AS first_order, max_by(o_orderkey, o_orderkey) AS last_order FROM orders GROUP BY 1")
def op_group_first_last(t: Tables) -> Table:
    return t.orders.group_by(lambda o: o.o_custkey).select(lambda g: {"cust": g.key, "first_order": g.first(lambda o: o.o_orderkey, order=lambda o: o.o_orderkey), "last_order": g.last(lambda o: o.o_orderkey, order=lambda o: o.o_orderkey)})


@query("SELECT user_id, CAST(sum(event_id) // count(event_id) AS BIGINT) AS mean_id FROM events GROUP BY 1")
def op_group_int_average(t: Tables) -> Table:
    return t.events.group_by(lambda e: e.user_id).select(lambda g: {"user_id": g.key, "mean_id": g.int_average(lambda e: e.event_id)})


@query("SELECT o_custkey AS cust, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def op_having(t: Tables) -> Table:
    return t.orders.group_by(lambda o: o.o_custkey).select(lambda g: {"cust": g.key, "n": g.count()}).where(lambda r: r.n > 12)


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey DESC, s_acctbal, s_suppkey DESC")
def op_order_then(t: Tables) -> Table:
    s = t.supplier.select(lambda s: {"s_suppkey": s.s_suppkey, "s_nationkey": s.s_nationkey, "s_acctbal": s.s_acctbal})
    return s.order_by_descending(lambda s: s.s_nationkey).then_by(lambda s: s.s_acctbal).then_by_descending(lambda s: s.s_suppkey)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def op_take(t: Tables) -> Table:
    return t.part.select(lambda p: {"p_partkey": p.p_partkey, "p_retailprice": p.p_retailprice}).order_by_descending(lambda p: p.p_retailprice).then_by(lambda p: p.p_partkey).take(20)


@query("SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def op_join(t: Tables) -> Table:
    return t.customer.join(t.orders).where_eq(lambda c: c.c_custkey, lambda o: o.o_custkey).select(lambda c, o: {"c_name": c.c_name, "o_orderkey": o.o_orderkey})


@query("SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate WHERE a.o_orderkey < b.o_orderkey")
def op_join_multi_key(t: Tables) -> Table:
    key = lambda o: (o.o_custkey, o.o_orderdate)
    return t.orders.join(t.orders).where_eq(key, key).select(lambda a, b: {"a": a.o_orderkey, "b": b.o_orderkey}).where(lambda r: r.a < r.b)


@query("SELECT n_name, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_acctbal > 0")
def op_join_filter(t: Tables) -> Table:
    return t.nation.join(t.supplier).where(lambda s: s.s_acctbal > 0).where_eq(lambda n: n.n_nationkey, lambda s: s.s_nationkey).select(lambda n, s: {"n_name": n.n_name, "s_name": s.s_name})


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def op_join_left(t: Tables) -> Table:
    return t.customer.join(t.orders).where_eq(lambda c: c.c_custkey, lambda o: o.o_custkey).select(lambda c, o: {"c_custkey": c.c_custkey, "o_orderkey": o.o_orderkey}, how="left")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def op_semi(t: Tables) -> Table:
    return t.customer.semi_join(t.orders, lambda c: c.c_custkey, lambda o: o.o_custkey).select(lambda c: {"c_custkey": c.c_custkey})


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def op_anti(t: Tables) -> Table:
    return t.customer.anti_join(t.orders, lambda c: c.c_custkey, lambda o: o.o_custkey).select(lambda c: {"c_custkey": c.c_custkey})


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier s WHERE s_acctbal = (SELECT min(x.s_acctbal) FROM supplier x WHERE x.s_nationkey = s.s_nationkey)")
def op_correlated_min(t: Tables) -> Table:
    return t.supplier.where_least(lambda s: s.s_nationkey, lambda s: s.s_acctbal).select(lambda s: {"s_suppkey": s.s_suppkey, "s_nationkey": s.s_nationkey, "s_acctbal": s.s_acctbal})


@query("SELECT CAST(range AS BIGINT) AS value FROM range(3, 40)")
def op_range(t: Tables) -> Table:
    return Table.range(t.spark, 3, 40)


ITEM = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("price", T.DoubleType()), T.StructField("ok", T.BooleanType()), T.StructField("day", T.DateType())])


@query("SELECT * FROM (VALUES (1, CAST(2.5 AS DOUBLE), true, DATE '2020-01-02'), (2, CAST(0.25 AS DOUBLE), false, DATE '2021-03-04')) v(id, price, ok, day)")
def op_from_string(t: Tables) -> DataFrame:
    return readers.from_string(t.spark, "1|2.5|true|2020-01-02;2|0.25|TRUE|2021-03-04;;", ";", r"\|", ITEM)


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(id, name)")
def op_literal_rows(t: Tables) -> Table:
    return Table.of(t.spark, [(1, "a"), (2, "b")], "id int, name string")


@query("SELECT r_regionkey AS k FROM region WHERE r_regionkey > 100")
def op_empty_table(t: Tables) -> Table:
    return Table.of(t.spark, [], "k int")


@query("SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
def op_union_all(t: Tables) -> Table:
    return t.region.select(lambda r: {"name": r.r_name}).union(t.nation.select(lambda n: {"name": n.n_name}))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def op_intersect_all(t: Tables) -> Table:
    return t.customer.select(lambda c: {"k": c.c_nationkey}).intersect(t.supplier.select(lambda s: {"k": s.s_nationkey}))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def op_except_all(t: Tables) -> Table:
    return t.customer.select(lambda c: {"k": c.c_nationkey}).except_(t.supplier.select(lambda s: {"k": s.s_nationkey}))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_class, p_size % 7 AS rest, least(p_size, 10) AS lo, greatest(p_size, 10) AS hi, abs(p_size - 25) AS away, p_size // 4 AS quarter FROM part")
def op_case_arithmetic(t: Tables) -> Table:
    return t.part.select(lambda p: {"p_partkey": p.p_partkey, "size_class": S.if_else(p.p_size > 25, "large", "small"), "rest": p.p_size % 7, "lo": F.least(p.p_size, F.lit(10)), "hi": F.greatest(p.p_size, F.lit(10)), "away": F.abs(p.p_size - 25), "quarter": S.int_divide(p.p_size, F.lit(4)).cast("int")})


@query("SELECT p_partkey, p_type LIKE 'PROMO%' AS promo, p_type LIKE '%Y' AS y, contains(p_name, 'a') AS has_a, substr(p_brand, 1, 1) AS c, p_brand || '-' || p_type AS both, CAST(CAST(p_size AS VARCHAR) AS INTEGER) AS n FROM part")
def op_string_fns(t: Tables) -> Table:
    return t.part.select(lambda p: {"p_partkey": p.p_partkey, "promo": p.p_type.startswith("PROMO"), "y": p.p_type.endswith("Y"), "has_a": F.contains(p.p_name, F.lit("a")), "c": S.char_at(p.p_brand), "both": F.concat(p.p_brand, F.lit("-"), p.p_type), "n": p.p_size.cast("string").cast("int")})


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST((year(o_orderdate) << 9) + (month(o_orderdate) << 5) + day(o_orderdate) AS INTEGER) AS packed FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate <> DATE '1997-05-05'")
def op_date_fns(t: Tables) -> Table:
    return t.orders.where(lambda o: (o.o_orderdate >= S.date("1997-01-01")) & (o.o_orderdate != S.date("1997-05-05"))).select(lambda o: {"o_orderkey": o.o_orderkey, "d": o.o_orderdate.cast("date"), "packed": S.packed_date(o.o_orderdate)})


@query("SELECT event_id, event_id << 3 AS l, event_id >> 2 AS r, event_id & 255 AS a FROM events")
def op_bit_fns(t: Tables) -> Table:
    return t.events.select(lambda e: {"event_id": e.event_id, "l": F.shiftleft(e.event_id, 3), "r": F.shiftrightunsigned(e.event_id, 2), "a": e.event_id.bitwiseAND(F.lit(255))})


@query("SELECT o_orderkey, round(ln(o_totalprice), 6) AS l, round(exp(o_totalprice / 1000000), 6) AS e, round(sqrt(o_totalprice), 6) AS s, round(pow(o_totalprice / 1000, 2), 4) AS p, round(sqrt(o_totalprice) / pi(), 6) AS q FROM orders")
def op_math_fns(t: Tables) -> Table:
    return t.orders.select(lambda o: {"o_orderkey": o.o_orderkey, "l": F.round(F.log(o.o_totalprice), 6), "e": F.round(F.exp(o.o_totalprice / 1000000), 6), "s": F.round(F.sqrt(o.o_totalprice), 6), "p": F.round(F.pow(o.o_totalprice / 1000, F.lit(2)), 4), "q": F.round(F.sqrt(o.o_totalprice) / F.pi(), 6)})


@query("SELECT l_orderkey AS k, CAST(l_partkey % 200 AS BIGINT) * 256 + l_suppkey % 100 AS ip FROM lineitem")
def op_split_parse(t: Tables) -> Table:
    text = lambda l: F.concat_ws(".", F.lit("0"), F.lit("0"), (l.l_partkey % 200).cast("string"), (l.l_suppkey % 100).cast("string"))
    return t.lineitem.select(lambda l: {"k": l.l_orderkey, "ip": S.ip_to_int(text(l))})


@query("SELECT event_type, round(sqrt(sum(pow(value - m, 2))) / max(n), 6) AS deviation FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1")
def op_sum_root_deviation(t: Tables) -> DataFrame:
    means = t.events.group_by(lambda e: e.event_type).select(lambda g: {"kind": g.key, "m": g.average(lambda e: e.value), "n": g.count()})
    away = t.events.join(means).where_eq(lambda e: e.event_type, lambda m: m.kind).select(lambda e, m: {"event_type": e.event_type, "d": (e.value - m.m) * (e.value - m.m), "n": m.n})
    return away.group_by(lambda r: r.event_type).select(lambda g: {"event_type": g.key, "deviation": F.round(S.sum_root_deviation(g.sum(lambda r: r.d), g.max(lambda r: r.n)), 6)})


@query("SELECT c_mktsegment AS segment, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def ext_rollup(t: Tables) -> DataFrame:
    return t.customer.df.rollup(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_event_windows(t: Tables) -> DataFrame:
    from tesserine.streaming.windows import windowed

    return windowed(t.events.df).withColumn("total", F.round("total", 4))
