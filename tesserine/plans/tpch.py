"""The decision-support queries, adapted to the tables at hand (no partsupp, timestamps for dates)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions.scalars import date, if_else
from tesserine.operators.table import Table
from tesserine.plans.registry import Tables, query


@query("""
SELECT l_returnflag AS return_flag, l_linestatus AS line_status, round(sum(l_quantity), 2) AS sum_qty,
  round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty,
  round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' GROUP BY 1, 2 ORDER BY 1, 2
""")
def q1(t: Tables) -> Table:
    priced = t.lineitem.where(lambda l: l.l_shipdate <= date("1998-12-01"))
    return (
        priced.group_by(lambda l: (l.l_returnflag, l.l_linestatus))
        .select(
            lambda g: {
                "return_flag": g.key._1,
                "line_status": g.key._2,
                "sum_qty": F.round(g.sum(lambda l: l.l_quantity), 2),
                "sum_base_price": F.round(g.sum(lambda l: l.l_extendedprice), 2),
                "sum_disc_price": F.round(g.sum(lambda l: l.l_extendedprice * (1 - l.l_discount)), 2),
                "sum_charge": F.round(g.sum(lambda l: l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax)), 2),
                "avg_qty": F.round(g.average(lambda l: l.l_quantity), 4),
                "avg_price": F.round(g.average(lambda l: l.l_extendedprice), 4),
                "avg_disc": F.round(g.average(lambda l: l.l_discount), 6),
                "count_order": g.count(),
            }
        )
        .order_by(lambda r: r.return_flag)
        .then_by(lambda r: r.line_status)
    )


@query("""
WITH ps AS (SELECT l_partkey, l_suppkey, round(min(l_extendedprice / l_quantity), 4) AS cost FROM lineitem GROUP BY 1, 2),
c AS (
  SELECT s_acctbal, s_name, n_name, p_partkey, p_type, cost FROM part
  JOIN ps ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey WHERE p_size = 15 AND p_type LIKE '%Y' AND r_name = 'EUROPE')
SELECT s_acctbal, s_name, n_name, p_partkey, p_type, cost FROM c
WHERE cost = (SELECT min(d.cost) FROM c d WHERE d.p_partkey = c.p_partkey)
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 10
""")
def q2(t: Tables) -> Table:
    wanted = t.part.where(lambda p: (p.p_size == 15) & p.p_type.endswith("Y"))
    supply = t.lineitem.semi_join(wanted, lambda l: l.l_partkey, lambda p: p.p_partkey).group_by(lambda l: (l.l_partkey, l.l_suppkey)).select(lambda g: {"partkey": g.key._1, "suppkey": g.key._2, "cost": F.round(g.min(lambda l: l.l_extendedprice / l.l_quantity), 4)})
    europe = t.nation.join(t.region).where(lambda r: r.r_name == "EUROPE").where_eq(lambda n: n.n_regionkey, lambda r: r.r_regionkey).select(lambda n, r: {"n_nationkey": n.n_nationkey, "n_name": n.n_name})
    suppliers = t.supplier.join(europe).where_eq(lambda s: s.s_nationkey, lambda n: n.n_nationkey).select(lambda s, n: {"s_suppkey": s.s_suppkey, "s_name": s.s_name, "s_acctbal": s.s_acctbal, "n_name": n.n_name})
    parts = supply.join(wanted).where_eq(lambda s: s.partkey, lambda p: p.p_partkey).select(lambda s, p: {"p_partkey": p.p_partkey, "p_type": p.p_type, "suppkey": s.suppkey, "cost": s.cost})
    offers = parts.join(suppliers).where_eq(lambda p: p.suppkey, lambda s: s.s_suppkey).select(lambda p, s: {"s_acctbal": s.s_acctbal, "s_name": s.s_name, "n_name": s.n_name, "p_partkey": p.p_partkey, "p_type": p.p_type, "cost": p.cost})
    best = offers.where_least(lambda o: o.p_partkey, lambda o: o.cost)
    return best.order_by_descending(lambda o: o.s_acctbal).then_by(lambda o: o.n_name).then_by(lambda o: o.s_name).then_by(lambda o: o.p_partkey).limit(10)


@query("""
SELECT l_orderkey AS orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(o_orderdate AS DATE) AS orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY 1, 3 ORDER BY revenue DESC, orderdate, orderkey LIMIT 10
""")
def q3(t: Tables) -> Table:
    cut = date("1998-03-15")
    orders = t.customer.where(lambda c: c.c_mktsegment == "BUILDING").join(t.orders).where(lambda o: o.o_orderdate < cut).where_eq(lambda c: c.c_custkey, lambda o: o.o_custkey).select(lambda c, o: {"orderkey": o.o_orderkey, "orderdate": o.o_orderdate.cast("date")})
    lines = orders.join(t.lineitem).where(lambda l: l.l_shipdate > cut).where_eq(lambda o: o.orderkey, lambda l: l.l_orderkey).select(lambda o, l: {"orderkey": o.orderkey, "orderdate": o.orderdate, "revenue": l.l_extendedprice * (1 - l.l_discount)})
    grouped = lines.group_by(lambda r: (r.orderkey, r.orderdate)).select(lambda g: {"orderkey": g.key._1, "revenue": F.round(g.sum(lambda r: r.revenue), 2), "orderdate": g.key._2})
    return grouped.order_by_descending(lambda r: r.revenue).then_by(lambda r: r.orderdate).then_by(lambda r: r.orderkey).limit(10)


LATE = """
SELECT o_orderpriority AS priority, count(*) AS order_count FROM orders
WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY)
GROUP BY 1 ORDER BY 1
"""


def quarter(t: Tables) -> Table:
    return t.orders.where(lambda o: (o.o_orderdate >= date("1996-07-01")) & (o.o_orderdate < date("1996-10-01")))


def by_priority(orders: Table) -> Table:
    return orders.group_by(lambda o: o.o_orderpriority).select(lambda g: {"priority": g.key, "order_count": g.count()}).order_by(lambda r: r.priority)


@query(LATE)
def q4(t: Tables) -> Table:
    return by_priority(quarter(t).semi_join(t.lineitem, lambda o: o.o_orderkey, lambda l: l.l_orderkey, lambda o, l: l.l_shipdate > o.o_orderdate + F.expr("INTERVAL 60 DAYS")))


@query(LATE)
def q4_distinct(t: Tables) -> Table:
    """The same by a join and a distinct key."""
    joined = quarter(t).join(t.lineitem).where_eq(lambda o: o.o_orderkey, lambda l: l.l_orderkey).select(lambda o, l: {"o_orderkey": o.o_orderkey, "o_orderpriority": o.o_orderpriority, "late": l.l_shipdate > o.o_orderdate + F.expr("INTERVAL 60 DAYS")})
    return by_priority(joined.where(lambda r: r.late).distinct(lambda r: r.o_orderkey, order=lambda r: r.o_orderpriority))


@query("""
SELECT round(coalesce(sum(l_extendedprice * l_discount), 0), 2) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24
""")
def q6(t: Tables) -> Table:
    some = t.lineitem.where(lambda l: (l.l_shipdate >= date("1996-01-01")) & (l.l_shipdate < date("1997-01-01")) & (l.l_discount >= 0.05) & (l.l_discount <= 0.07) & (l.l_quantity < 24))
    return some.sum(lambda l: l.l_extendedprice * l.l_discount).select(lambda r: {"revenue": F.round(r.value, 2)})


@query("""
SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'
""")
def q14(t: Tables) -> Table:
    month = t.lineitem.where(lambda l: (l.l_shipdate >= date("1996-09-01")) & (l.l_shipdate < date("1996-10-01")))
    lines = month.join(t.part).where_eq(lambda l: l.l_partkey, lambda p: p.p_partkey).select(lambda l, p: {"price": l.l_extendedprice * (1 - l.l_discount), "promo": p.p_type.startswith("PROMO")})
    return lines.aggregate(lambda r: {"promo_revenue": F.round(100 * F.sum(if_else(r.promo, r.price, 0.0)) / F.sum(r.price), 4)})
