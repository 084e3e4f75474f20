"""Graph and log workloads on edges and traces made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions import arrays as A
from tesserine.functions import scalars as S
from tesserine.operators import graph
from tesserine.operators.table import Table
from tesserine.plans.registry import Tables, query

#: Suppliers and parts share their numbers, so low numbers have edges to and from them.
EDGES = "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem"


def links(t: Tables) -> DataFrame:
    """The edges with their repeats, for what takes an edge once however often it comes."""
    return t.lineitem.select(lambda l: {"src": l.l_suppkey, "dst": l.l_partkey}).df


def edges(t: Tables) -> DataFrame:
    return t.lineitem.select(lambda l: {"src": l.l_suppkey, "dst": l.l_partkey}).distinct().df


@query("""
WITH links AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem UNION ALL SELECT l_suppkey, l_linenumber FROM lineitem)
SELECT src, dst, count(*) AS n FROM links GROUP BY 1, 2 HAVING count(*) > 20
""")
def traceroute(t: Tables) -> Table:
    """Traces ``id:ip:latency|id:ip:latency|...`` to links between consecutive addresses that occur more than 20 times."""
    octet = lambda x, shift: F.shiftright(x.cast("long"), shift).bitwiseAND(F.lit(255)).cast("string")
    hop = lambda i, x: F.concat_ws(":", F.lit(i).cast("string"), F.concat_ws(".", *(octet(x, s) for s in (24, 16, 8, 0))), F.lit("0.5"))
    traces = t.lineitem.select(lambda l: {"trace": F.concat_ws("|", hop(0, l.l_partkey), hop(1, l.l_suppkey), hop(2, l.l_linenumber))})
    hops = traces.select_many(lambda r: A.pairs(F.split(r.trace, r"\|")))
    # addresses are parsed before links are counted: numbers are shuffled once, where texts were, and then numbers again
    address = lambda hop: S.ip_to_int(F.split_part(hop, F.lit(":"), F.lit(2)))
    links = hops.select(lambda e: {"src": address(e.src), "dst": address(e.dst)})
    return links.group_by(lambda e: (e.src, e.dst)).select(lambda g: {"src": g.key._1, "dst": g.key._2, "n": g.count()}).where(lambda r: r.n > 20)


@query("SELECT user_id, count(*) AS hits, round(sum(value), 4) AS total, CAST(sum(event_id % 100) AS BIGINT) AS bytes FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1")
def cidr_report(t: Tables) -> Table:
    kind = t.events.min(lambda e: e.event_type).select(lambda r: {"kind": r.value})
    some = t.events.semi_join(kind, lambda e: e.event_type, lambda k: k.kind)
    return some.group_by(lambda e: e.user_id).select(lambda g: {"user_id": g.key, "hits": g.count(), "total": F.round(g.sum(lambda e: e.value), 4), "bytes": g.sum(lambda e: e.event_id % 100)})


@query(f"WITH e AS ({EDGES}), x AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM x GROUP BY 1")
def graph_degrees(t: Tables) -> DataFrame:
    return graph.degrees(edges(t))


@query(f"""WITH e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({EDGES}) WHERE src <> dst)
SELECT count(*) AS n_triangles FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b""")
def graph_triangles(t: Tables) -> DataFrame:
    return graph.triangles(links(t))


ROUNDS = 20
PAGERANK_SQL = f"""WITH RECURSIVE e AS MATERIALIZED ({EDGES}), nodes AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e),
m AS MATERIALIZED (SELECT src, dst, CAST(count(*) OVER (PARTITION BY src) AS DOUBLE) AS d FROM e),
r AS (SELECT 0 AS i, node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes
UNION ALL
SELECT i, node, 0.15::DOUBLE + 0.85::DOUBLE * sum(part) AS rank FROM (
  SELECT r.i + 1 AS i, m.dst AS node, r.rank / m.d AS part FROM r JOIN m ON m.src = r.node WHERE r.i < {ROUNDS}
  UNION ALL SELECT r.i + 1, r.node, 0.0::DOUBLE FROM r WHERE r.i < {ROUNDS}) GROUP BY 1, 2)
SELECT node, round(rank, 6) AS rank FROM r WHERE i = {ROUNDS}"""


@query(PAGERANK_SQL)
def graph_pagerank(t: Tables) -> DataFrame:
    return graph.pagerank(edges(t), ROUNDS).select("node", F.round("rank", 6).alias("rank"))


@query(f"""WITH e AS (SELECT * FROM ({EDGES}) WHERE src <> dst), m AS (SELECT e.src, e.dst FROM e JOIN e f ON e.src = f.dst AND e.dst = f.src),
k AS (SELECT src, count(*) AS k FROM m GROUP BY 1),
h AS (SELECT a.src AS node, 2 * count(*) AS hits FROM m a JOIN m b ON a.src = b.src AND a.dst <> b.dst JOIN e ON e.src = a.dst AND e.dst = b.dst GROUP BY 1),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT n.node, round(CASE WHEN k.k >= 2 THEN coalesce(h.hits, 0) / (2.0 * k.k * (k.k - 1)) ELSE 0 END, 6) AS coefficient FROM n LEFT JOIN k ON k.src = n.node LEFT JOIN h ON h.node = n.node""")
def graph_clustering(t: Tables) -> DataFrame:
    return graph.clustering(links(t)).select("node", F.round("coefficient", 6).alias("coefficient"))


@query("SELECT doc_id, split_part(line, chr(9), 1) AS name, substr(split_part(line, chr(9), 2), 1, 13) AS seq FROM (SELECT doc_id, source || chr(9) || text || chr(9) || lang || chr(9) || n_chars AS line FROM documents) WHERE NOT regexp_matches(split_part(line, chr(9), 2), '^[AN][GN][AN][TN]')")
def wrangle_sequences(t: Tables) -> Table:
    """Lines of four columns parted by tabs: drops those whose sequence begins with the adapter AGAT (N matches anything;
    shorter sequences never match) and cuts the others' to 13 characters."""
    lines = t.documents.select(lambda d: {"doc_id": d.doc_id, "line": F.concat(d.source, F.lit("\t"), d.text, F.lit("\t"), d.lang, F.lit("\t"), d.n_chars.cast("string"))})
    cut = lines.select(lambda r: {"doc_id": r.doc_id, "name": F.split_part(r.line, F.lit("\t"), F.lit(1)), "seq": F.split_part(r.line, F.lit("\t"), F.lit(2))})
    return cut.where(lambda r: ~r.seq.rlike("^[AN][GN][AN][TN]")).select(lambda r: {"doc_id": r.doc_id, "name": r.name, "seq": F.substring(r.seq, 1, 13)})


@query("SELECT (SELECT count(*) FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-02' AND event_type = 'click' AND value > 50) AS retweets, (SELECT count(*) FROM events WHERE event_type = 'click') AS tweets")
def tweet_filters(t: Tables) -> DataFrame:
    """A date, a language and a flag filter one table twice; both counts come from one pass."""
    tweets = t.events.where(lambda e: e.event_type == "click")
    return tweets.aggregate(lambda e: {"retweets": F.count_if((e.ts.cast("date") >= S.date("2024-01-02")) & (e.value > 50)), "tweets": F.count(F.lit(1))}).df
