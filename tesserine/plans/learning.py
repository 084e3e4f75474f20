"""Learning workloads; those that one SQL query can express are held against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.operators import learning as L
from tesserine.operators.table import Table
from tesserine.plans.registry import Tables, query


def labelled(t: Tables) -> DataFrame:
    return t.lineitem.select(lambda l: {"x": l.l_quantity / 50, "z": l.l_extendedprice / 100000, "y": (l.l_returnflag == "R").cast("int")}).df


@query("WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), c AS (SELECT vec_id AS c, v AS w FROM p WHERE vec_id < 4) SELECT vec_id, CAST(min_by(c, d) AS INTEGER) AS cluster FROM (SELECT vec_id, c, round(list_sum(list_transform(list_zip(v, w), lambda q: (q[1] - q[2]) * (q[1] - q[2]))), 9) AS d FROM p, c) GROUP BY 1")
def ml_nearest_centre(t: Tables) -> DataFrame:
    rows = t.embeddings.where(lambda e: e.vec_id < 4).order_by(lambda e: e.vec_id).to_array()
    return t.embeddings.df.select("vec_id", L.nearest(F.col("embedding"), [r["embedding"] for r in rows]).alias("cluster"))


#: Vectors, and each vector's nearest of a list of centres.
POINTS = "p AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
SIZES = "SELECT CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS cluster, count(*) AS n FROM (SELECT list_transform(cs, lambda c: list_distance(v, c)) AS ds FROM p, last) GROUP BY 1"


@query(f"""WITH RECURSIVE {POINTS}, c AS (SELECT 0 AS step, list(v ORDER BY vec_id) AS cs, CAST(1 AS DOUBLE) AS moved FROM (SELECT * FROM p ORDER BY vec_id LIMIT 16) UNION ALL
SELECT step + 1, new, list_max(list_transform(list_zip(cs, new), lambda q: list_distance(q[1], q[2]))) FROM (
SELECT a.step, any_value(a.cs) AS cs, list(coalesce(b.m, a.cs[a.k]) ORDER BY a.k) AS new FROM (SELECT step, cs, unnest(range(1, len(cs) + 1)) AS k FROM c WHERE step < 20 AND moved >= 0.001) a LEFT JOIN (
SELECT k, list(m ORDER BY d) AS m FROM (SELECT k, d, avg(v[d]) AS m FROM (SELECT v, list_position(ds, list_min(ds)) AS k, unnest(range(1, len(v) + 1)) AS d FROM (SELECT v, list_transform(cs, lambda x: list_distance(v, x)) AS ds FROM c, p WHERE step < 20 AND moved >= 0.001)) GROUP BY 1, 2) GROUP BY 1) b ON a.k = b.k GROUP BY 1)),
last AS (SELECT cs FROM c ORDER BY step DESC LIMIT 1) {SIZES}""")
def ml_kmeans(t: Tables) -> DataFrame:
    rows = t.embeddings.order_by(lambda e: e.vec_id).limit(16).to_array()
    centres = L.kmeans(t.embeddings.df, "embedding", [list(map(float, r["embedding"])) for r in rows])
    return t.embeddings.df.groupBy(L.nearest(F.col("embedding"), centres).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query()
def ml_k_medoids(t: Tables) -> DataFrame:
    keys = L.k_medoids(t.embeddings.df, "vec_id", "embedding", 5)
    return t.spark.createDataFrame([(k,) for k in keys], "vec_id long")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def ml_linear_regression(t: Tables) -> DataFrame:
    b, a = L.linear_regression(t.lineitem.df, [F.col("l_quantity")], F.col("l_extendedprice"))
    return t.spark.createDataFrame([(round(a, 4), round(b, 2))], "slope double, intercept double")


@query("""WITH w AS (SELECT l_quantity AS x, l_extendedprice AS y, exp(-(l_quantity - 25) * (l_quantity - 25) / 200) AS w FROM lineitem),
s AS (SELECT sum(w) AS n, sum(w * x) AS x, sum(w * x * x) AS xx, sum(w * y) AS y, sum(w * x * y) AS xy FROM w)
SELECT round((n * xy - x * y) / (n * xx - x * x), 4) AS slope, round((y * xx - x * xy) / (n * xx - x * x), 2) AS intercept FROM s""")
def ml_weighted_regression(t: Tables) -> DataFrame:
    x = F.col("l_quantity")
    b, a = L.linear_regression(t.lineitem.df, [x], F.col("l_extendedprice"), F.exp(-(x - 25) * (x - 25) / 200))
    return t.spark.createDataFrame([(round(a, 4), round(b, 2))], "slope double, intercept double")


@query("""WITH w AS (SELECT c_acctbal / 1000 AS x, o_totalprice AS y, exp(-(c_acctbal / 1000 - 5) * (c_acctbal / 1000 - 5) / 8) AS w FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT sum(w) AS n, sum(w * x) AS x, sum(w * x * x) AS xx, sum(w * y) AS y, sum(w * x * y) AS xy FROM w)
SELECT round((n * xy - x * y) / (n * xx - x * x), 2) AS slope, round((y * xx - x * xy) / (n * xx - x * x), 2) AS intercept FROM s""")
def mixed_customer_regression(t: Tables) -> DataFrame:
    """A join's result goes into a weighted regression."""
    joined = t.orders.join(t.customer).where_eq(lambda o: o.o_custkey, lambda c: c.c_custkey).select(lambda o, c: {"x": c.c_acctbal / 1000, "y": o.o_totalprice})
    x = F.col("x")
    b, a = L.linear_regression(joined.df, [x], F.col("y"), F.exp(-(x - 5) * (x - 5) / 8))
    return t.spark.createDataFrame([(round(a, 2), round(b, 2))], "slope double, intercept double")


@query("""WITH d AS (SELECT l_quantity AS x, ln(l_tax + 1) AS y FROM lineitem), s AS (SELECT count(*) AS n, sum(x) AS x, sum(x * x) AS xx, sum(y) / sum(y) AS y, sum(x * y) / sum(y) AS xy FROM d)
SELECT round((n * y + x * xy) / 1000000, 4) AS theta_0, round((x * y + xx * xy) / 1000000, 4) AS theta_1 FROM s""")
def ml_unnormalised_step(t: Tables) -> DataFrame:
    """A column of ones and a measure; the target is a logarithm, as a share of its sum."""
    y = F.log(F.col("l_tax") + 1)
    total = t.lineitem.df.agg(F.sum(y)).first()[0]
    theta = L.unnormalised_step(t.lineitem.df, [F.lit(1.0), F.col("l_quantity")], y / F.lit(total))
    return t.spark.createDataFrame([tuple(round(x / 1000000, 4) for x in theta)], "theta_0 double, theta_1 double")


@query("SELECT CAST(sum(CASE WHEN 0.25 + 2 * (l_quantity / 50) - 3 * (l_extendedprice / 100000) < 0 THEN 1 ELSE 0 END) AS BIGINT) AS below, count(*) AS n FROM lineitem")
def ml_svm_classify(t: Tables) -> DataFrame:
    side = L.svm_classify([0.25, 2.0, -3.0], [F.col("x"), F.col("z")])
    return labelled(t).agg(F.count_if(side == -1).alias("below"), F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE d AS MATERIALIZED (SELECT l_quantity / 50 AS x, l_extendedprice / 100000 AS z, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
t AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS moved UNION ALL
SELECT step + 1, a + ga, b + gb, c + gc, abs(ga) + abs(gb) + abs(gc) FROM (SELECT step, a, b, c, avg(w) AS ga, avg(w * x) AS gb, avg(w * z) AS gc FROM (SELECT t.*, x, z, y - 1 / (1 + exp(-(a + b * x + c * z))) AS w FROM t, d WHERE step < 30 AND moved >= 0.001) GROUP BY ALL)),
l AS (SELECT * FROM t ORDER BY step DESC LIMIT 1)
SELECT CAST(0 AS INTEGER) AS i, round(a, 6) AS theta FROM l UNION ALL SELECT 1, round(b, 6) FROM l UNION ALL SELECT 2, round(c, 6) FROM l""")
def ml_logistic_regression(t: Tables) -> DataFrame:
    theta = L.logistic_regression(labelled(t), [F.lit(1.0), F.col("x"), F.col("z")], F.col("y"))
    return t.spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(theta)], "i int, theta double")


@query()
def ml_support_vector_machine(t: Tables) -> DataFrame:
    weights = L.support_vector_machine(labelled(t), [F.col("x"), F.col("z")], F.col("y"))
    return t.spark.createDataFrame([(i, round(w, 6)) for i, w in enumerate(weights)], "i int, weight double")


@query("""WITH d AS (SELECT l_quantity / 50 AS x, l_extendedprice / 100000 AS z, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
m AS (SELECT avg(y) AS phi, avg(x) FILTER (WHERE y = 0) AS m0_0, avg(z) FILTER (WHERE y = 0) AS m0_1, avg(x) FILTER (WHERE y = 1) AS m1_0, avg(z) FILTER (WHERE y = 1) AS m1_1 FROM d),
c AS (SELECT m.*, x - CASE WHEN y = 1 THEN m1_0 ELSE m0_0 END AS a, z - CASE WHEN y = 1 THEN m1_1 ELSE m0_1 END AS b FROM d, m)
SELECT round(first(phi), 6) AS phi, round(first(m0_0), 6) AS m0_0, round(first(m0_1), 6) AS m0_1, round(first(m1_0), 6) AS m1_0, round(first(m1_1), 6) AS m1_1,
round(sum(a * a), 3) AS s_0_0, round(sum(a * b), 3) AS s_0_1, round(sum(b * b), 3) AS s_1_1 FROM c""")
def ml_gaussian_discriminant(t: Tables) -> DataFrame:
    out = L.gaussian_discriminant(labelled(t), [F.col("x"), F.col("z")], F.col("y"))
    return out.select(*(F.round(c, 3 if c[0] == "s" else 6).alias(c) for c in out.columns))


@query("""WITH w AS (SELECT lang AS label, unnest(string_split(lower(text), ' ')) AS token FROM documents WHERE lang IS NOT NULL),
c AS (SELECT token, label, count(*) AS n FROM w GROUP BY ALL), l AS (SELECT label, sum(n) AS total FROM c GROUP BY 1), v AS (SELECT count(DISTINCT token) AS v FROM c), k AS (SELECT DISTINCT token FROM c)
SELECT k.token, l.label, coalesce(c.n, 0) AS n, round(ln((coalesce(c.n, 0) + 1) / (l.total + v.v)), 6) AS log_p FROM k CROSS JOIN l CROSS JOIN v LEFT JOIN c ON c.token = k.token AND c.label = l.label""")
def ml_naive_bayes(t: Tables) -> DataFrame:
    tokens = t.documents.where(lambda d: d.lang.isNotNull()).df.select(F.col("lang").alias("label"), F.explode(F.split(F.lower("text"), " ")).alias("token"))
    out = L.naive_bayes(tokens)
    return out.select("token", "label", "n", F.round("log_p", 6).alias("log_p"))


WORDS = "SELECT doc_id, lang AS label, unnest(string_split(lower(text), ' ')) AS token FROM documents WHERE lang IS NOT NULL"


@query(f"""WITH w AS ({WORDS}), c AS (SELECT token, label, count(*) AS n FROM w GROUP BY ALL), l AS (SELECT label, sum(n) AS total FROM c GROUP BY 1), v AS (SELECT count(DISTINCT token) AS v FROM c),
m AS (SELECT k.token, l.label, ln((coalesce(c.n, 0) + 1) / (l.total + v.v)) AS log_p FROM (SELECT DISTINCT token FROM c) k CROSS JOIN l CROSS JOIN v LEFT JOIN c ON c.token = k.token AND c.label = l.label),
p AS (SELECT lang AS label, ln(count(*) / (SELECT count(*) FROM documents WHERE lang IS NOT NULL)) AS log_prior FROM documents WHERE lang IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, token, count(*) AS times FROM w GROUP BY ALL),
s AS (SELECT doc_id, label, round(sum(times * (log_p + log_prior)), 9) AS score FROM d JOIN m USING (token) JOIN p USING (label) GROUP BY ALL),
b AS (SELECT doc_id, label FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1)
SELECT count(*) AS documents, count(*) FILTER (WHERE b.label <> d.lang) AS errors FROM b JOIN documents d USING (doc_id)""")
def ml_naive_bayes_errors(t: Tables) -> DataFrame:
    """The model's own documents classified: how many it takes for another language's."""
    docs = t.documents.where(lambda d: d.lang.isNotNull()).df
    tokens = docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("label"), F.explode(F.split(F.lower("text"), " ")).alias("token"))
    n = docs.count()
    priors = docs.groupBy(F.col("lang").alias("label")).agg(F.log(F.count(F.lit(1)) / F.lit(n)).alias("log_prior"))
    got = L.naive_bayes_classify(tokens.select("key", "token"), L.naive_bayes(tokens).select("token", "label", "log_p"), priors)
    return got.join(docs.select(F.col("doc_id").alias("key"), "lang"), "key").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("predicted") != F.col("lang")).alias("errors"))


#: Customers rate suppliers by what they order from them.
RATINGS = "SELECT o_custkey AS u, l_suppkey AS i, CAST(sum(l_quantity) AS DOUBLE) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"
SIMILAR = f"""WITH r AS ({RATINGS}), p AS (SELECT a.i AS item_a, b.i AS item_b, count(*) AS n, sum(a.x) AS a, sum(b.x) AS b, sum(a.x * b.x) AS ab, sum(a.x * a.x) AS aa, sum(b.x * b.x) AS bb FROM r a JOIN r b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2),
s AS (SELECT item_a, item_b, n AS common, (ab - a * b / n) / (sqrt(greatest(aa - a * a / n, 0)) * sqrt(greatest(bb - b * b / n, 0)) + 1) AS similarity FROM p)"""


def ratings(t: Tables) -> DataFrame:
    lines = t.orders.join(t.lineitem).where_eq(lambda o: o.o_orderkey, lambda l: l.l_orderkey).select(lambda o, l: {"user": o.o_custkey, "item": l.l_suppkey, "x": l.l_quantity})
    return lines.group_by(lambda r: (r.user, r.item)).select(lambda g: {"user": g.key._1, "item": g.key._2, "rating": g.sum(lambda r: r.x)}).df


@query(f"{SIMILAR} SELECT item_a, item_b, common, round(similarity, 6) AS similarity FROM s")
def ml_item_similarity(t: Tables) -> DataFrame:
    out = L.item_similarity(ratings(t))
    return out.select("item_a", "item_b", "common", F.round("similarity", 6).alias("similarity"))


@query(f"""{SIMILAR}, m AS (SELECT item_a AS rated, item_b AS item, similarity AS s FROM s WHERE similarity <> 0 UNION ALL SELECT item_b, item_a, similarity FROM s WHERE similarity <> 0),
f AS (SELECT u, item, sum(s * x) / (sum(abs(s)) + 1) AS preference FROM r JOIN m ON m.rated = r.i WHERE u = (SELECT min(u) FROM r) GROUP BY 1, 2)
SELECT u AS "user", CAST(row_number() OVER (ORDER BY preference DESC, item) AS INTEGER) AS rank, item, round(preference, 6) AS preference FROM f WHERE preference <> 0 QUALIFY rank <= 10""")
def ml_recommend_top_n(t: Tables) -> DataFrame:
    """The ten suppliers that one customer (the first) would like best."""
    r = ratings(t)
    one = r.agg(F.min("user")).first()[0]
    own = r.filter(F.col("user") == F.lit(one))
    return L.recommend(own, L.item_similarity(r, among=own.select("item")), 10).withColumn("preference", F.round("preference", 6))


@query("""WITH m AS (SELECT avg(hour(ts)) AS m FROM events), s AS (SELECT m, sqrt(sum((hour(ts) - m) * (hour(ts) - m))) / count(*) AS s FROM events, m GROUP BY 1)
SELECT hour(ts) AS hour, count(*) AS n, round(exp(-(hour(ts) - first(m)) * (hour(ts) - first(m)) / (2 * first(s) * first(s))) / sqrt(2 * pi() * first(s) * first(s)), 6) AS density FROM events, s GROUP BY 1""")
def mixed_hour_density(t: Tables) -> DataFrame:
    """The normal density of each hour, its deviation being the root of the sum of squares over the number (outside the root)."""
    r = t.events.df.agg(F.avg(F.hour("ts")).alias("m"), F.var_pop(F.hour("ts")).alias("v"), F.count(F.lit(1)).alias("n")).first()
    x = F.hour("ts")
    return t.events.df.groupBy(x.alias("hour")).agg(F.count(F.lit(1)).alias("n")).withColumn("density", F.round(L.normal_density(F.col("hour"), r["m"], (r["v"] * r["n"]) ** 0.5 / r["n"]), 6))


CELLS = "SELECT n_regionkey AS i, n_nationkey AS j, CAST(n_nationkey + 1 AS DOUBLE) AS v FROM nation"


@query(f"WITH c AS ({CELLS}), p AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.j = b.j GROUP BY 1, 2), w AS (SELECT i, CASE WHEN j >= 1 THEN j + 1 ELSE j END AS j, v FROM p UNION ALL SELECT i, 1, sum(CASE WHEN v > 5 THEN v ELSE 0 END) FROM c GROUP BY 1) SELECT i, CAST(j AS INTEGER) AS j, v FROM w")
def ml_matrix_helpers(t: Tables) -> DataFrame:
    """A matrix by its transpose, with a column of conditional row sums put in."""
    cells = t.nation.select(lambda n: {"i": n.n_regionkey, "j": n.n_nationkey, "v": (n.n_nationkey + 1).cast("double")}).df
    sums = L.row_sums(cells, F.col("v") > 5)
    return L.with_column_at(L.product(cells, L.transposed(cells)), 1, sums)


@query(f"""WITH RECURSIVE {POINTS}, c AS (SELECT 1 AS step, [v] AS cs FROM (SELECT v FROM p ORDER BY vec_id LIMIT 1) UNION ALL
SELECT step + 1, list_append(any_value(cs), first(v ORDER BY d DESC, vec_id)) FROM (SELECT step, cs, v, vec_id, list_min(list_transform(cs, lambda x: list_distance(v, x))) AS d FROM c, p WHERE step < 5) GROUP BY step),
last AS (SELECT cs FROM c ORDER BY step DESC LIMIT 1) {SIZES}""")
def ml_k_centers(t: Tables) -> DataFrame:
    centres = L.k_centers(t.embeddings.df, "vec_id", "embedding", 5)
    return t.embeddings.df.groupBy(L.nearest(F.col("embedding"), centres).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE v AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(1 AS DOUBLE) AS moved UNION ALL
SELECT step + 1, x, y, greatest(abs(x - a), abs(y - b)) FROM (SELECT step, a, b, least(0.9 * (0.9 * a + 0.1 * b) + 1, 0.9 * (0.2 * a + 0.8 * b) + 2) AS x, least(0.9 * (0.4 * a + 0.6 * b) + 3, 0.9 * (0.5 * a + 0.5 * b) + 0.5) AS y FROM v WHERE moved >= 1e-9)),
l AS (SELECT * FROM v ORDER BY step DESC LIMIT 1)
SELECT CAST(0 AS INTEGER) AS state, round(a, 6) AS value FROM l UNION ALL SELECT 1, round(b, 6) FROM l""")
def ml_value_iteration(t: Tables) -> DataFrame:
    v = L.value_iteration([[[0.9, 0.1], [0.4, 0.6]], [[0.2, 0.8], [0.5, 0.5]]], [[1.0, 3.0], [2.0, 0.5]], 0.9)
    return t.spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(v)], "state int, value double")


@query("SELECT event_type, round(avg(hour(ts)), 6) AS mean_hour, round(avg(1.0 / (value + 1)), 6) AS weight FROM events WHERE value >= 0 GROUP BY 1")
def ml_hour_profile(t: Tables) -> Table:
    return t.events.where(lambda e: e.value >= 0).group_by(lambda e: e.event_type).select(lambda g: {"event_type": g.key, "mean_hour": F.round(g.average(lambda e: F.hour(e.ts)), 6), "weight": F.round(g.average(lambda e: 1.0 / (e.value + 1)), 6)})
