"""Tables, arrays, sources and sinks on small inputs."""

import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.functions import arrays as A
from tesserine.functions import scalars as S
from tesserine.operators import graph, learning
from tesserine.operators.table import Table
from tesserine.sources import readers, sinks
from tesserine.streaming import windows

ITEM = "id int, quantity int, price double, status string"
ROWS = [(0, 10, 2.49, "N"), (1, 0, 49.95, "B"), (2, 1000, 0.99, "N"), (3, 18, 5.99, "S")]


@pytest.fixture(scope="module")
def items(spark):
    return Table.of(spark, ROWS, ITEM)


def values(table):
    return [tuple(r) for r in table.to_array()]


def test_select_where(items):
    assert [v for (v,) in values(items.select(lambda i: F.round(i.quantity * i.price, 2)))] == [24.9, 0.0, 990.0, 107.82]
    assert {r[0] for r in values(items.where(lambda i: i.status == "N"))} == {0, 2}
    assert items.where(lambda i: i.status == "T").size() == 0


def test_aggregates(items):
    assert items.sum(lambda i: i.quantity).scalar() == 1028
    assert items.min(lambda i: i.price).scalar() == 0.99
    assert items.max(lambda i: i.id).scalar() == 3
    assert abs(items.average(lambda i: i.price).scalar() - 14.855) < 1e-3
    none = items.where(lambda i: i.id > 9)
    assert none.sum(lambda i: i.quantity).scalar() == 0 and none.min(lambda i: i.id).scalar() is None
    assert none.min(lambda i: i.id, empty="bound").scalar() == 2**31 - 1
    assert items.int_average(lambda i: -i.quantity).scalar() == -257


def test_groups(items):
    got = items.group_by(lambda i: i.status).select(lambda g: {"k": g.key, "s": g.sum(lambda i: i.quantity), "p": g.min(lambda i: i.price), "n": g.count()})
    assert set(values(got)) == {("N", 1010, 0.99, 2), ("B", 0, 49.95, 1), ("S", 18, 5.99, 1)}
    some = items.where(lambda i: i.quantity > 0).group_by(lambda i: i.status).select(lambda g: {"k": g.key, "s": g.sum(lambda i: i.quantity), "x": g.max(lambda i: i.quantity), "a": F.round(g.average(lambda i: i.price), 2), "n": g.count()})
    assert set(values(some)) == {("N", 1010, 1000, 1.74, 2), ("S", 18, 18, 5.99, 1)}
    assert sorted(v for (v,) in values(items.group_by(lambda i: i.status).select_many(lambda i: i.quantity))) == [0, 10, 18, 1000]
    assert items.where(lambda i: i.id > 9).group_by(lambda i: i.status).select(lambda g: {"n": g.count()}).size() == 0
    # a key that has a column's name doesn't hide the column
    assert values(items.group_by(lambda i: {"quantity": i.id * 0}).select(lambda g: {"k": g.key, "s": g.sum(lambda i: i.quantity)})) == [(0, 1028)]


def test_order_and_join(spark, items):
    assert [r[1] for r in values(items.order_by(lambda i: i.quantity))] == [0, 10, 18, 1000]
    assert [(r[3], r[1]) for r in values(items.order_by_descending(lambda i: i.status).then_by(lambda i: i.quantity))] == [("S", 18), ("N", 10), ("N", 1000), ("B", 0)]
    with pytest.raises(ValueError):
        items.then_by(lambda i: i.id)
    with pytest.raises(ValueError):
        items.first()
    more = Table.of(spark, [*ROWS, (4, 22, 2.99, "N")], ITEM)
    joined = items.join(more).where_eq(lambda a: a.id, lambda b: b.id).select(lambda a, b: {"q": a.quantity})
    assert sorted(v for (v,) in values(joined)) == [0, 10, 18, 1000]


def test_arrays(spark):
    one = spark.range(1)
    at = lambda c: one.select(c.alias("x")).first()["x"]
    assert at(F.size(A.flat_map(A.indices(0, 1000), lambda i: A.from_function(10, lambda j: i)))) == 10_000
    assert at(A.reduce_(A.indices(0, 1000), F.lit(0), lambda s, x: s + x)) == 499_500
    assert at(F.size(A.indices(3, 3))) == 0
    assert at(A.intersect(F.array(*map(F.lit, [1, 1, 2, 3])), F.array(*map(F.lit, [1, 3, 1, 1])))) == [1, 1, 3]
    with pytest.raises(Exception, match="unequal"):
        at(A.zip_(A.indices(0, 3), A.indices(0, 4), lambda a, b: a + b))


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a\na a\na a a\n")
    assert readers.read_lines(spark, str(tmp_path / "a.txt")).count() == 3
    assert readers.read_lines_flattened(spark, str(tmp_path / "a.txt"), " ").count() == 6
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("1|2.5|true|2020-01-02||\n2|x|no|2020-01-03||\n")
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("d", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("t", T.DateType()), T.StructField("s", T.StringType())])
    path = str(tmp_path / "b.txt.gz")
    rows = readers.from_file(spark, path, r"\|", schema, permissive=True).orderBy("i").collect()
    assert [tuple(r)[:3] for r in rows] == [(1, 2.5, True), (2, None, False)] and rows[0]["s"] == ""
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.from_file(spark, path, r"\|", schema).collect()
    (tmp_path / "c.txt").write_bytes("é\nü\n".encode("latin-1"))
    assert {r["value"] for r in readers.read_lines(spark, str(tmp_path / "c.txt"), "ISO-8859-1").collect()} == {"é", "ü"}
    (tmp_path / "d.bin").write_bytes(b"abcd;ef;g")
    assert [bytes(r["value"]) for r in readers.read_bytes(spark, str(tmp_path / "d.bin"), ";").collect()] == [b"abcd", b"ef", b"g"]
    assert [bytes(r["value"]) for r in readers.read_bytes_flattened(spark, str(tmp_path / "d.bin"), ";", 2).collect()] == [b"ab", b"cd", b"ef", b"g"]
    assert readers.read_lines_with_file(spark, str(tmp_path / "a.txt")).first()["file"].endswith("a.txt")
    assert list(readers.local_lines(spark, str(tmp_path / "a.txt"))) == ["a", "a a", "a a a"]
    (tmp_path / "e.txt").write_text("# x\n10\t20\n20\t30\n")
    edges, ids = readers.renumber(readers.edge_list(spark, str(tmp_path / "e.txt")))
    assert {tuple(r) for r in edges.collect()} == {(0, 1), (1, 2)} and ids.count() == 3
    (tmp_path / "f.arff").write_text("% c\n@relation r\n@data\n1.5,a\n2.5,b\n")
    assert readers.arff(spark, str(tmp_path / "f.arff"), T.StructType([T.StructField("x", T.DoubleType()), T.StructField("c", T.StringType())])).count() == 2
    (tmp_path / "g.txt").write_text("1 2\n3 4\n")
    assert sorted(r["row"] for r in readers.matrix(spark, str(tmp_path / "g.txt")).collect()) == [[1.0, 2.0], [3.0, 4.0]]


def test_sinks(spark, tmp_path):
    df = spark.range(5)
    path = str(tmp_path / "out")
    sinks.write_lines(df, path, F.col("id"))
    sinks.write_lines_sequential(df, path, F.col("id"), append=True)
    assert readers.read_lines(spark, path).count() == 10
    assert "no rows" in sinks.table_text(df.filter("false")) and sinks.table_text(df, 2).endswith("...")
    took = {}
    with sinks.timed("x", took, df):
        sinks.materialise(df)
    assert took["x"] > 0


def test_graph_and_learning(spark):
    e = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1), (0, 2), (2, 0), (2, 3), (3, 3)], "src long, dst long")
    assert graph.triangles(e).first()[0] == 1
    assert {r["node"]: r["coefficient"] for r in graph.clustering(e).collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.0}
    pts = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in enumerate([0, 1, 10, 11])], "id long, p array<double>")
    assert sorted(learning.kmeans(pts, "p", [[0.0, 0.0], [5.0, 0.0]])) == [[0.5, 0.0], [10.5, 0.0]]
    assert learning.k_centers(pts, "id", "p", 2) == [[0.0, 0.0], [11.0, 0.0]]
    line = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(5)], "x double, y double")
    assert [round(v, 6) for v in learning.linear_regression(line, [F.col("x")], F.col("y"))] == [1.0, 2.0]


def test_stream(spark):
    sf = "/root/testdata/sf0.001"
    q = windows.windowed(windows.event_stream(spark, sf)).writeStream.outputMode("complete").format("memory").queryName("event_windows").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["window_start"].date(), r["event_type"], r["n"])
    got = {key(r) for r in spark.table("event_windows").collect()}
    assert got == {key(r) for r in windows.windowed(spark.read.parquet(f"{sf}/events.parquet")).collect()}


def test_support_vector_machine(spark):
    from tesserine.operators.learning import support_vector_machine

    xs = [F.col("a"), F.col("b")]
    rows = [(-1.0, 3.0, 0), (1.0, 3.0, 1), (-4.0, -3.0, 0), (5.0, -3.0, 1), (None, 1.0, 1), (2.0, 2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    bias, a, b = support_vector_machine(df, xs, F.col("y"), tolerance=1e-6)
    # the widest street between the classes is |a| < 1
    assert abs(a - 1) < 0.05 and abs(b) < 0.05 and abs(bias) < 0.2
    assert support_vector_machine(df.filter("false"), xs, F.col("y")) == [0.0, 0.0, 0.0]


def test_helper_columns_hide_nothing(spark):
    rows = Table.of(spark, [(1, 5, 9), (1, 3, 8), (2, 4, 7), (None, 1, 6)], "k int, rank int, least int")
    assert set(values(rows.distinct(lambda r: r.k, order=lambda r: r.rank))) == {(1, 3, 8), (2, 4, 7), (None, 1, 6)}
    assert set(values(rows.where_least(lambda r: r.k, lambda r: r.rank))) == {(1, 3, 8), (2, 4, 7)}
    assert values(rows.at(1, lambda r: r.rank)) == [(1, 3, 8)]
    got = rows.group_by(lambda r: {"rank": r.k}).select(lambda g: {"k": g.key, "s": g.sum(lambda r: r.rank), "few": g.where(lambda r: r.rank > 4).sum(lambda r: r.least)})
    assert set(values(got)) == {(1, 8, 9), (2, 4, 0), (None, 1, 0)}


def test_whole_numbers_stay_exact(spark):
    big = 2**53 + 1
    t = Table.of(spark, [(big,)], "x long")
    assert t.int_average(lambda r: r.x).scalar() == big
    assert values(t.select(lambda r: {"a": S.int_divide(r.x, F.lit(1)), "b": S.int_divide(-r.x, F.lit(2))})) == [(big, -(big // 2))]
    assert t.where(lambda r: r.x < 0).int_average(lambda r: r.x).scalar() is None


def test_reductions_by_function(spark, items):
    assert items.reduce(lambda i: i.quantity, 0, max).scalar() == 1000
    assert items.where(lambda i: i.id > 9).reduce(lambda i: i.quantity, 0, max).scalar() == 0
    assert set(values(items.group_by(lambda i: i.status).reduce(lambda i: i.quantity, 0, max, salts=2))) == {("N", 1000), ("B", 0), ("S", 18)}


def test_similarity_in_blocks(spark):
    """Pairs of a user's items are the same whatever the size of blocks, and agree with the definition."""
    import random

    draw = random.Random(2)
    rows = [(u, i, float(draw.randint(1, 9))) for u in range(12) for i in range(30) if draw.random() < 0.6]
    df = spark.createDataFrame(rows, "user long, item long, rating double")
    by = {(u, i): x for u, i, x in rows}
    want = {}
    for a in range(30):
        for b in range(a + 1, 30):
            both = [(by[u, a], by[u, b]) for u in range(12) if (u, a) in by and (u, b) in by]
            if both:
                ma, mb = (sum(v) / len(both) for v in zip(*both, strict=True))
                num = sum((x - ma) * (y - mb) for x, y in both)
                want[a, b] = (len(both), num / ((sum((x - ma) ** 2 for x, _ in both) * sum((y - mb) ** 2 for _, y in both)) ** 0.5 + 1))
    for block in (4, 500):
        got = {(r["item_a"], r["item_b"]): (r["common"], r["similarity"]) for r in learning.item_similarity(df, block=block).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == n and abs(got[k][1] - s) < 1e-9 for k, (n, s) in want.items())


def test_clustering_and_triangles_by_definition(spark):
    import itertools
    import random

    draw = random.Random(4)
    edges = {(draw.randrange(25), draw.randrange(25)) for _ in range(260)}
    df = spark.createDataFrame([*edges, (3, 3), (3, 3)], "src long, dst long")
    linked = {frozenset(e) for e in edges if e[0] != e[1]}
    assert graph.triangles(df).first()[0] == sum(all(frozenset(p) in linked for p in itertools.combinations(t, 2)) for t in itertools.combinations(range(25), 3))
    want = {}
    for n in {x for e in edges if e[0] != e[1] for x in e}:
        near = [m for m in range(25) if m != n and (n, m) in edges and (m, n) in edges]
        hits = sum(((t, u) in edges) + ((u, t) in edges) for t in near for u in near if t != u)
        want[n] = hits / (2 * len(near) * (len(near) - 1)) if len(near) >= 2 else 0.0
    got = {r["node"]: r["coefficient"] for r in graph.clustering(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - c) < 1e-9 for n, c in want.items())


def test_k_medoids(spark):
    pts = spark.createDataFrame([(i, [float(10 * (i % 3)) + 0.1 * (i // 3), 0.0]) for i in range(30)], "id long, p array<double>")
    # the middle of ten points in a row is one of its two middle ones
    assert [k % 3 for k in sorted(learning.k_medoids(pts, "id", "p", 3), key=lambda k: k % 3)] == [0, 1, 2]
    assert all(k // 3 in (4, 5) for k in learning.k_medoids(pts, "id", "p", 3))
    assert learning.k_medoids(pts.limit(0), "id", "p", 3) == []


def test_vector_and_token_matrix(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.txt").write_text("1.5\n2\n\n")
    (tmp_path / "v" / "b.txt").write_text("-3e2\n")
    assert sorted(map(tuple, readers.vector(spark, str(tmp_path / "v")).collect())) == [(0, 1.5), (1, 2.0), (2, -300.0)]
    (tmp_path / "m").write_text("a table\n2 4\nalpha beta gamma delta\n1 0 3 2 1 -1\n0 3 5 -1\n0 -1\n")
    labels, counts = readers.token_matrix(spark, str(tmp_path / "m"))
    assert [r["label"] for r in labels.orderBy("doc").collect()] == [1, 0, 0]
    assert [(r["token"], r["n"]) for r in counts.orderBy("doc", "token").collect()] == [(0, 3), (2, 1), (3, 5)]


def test_arrays_multiply_as_sql(spark, tmp_path):
    """Components just below a fortieth: their product is a whole number as float and below it as double."""
    import duckdb
    import numpy as np
    from tesserine import plans

    plans.load()
    x = (np.random.default_rng(1).normal(size=20_000_000) * 0.125).astype(np.float32)
    odd = x[np.floor(x * np.float32(40)) != np.floor(x.astype(float) * 40)][:2].tolist()
    assert len(odd) == 2
    rows = [(0, [0.25, 0.5, *odd]), (1, [*odd, 0.25, 0.5])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("arr_record_arithmetic", "arr_union", "arr_zip", "arr_zip_reduce", "arr_map"):
        want = dict(con.execute(plans.ORACLES[name]).fetchall())
        assert {r["vec_id"]: r["r"] for r in plans.QUERIES[name](spark, str(tmp_path)).collect()} == want


def test_similarity_among_items_and_by_chunks(spark):
    """Pairs with one of some items are those of all pairs; sums are the same however few pairs are opened at a time."""
    import random

    draw = random.Random(6)
    rows = [(u, i, float(draw.randint(1, 9))) for u in range(60) for i in range(40) if draw.random() < 0.4]
    df = spark.createDataFrame(rows, "user int, item int, rating double")
    get = lambda d: {(r["item_a"], r["item_b"]): (r["common"], round(r["similarity"], 9)) for r in d.collect()}
    all_ = get(learning.item_similarity(df))
    assert len(all_) == 40 * 39 // 2
    assert get(learning.item_similarity(df, most=50)) == all_
    named = df.withColumn("item", F.format_string("i%02d", "item")).withColumn("user", F.col("user").cast("string"))
    assert get(learning.item_similarity(named, most=500)) == {(f"i{a:02}", f"i{b:02}"): v for (a, b), v in all_.items()}
    some = spark.createDataFrame([(3,), (7,), (11,)], "item int")
    assert get(learning.item_similarity(df, among=some)) == {k: v for k, v in all_.items() if {3, 7, 11} & set(k)}


def test_traceroute_shuffles_once(spark):
    """Links are dealt once, as numbers."""
    from tesserine import plans

    plans.load()
    plan = plans.QUERIES["traceroute"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_triangles_meet_arrays_and_clustering_reciprocal_nodes(spark, monkeypatch):
    """Triangles shuffle no row for each two linked pairs; clustering puts only edges among nodes with reciprocal
    neighbours in order."""
    rows = [(s, 100 + p) for s in range(20) for p in range(50)] + [(1, 2), (2, 1), (2, 3), (3, 2), (1, 3)]
    df = spark.createDataFrame(rows, "src long, dst long")
    assert "array_intersect" in graph.triangles(df)._jdf.queryExecution().executedPlan().toString()
    assert graph.triangles(df).first()[0] == 1 + 3 * 50
    seen = []
    real = graph.low_to_high
    monkeypatch.setattr(graph, "low_to_high", lambda e: seen.append(e.count()) or real(e))
    got = {r["node"]: r["coefficient"] for r in graph.clustering(df).collect()}
    assert seen == [5]
    assert got == {n: 0.5 if n == 2 else 0.0 for n in [*range(20), *range(100, 150)]}  # 1 to 3, counted twice, of 2 * 2 * 1
