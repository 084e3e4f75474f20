"""Sinks and sources in round trips: a table is written as text in the shared folder and read back by a source."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.operators.graph import checkpoint_folder
from tesserine.operators.table import Table
from tesserine.plans.registry import Tables, query
from tesserine.sources import readers, sinks


def folder(t: Tables, tag: str) -> str:
    """A new folder, removed when the session ends."""
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(t.spark)}/{tag}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def saved(t: Tables, tag: str, df: DataFrame, line: Column) -> str:
    path = f"{folder(t, tag)}/lines"
    sinks.write_lines(df, path, line)
    return path


def fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in pairs])


def joined(separator: str, *names: str) -> Column:
    return F.concat_ws(separator, *(F.col(n).cast("string") for n in names))


SUPPLIERS = fields(("s_suppkey", T.LongType()), ("s_name", T.StringType()), ("s_nationkey", T.LongType()))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_totalprice > 100000 AS large FROM orders")
def src_delimited(t: Tables) -> DataFrame:
    """Typed fields, dates and booleans among them, parted by a regular expression."""
    rows = t.orders.df.withColumn("large", F.col("o_totalprice") > 100000).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    path = saved(t, "orders", rows, joined("|", "o_orderkey", "o_orderdate", "o_totalprice", "large"))
    return readers.from_file(t.spark, path, r"\|", fields(("o_orderkey", T.LongType()), ("o_orderdate", T.DateType()), ("o_totalprice", T.DoubleType()), ("large", T.BooleanType())))


@query("SELECT TRY_CAST(CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE CAST(s_suppkey AS VARCHAR) END AS BIGINT) AS s_suppkey, s_name FROM supplier")
def src_delimited_permissive(t: Tables) -> DataFrame:
    """Malformed numbers are null."""
    key = F.when(F.col("s_suppkey") % 3 == 0, "x").otherwise(F.col("s_suppkey").cast("string"))
    path = saved(t, "malformed", t.supplier.df, F.concat_ws("|", key, F.col("s_name")))
    return readers.from_file(t.spark, path, r"\|", fields(("s_suppkey", T.LongType()), ("s_name", T.StringType())), permissive=True)


@query("SELECT c_name AS value FROM customer")
def src_lines(t: Tables) -> DataFrame:
    return readers.from_file(t.spark, saved(t, "customers", t.customer.df, F.col("c_name")))


@query("SELECT unnest(string_split(p_name, ' ')) AS value FROM part")
def src_lines_flattened(t: Tables) -> DataFrame:
    return readers.read_lines_flattened(t.spark, saved(t, "parts", t.part.df, F.col("p_name")), " ")


@query("SELECT 'é' || n_name AS value FROM nation")
def src_charset(t: Tables) -> DataFrame:
    """Latin-1 text."""
    path = f"{folder(t, 'latin')}/lines"
    t.nation.df.select(F.concat(F.lit("é"), "n_name").alias("value")).write.option("encoding", "ISO-8859-1").csv(path)
    return readers.read_lines(t.spark, path, "ISO-8859-1")


@query("SELECT n_name AS value FROM nation UNION ALL SELECT r_name FROM region")
def src_several_paths(t: Tables) -> DataFrame:
    return readers.read_lines(t.spark, [saved(t, "nations", t.nation.df, F.col("n_name")), saved(t, "regions", t.region.df, F.col("r_name"))])


@query("SELECT s_name AS value FROM supplier")
def src_glob(t: Tables) -> DataFrame:
    """Files by a pattern, compressed by their extension."""
    path = f"{folder(t, 'gzip')}/lines"
    t.supplier.df.select(F.col("s_name").alias("value")).write.option("compression", "gzip").text(path)
    return readers.read_lines(t.spark, f"{path}/part-*.gz")


@query("SELECT p_name AS value FROM part")
def src_bytes(t: Tables) -> DataFrame:
    """Records between delimiters that aren't line ends."""
    path = f"{folder(t, 'bytes')}/records"
    t.part.df.select(F.col("p_name").alias("value")).write.option("lineSep", ";").text(path)
    return readers.read_bytes(t.spark, path, ";").select(F.decode("value", "UTF-8").alias("value"))


@query("SELECT substr(p_name, i * 4 + 1, 4) AS value FROM (SELECT p_name, unnest(range(CAST(ceil(length(p_name) / 4) AS BIGINT))) AS i FROM part)")
def src_bytes_flattened(t: Tables) -> DataFrame:
    path = f"{folder(t, 'bytes')}/records"
    t.part.df.select(F.col("p_name").alias("value")).write.option("lineSep", ";").text(path)
    return readers.read_bytes_flattened(t.spark, path, ";", 4).select(F.decode("value", "UTF-8").alias("value"))


@query("SELECT n_regionkey AS region, n_name AS value FROM nation")
def src_lines_with_file(t: Tables) -> DataFrame:
    """Each line with the folder that its file lies in."""
    path = f"{folder(t, 'by-region')}/lines"
    t.nation.df.select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("region")).write.partitionBy("region").text(path)
    lines = readers.read_lines_with_file(t.spark, path)
    return lines.select(F.regexp_extract("file", r"region=(\d+)/", 1).cast("long").alias("region"), "value")


@query("SELECT count(*) AS n, CAST(sum(length(r_name)) AS BIGINT) AS letters FROM region")
def src_local_lines(t: Tables) -> DataFrame:
    """Lines one after the other on the driver, added up as they come."""
    n = letters = 0
    for line in readers.local_lines(t.spark, saved(t, "regions", t.region.df, F.col("r_name"))):
        n, letters = n + 1, letters + len(line)
    return t.spark.createDataFrame([(n, letters)], "n long, letters long")


def edge_file(t: Tables) -> str:
    rows = t.lineitem.df.select("l_suppkey", "l_partkey").distinct()
    return saved(t, "edges", rows, F.when(F.col("l_suppkey") % 10 == 0, F.concat(F.lit("# "), joined("\t", "l_suppkey", "l_partkey"))).otherwise(joined("\t", "l_suppkey", "l_partkey")))


@query("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey % 10 <> 0")
def src_edge_list(t: Tables) -> DataFrame:
    return readers.edge_list(t.spark, edge_file(t))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS d FROM lineitem WHERE l_suppkey % 10 <> 0), n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT s AS node FROM e UNION SELECT d FROM e))
SELECT a.id AS src, b.id AS dst FROM e JOIN n a ON a.node = s JOIN n b ON b.node = d""")
def src_edge_list_renumbered(t: Tables) -> DataFrame:
    return readers.renumber(readers.edge_list(t.spark, edge_file(t)))[0]


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier")
def src_arff(t: Tables) -> DataFrame:
    """Header, comment and empty lines before the data."""
    head = t.spark.createDataFrame([("@RELATION suppliers",), ("% a comment",), ("",), ("@ATTRIBUTE key NUMERIC",), ("@DATA",)], "value string")
    rows = head.union(t.supplier.df.select(joined(", ", "s_suppkey", "s_name", "s_nationkey")))
    return readers.arff(t.spark, saved(t, "arff", rows, F.col("value")), SUPPLIERS)


@query("SELECT [CAST(l_quantity AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE)] AS row FROM lineitem")
def src_matrix(t: Tables) -> DataFrame:
    return readers.matrix(t.spark, saved(t, "matrix", t.lineitem.df, joined("  ", "l_quantity", "l_discount", "l_tax")))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS position, CAST(s_acctbal AS DOUBLE) AS value FROM supplier")
def src_vector(t: Tables) -> DataFrame:
    """Positions follow the lines of the one file, which holds the numbers in order of their keys."""
    path = f"{folder(t, 'vector')}/lines"
    sinks.write_lines_sequential(t.supplier.df.orderBy("s_suppkey"), path, F.col("s_acctbal"))
    return readers.vector(t.spark, path)


@query("SELECT CAST(n_regionkey AS INTEGER) AS label, CAST(sum(n_nationkey) AS BIGINT) AS tokens, CAST(sum(length(n_name) + 1) AS BIGINT) AS n FROM nation GROUP BY 1")
def src_token_matrix(t: Tables) -> DataFrame:
    """A document for each nation: its region as label, and two tokens, at the nation's number and at 0."""
    head = t.spark.createDataFrame([("a line of no meaning",), ("25 25",), ("tokens",)], "value string")
    body = t.nation.df.select(F.concat_ws(" ", F.col("n_regionkey"), F.lit("0 1"), F.col("n_nationkey"), F.length("n_name"), F.lit("-1")))
    path = f"{folder(t, 'tokens')}/lines"
    sinks.write_lines_sequential(head.union(body), path)
    labels, cells = readers.token_matrix(t.spark, path)
    return cells.join(labels, "doc").groupBy("label").agg(F.sum("token").alias("tokens"), F.sum("n").alias("n"))


@query("SELECT n_name AS value FROM nation UNION ALL SELECT r_name FROM region")
def sink_append(t: Tables) -> DataFrame:
    path = saved(t, "append", t.nation.df, F.col("n_name"))
    sinks.write_lines(t.region.df, path, "r_name", append=True)
    return readers.read_lines(t.spark, path)


@query("SELECT r_name AS value FROM region")
def sink_overwrite(t: Tables) -> DataFrame:
    path = saved(t, "overwrite", t.nation.df, F.col("n_name"))
    sinks.write_lines(t.region.df, path, "r_name")
    return readers.read_lines(t.spark, path)


@query("SELECT 1 AS files, count(*) AS n FROM orders")
def sink_sequential(t: Tables) -> DataFrame:
    """All rows in one file."""
    path = f"{folder(t, 'one')}/lines"
    sinks.write_lines_sequential(t.orders.df, path, "o_orderkey")
    return readers.read_lines_with_file(t.spark, path).agg(F.count_distinct("file").cast("int").alias("files"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM lineitem")
def act_size(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(t.lineitem.size(),)], "n long")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def act_to_array(t: Tables) -> DataFrame:
    some = t.nation.where(lambda n: n.n_regionkey == 1).select(lambda n: {"n_nationkey": n.n_nationkey, "n_name": n.n_name})
    return t.spark.createDataFrame(some.to_array(), some.to_df().schema)


@query("SELECT r_regionkey, r_name FROM region")
def src_from_array(t: Tables) -> Table:
    rows = [(r["r_regionkey"], r["r_name"]) for r in t.region.to_array()]
    return Table.of(t.spark, rows, "r_regionkey long, r_name string")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def act_print(t: Tables) -> DataFrame:
    """What the box of a printed table holds, cut out of its text again."""
    text = sinks.table_text(t.region.select(lambda r: {"r_regionkey": r.r_regionkey, "r_name": r.r_name}).to_df())
    cells = [tuple(x.strip() for x in line.strip("| ").split("|")) for line in text.splitlines()[3:-1]]
    return t.spark.createDataFrame(cells, "r_regionkey string, r_name string")


@query()
def act_timed(t: Tables) -> DataFrame:
    """The names of timed blocks."""
    took: dict[str, float] = {}
    with sinks.timed("size", took, t.region.df):
        t.region.size()
    with sinks.timed("all rows", took):
        sinks.materialise(t.nation.df)
    return t.spark.createDataFrame([(name,) for name in took], "block string")
