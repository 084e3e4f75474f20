"""Graph workloads over edge tables (src, dst). Iterations cut their lineage with checkpoint() in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir (where that is unset and Spark runs on this machine alone, a temporary one)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that all machines share")
        folder = f"file://{tempfile.mkdtemp(prefix='tesserine-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the checkpoint folder."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def low_to_high(edges: DataFrame) -> DataFrame:
    """u, v, forth, back: each pair of linked nodes once, without loops, from the node of lower degree (of equal ones, the
    smaller), and whether there are edges u to v and v to u. No node has more than the root of twice the pairs as u."""
    e = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.bool_or(F.col("src") < F.col("dst")).alias("up"), F.bool_or(F.col("src") > F.col("dst")).alias("down"))
    deg = e.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").count()
    d = e.join(deg.toDF("a", "da"), "a").join(deg.toDF("b", "db"), "b")
    low = F.struct("da", "a") < F.struct("db", "b")
    pick = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    return d.select(pick("a", "b").alias("u"), pick("b", "a").alias("v"), pick("up", "down").alias("forth"), pick("down", "up").alias("back"))


def triples(o: DataFrame) -> DataFrame:
    """Every three nodes x, y, z that are linked with each other, once, with the pairs xy, yz and xz of low_to_high.

    For each pair xy, the later neighbours of both are met as arrays: what is shuffled is an array for each pair, not a row
    for each two pairs that share y. No array is longer than the root of twice the pairs."""
    later = o.groupBy("u").agg(F.collect_list("v").alias("vs"), F.map_from_entries(F.collect_list(F.struct("v", F.struct("forth", "back")))).alias("links"))
    of = lambda node, vs, links: later.select(F.col("u").alias(node), F.col("vs").alias(vs), F.col("links").alias(links))
    pairs = o.select(F.col("u").alias("x"), F.col("v").alias("y"), F.struct("forth", "back").alias("xy")).join(of("y", "ys", "ylinks"), "y")
    met = pairs.join(of("x", "xs", "xlinks"), "x")
    return met.select("x", "y", "xy", F.explode(F.array_intersect("xs", "ys")).alias("z"), "xlinks", "ylinks").select("x", "y", "z", "xy", F.element_at("ylinks", F.col("z")).alias("yz"), F.element_at("xlinks", F.col("z")).alias("xz"))


def triangles(edges: DataFrame) -> DataFrame:
    """n_triangles: the triples of nodes that are linked with each other, directions and repeats aside.

    As in triples(), but the arrays hold nodes only."""
    o = low_to_high(edges).select("u", "v")
    later = o.groupBy("u").agg(F.collect_list("v").alias("vs"))
    pairs = o.toDF("x", "y").join(later.toDF("y", "ys"), "y")
    met = pairs.join(later.toDF("x", "xs"), "x").select(F.size(F.array_intersect("xs", "ys")).alias("n"))
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_triangles"))


def pagerank(edges: DataFrame, iterations: int = 100, additive: float = 0.15) -> DataFrame:
    """node, rank: rank' = additive + (1 - additive) * sum of rank / out_degree over incoming edges; ranks begin at 1 / nodes."""
    deg = checkpointed(degrees(edges))
    n = deg.count()
    out = edges.join(deg.select(F.col("node").alias("src"), "out_degree"), "src").persist(StorageLevel.MEMORY_AND_DISK)
    ranks = deg.select("node", F.lit(1.0 / max(1, n)).alias("rank"))
    for i in range(iterations):
        given = out.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out_degree")).alias("got"))
        ranks = deg.select("node").join(given, "node", "left").select("node", (F.lit(additive) + F.lit(1 - additive) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 5 == 4:
            ranks = checkpointed(ranks)
    out.unpersist()
    return ranks


def clustering(edges: DataFrame, threshold: int = 2) -> DataFrame:
    """node, coefficient: over ordered pairs t, u of a node's reciprocal neighbours, the edges among them divided by two for
    each pair; 0 for fewer neighbours than the threshold.

    Neighbours of neighbours are met by way of triples, so a node of high degree doesn't open all pairs around it. Each
    node of a triple that counts has a reciprocal neighbour, so only pairs of such nodes are put in order and met."""
    e = edges.filter("src <> dst")
    linked = e.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.bool_or(F.col("src") < F.col("dst")).alias("forth"), F.bool_or(F.col("src") > F.col("dst")).alias("back"))
    mutual = checkpointed(linked.filter("forth AND back"))
    touched = mutual.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    among = e.join(touched.toDF("src"), "src", "semi").join(touched.toDF("dst"), "dst", "semi").select("src", "dst")
    o = checkpointed(low_to_high(among))
    count = mutual.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    many = lambda link: link["forth"].cast("int") + link["back"].cast("int")
    both = lambda link: link["forth"] & link["back"]
    xy, yz, xz = F.col("xy"), F.col("yz"), F.col("xz")
    # each ordered pair (t, u) counts u->t and t->u, so every edge among neighbours counts twice
    seen = F.array(*(F.struct(node.alias("node"), F.when(both(p) & both(q), 2 * many(r)).otherwise(0).alias("hits")) for node, p, q, r in ((F.col("x"), xy, xz, yz), (F.col("y"), xy, yz, xz), (F.col("z"), xz, yz, xy))))
    found = triples(o).select(F.inline(seen)).groupBy("node").agg(F.sum("hits").alias("hits"))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    total = 2 * F.col("k") * (F.col("k") - 1)
    joined = nodes.join(count, "node", "left").join(found, "node", "left")
    return joined.select("node", F.when((F.col("k") >= threshold) & (total > 0), F.coalesce("hits", F.lit(0)) / total).otherwise(F.lit(0.0)).alias("coefficient"))
