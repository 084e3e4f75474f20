"""A Boltzmann machine and densities over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.operators import inference
from tesserine.plans.registry import Tables, query


@query()
def ml_boltzmann_machine(t: Tables) -> DataFrame:
    """The squared error of each epoch on the signs of all vectors."""
    signs = t.embeddings.df.select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("double")).alias("p"))
    errors = inference.boltzmann_machine(signs, "vec_id", "p", hidden=8, batches=4)[3]
    return t.spark.createDataFrame([(i, round(e, 3)) for i, e in enumerate(errors)], "epoch int, error double")


@query("""WITH p AS (SELECT c_custkey, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer)
SELECT a.c_custkey AS key, CAST(count(*) AS BIGINT) AS n FROM p a JOIN p b ON abs(a.x - b.x) + abs(a.y - b.y) < 5 GROUP BY 1""")
def ml_local_density(t: Tables) -> DataFrame:
    """How many customers are alike in balance and nation."""
    points = t.customer.df.select("c_custkey", F.array(F.col("c_acctbal") / 100, F.col("c_nationkey").cast("double")).alias("p"))
    return inference.local_density(points, "c_custkey", "p", 5.0)
