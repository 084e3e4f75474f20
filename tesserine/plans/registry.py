"""The registry of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserine.operators.table import Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> Table:
        return Table.parquet(self.spark, f"{self.dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of Tables that returns a Table or DataFrame, under its name."""

    def register(f: Callable[[Tables], Table | DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.to_df() if isinstance(out, Table) else out

        QUERIES[name or f.__name__] = run
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register
