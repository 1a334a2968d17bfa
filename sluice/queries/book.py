"""A book of queries: name -> function, and the SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Book:
    def __init__(self) -> None:
        self.queries, self.sql = {}, {}

    def query(self, sql: str | None = None, name: str | None = None):
        """Adds a function under its name, or under `name` where that is an operator's own."""

        def add(f):
            self.queries[name or f.__name__] = f
            if sql:
                self.sql[name or f.__name__] = sql
            return f

        return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
