"""Registration of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """``t.documents`` reads the table of that name under the directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, schema: str, values: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(values, schema)


class Suite:
    """Queries by name; ``sql`` is DuckDB SQL for the same rows, None where SQL has no form."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def tokens_sql(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({column}), '[^\w\s''-]', ' ', 'g'), '\s+'), lambda x: length(x) > 1)"
