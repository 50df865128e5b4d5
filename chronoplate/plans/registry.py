"""Registered queries and the DuckDB SQL that each is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """Each part's key with one of a short list of rows: that of its key's remainder."""
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i INT, {schema}")
    keys = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(rows)).cast("int").alias("_i"))
    return keys.join(F.broadcast(given), "_i").drop("_i")


def dealt_sql(n: int, results: str) -> str:
    """What dealt() gives, from SQL of the results by `id` from 1."""
    return f"SELECT p_partkey, t.* FROM part JOIN ({results}) t ON t.id = p_partkey % {n} + 1"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines give the same values; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def q_columns(q: Column, prefix: str = "q") -> list[Column]:
    return [q[c].alias(f"{prefix}{c}") for c in "xyzw"]
