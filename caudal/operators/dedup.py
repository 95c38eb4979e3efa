"""One row for each business key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order; rows with null keys form groups of their own, as in GROUP BY."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def smallest_per_key(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The smallest row of ``columns`` (nulls first) of each key, by hash-combined minima and without sorting groups."""
    one = df.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("__one"))
    return one.select(*keys, *[F.col(f"__one.{c}").alias(c) for c in columns if c not in keys])


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
