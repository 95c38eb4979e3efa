"""Comparison of two result tables and checks of a table's integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """For each common column: rows that agree, differ, or are only on one side. Rows are aligned by key, never by position."""
    left, right = a.withColumn("__a", F.lit(True)), b.withColumn("__b", F.lit(True))
    columns = [c for c in a.columns if c in b.columns and c not in keys]
    for c in columns:
        left, right = left.withColumnRenamed(c, f"__a_{c}"), right.withColumnRenamed(c, f"__b_{c}")
    on = reduce(lambda x, y: x & y, [left[k].eqNullSafe(right[k]) for k in keys])
    both = left.join(right, on, "full_outer")
    parts = []
    for c in columns:
        x, y = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        if dict(a.dtypes)[c] in ("double", "float", "int", "bigint") or dict(a.dtypes)[c].startswith("decimal"):
            close = F.abs(x.cast("double") - y.cast("double")) <= tolerance * F.greatest(F.abs(y.cast("double")), F.lit(1e-12))
            same = F.coalesce(close, x.isNull() & y.isNull())
        else:
            same = x.eqNullSafe(y)
        there = F.col("__a") & F.col("__b")
        parts += [F.count_if(there & same).alias(f"{c}|iguales"), F.count_if(there & ~same).alias(f"{c}|distintas")]
    one = both.agg(F.count_if(F.col("__b").isNull()).alias("__l"), F.count_if(F.col("__a").isNull()).alias("__r"), *parts)
    rows = [F.struct(F.lit(c).alias("columna"), F.col(f"{c}|iguales").alias("iguales"), F.col(f"{c}|distintas").alias("distintas"), F.col("__l").alias("solo_a"), F.col("__r").alias("solo_b")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def invariants(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """``control, casos, cumple`` of each named frame of violations."""
    parts = [df.agg(F.count(F.lit(1)).alias("casos")).select(F.lit(name).alias("control"), "casos") for name, df in checks]
    return reduce(DataFrame.unionByName, parts).withColumn("cumple", F.col("casos") == 0)
