"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition: list[str] | None = None, rows_per_file: int | None = None, resume: bool = False) -> bool:
    """Zstandard Parquet; whole or not at all. With ``resume`` a finished table is kept. Tells whether it wrote."""
    spark = df.sparkSession
    if resume:
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return False
    w = df.write.mode("overwrite").option("compression", "zstd")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition) if partition else w).parquet(path)
    return True


def write_sorted(df: DataFrame, path: str, *order: str) -> None:
    """Files that are sorted within and from one to the next; ranges keep it parallel."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)


def nested_as_text(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for consumers without nested types."""
    nested = ("array", "map", "struct")
    return df.select(*[F.to_json(c).alias(c) if kind.startswith(nested) else F.col(c) for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str, places: int = 4) -> None:
    """CSV with a header and rounded doubles."""
    rounded = [F.round(c, places).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in nested_as_text(df).dtypes]
    nested_as_text(df).select(*rounded).write.mode("overwrite").csv(path, header=True)


def anonymised(df: DataFrame, keys: list[str], names: DataFrame, drop: list[str]) -> DataFrame:
    """``df`` with key columns replaced through ``names(id, nuevo)``; rows with an unknown key and columns in ``drop`` stay out."""
    out = df.drop(*drop)
    for k in keys:
        m = names.select(F.col("id").alias(k), F.col("nuevo").alias(f"__{k}"))
        out = out.join(m, k).drop(k).withColumnRenamed(f"__{k}", k)
    return out.select(*[c for c in df.columns if c not in drop])


def spanish_number(x: float | int | None, places: int | None = None) -> str:
    """``1.234,5``; an empty text for None."""
    if x is None:
        return ""
    s = f"{x:,.{places}f}" if places is not None else (f"{x:,}" if isinstance(x, int) else f"{x:,.4f}".rstrip("0").rstrip("."))
    return s.translate(str.maketrans(",.", ".,"))


def to_markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown with numbers to the right. More than ``most`` rows are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    number = ("int", "bigint", "double", "float", "decimal")
    right = [kind.startswith(number) for _, kind in df.dtypes]
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "|".join("---:" if r else "---" for r in right) + "|"]
    for row in rows:
        cells = [spanish_number(float(v) if not isinstance(v, int) else v) if r and v is not None else "" if v is None else str(v).replace("|", "\\|") for v, r in zip(row, right)]
        lines.append("| " + " | ".join(cells) + " |")
    return "\n".join(lines) + "\n"
