"""Readers of raw files with declared schemas."""

from __future__ import annotations

import hashlib
import os
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.functions import casts, text

CASTS = {
    "text": text.cleaned, "date": casts.to_date, "date8": casts.to_date8, "timestamp": casts.to_timestamp, "decimal": casts.to_decimal, "long": casts.to_long, "boolean": casts.to_boolean,
}


@dataclass(frozen=True)
class Dataset:
    """A raw dataset: for each column its name in the file and how its text is read; and its business key.

    Everything is read as text and cast afterwards, so one bad value never costs a row.
    """

    columns: dict[str, tuple[str, str]]
    keys: tuple[str, ...] = ()

    def schema(self) -> T.StructType:
        names = dict.fromkeys(source for source, _ in self.columns.values())
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def projection(self) -> list[Column]:
        return [CASTS[kind](F.col(f"`{source}`")).alias(name) for name, (source, kind) in self.columns.items()]


def read_ndjson(spark: SparkSession, paths: str | list[str], dataset: Dataset) -> DataFrame:
    """One JSON object a line; only declared columns are parsed, malformed lines are left out."""
    return spark.read.schema(dataset.schema()).option("mode", "DROPMALFORMED").json(paths).select(*dataset.projection())


def read_json_array(spark: SparkSession, paths: str | list[str], dataset: Dataset) -> DataFrame:
    """Files that hold one array of objects."""
    return spark.read.schema(dataset.schema()).option("multiLine", True).option("mode", "DROPMALFORMED").json(paths).select(*dataset.projection())


def is_parquet(path: str) -> bool:
    """Whether a local file has both marks of a whole Parquet file."""
    try:
        if os.path.getsize(path) < 12:
            return False
        with open(path, "rb") as f:
            head = f.read(4)
            f.seek(-4, os.SEEK_END)
            return head == f.read(4) == b"PAR1"
    except OSError:
        return False


def read_parquets(spark: SparkSession, paths: Iterable[str], local: bool = False) -> DataFrame:
    """Parquet files by column name; with ``local``, truncated files are left out first."""
    files = [p for p in paths if not local or is_parquet(p)]
    if not files:
        raise FileNotFoundError("no readable Parquet file")
    return spark.read.option("mergeSchema", True).parquet(*files)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with a header and inferred types, by the file's ending."""
    if path.endswith(".parquet") or os.path.isdir(path):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, inferSchema=True)


def first_files(paths: Iterable[str], n: int | None) -> list[str]:
    """The first files of a listing, for trial runs that are asked for as such."""
    return sorted(paths)[:n]


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def days(spark: SparkSession, first: str, after: str) -> DataFrame:
    """Every day from ``first`` up to but not including ``after``."""
    span = spark.range(1).select(F.sequence(F.lit(first).cast("date"), F.date_sub(F.lit(after).cast("date"), 1), F.expr("interval 1 day")).alias("d"))
    return span.select(F.explode("d").alias("fecha"))


def restore(archives: Iterable[str], folder: str, digests: dict[str, str]) -> list[str]:
    """Unpacks archives into ``folder`` and checks each file's SHA-256; files already there and right are kept.

    Members that would leave the folder are refused, as are files whose digest differs.
    """
    done = []
    root = os.path.realpath(folder)
    for archive in archives:
        with zipfile.ZipFile(archive) as z:
            for member in z.infolist():
                target = os.path.realpath(os.path.join(root, member.filename))
                if not target.startswith(root + os.sep):
                    raise ValueError(f"{member.filename} leaves the folder")
                if member.is_dir():
                    continue
                if not (os.path.exists(target) and _sha256(target) == digests.get(member.filename)):
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with z.open(member) as source, open(target + ".part", "wb") as out:
                        while block := source.read(1 << 20):
                            out.write(block)
                    if member.filename in digests and _sha256(target + ".part") != digests[member.filename]:
                        os.remove(target + ".part")
                        raise ValueError(f"{member.filename}: wrong digest")
                    os.replace(target + ".part", target)
                done.append(target)
    return done


def _sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()
