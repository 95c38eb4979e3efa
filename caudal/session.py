"""Session construction and the shared folder in which iterative jobs cut their lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | None = None, app: str = "caudal", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    cores = cpus or os.cpu_count() or 4
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.parquet.aggregatePushdown": "true",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    session = builder.config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master may fall back to its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="caudal-")
    spark.conf.set("spark.checkpoint.dir", folder)
    _delete_at_exit(spark, folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    def gone() -> None:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:
            pass

    atexit.register(gone)


class Stages:
    """Intermediate tables written to the shared folder.

    ``cut`` writes a frame as Parquet and reads it back: the new frame has no lineage, so a lost executor costs
    a re-read and not a re-computation of earlier rounds, and its size is known to the optimiser. The shuffle files
    of a write are deleted as soon as it is done; otherwise they would stay until the driver collects its garbage.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._made: dict[str, str] = {}
        self._turn = 0
        _delete_at_exit(spark, self.root)

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        self._turn += 1
        path = f"{self.root}/{tag}-{self._turn}"
        self._write(df, path)
        old = self._made.get(tag)
        self._made[tag] = path
        if old:
            _delete(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def gather(self, frames: Iterable[DataFrame], tag: str) -> DataFrame:
        """All rows of ``frames`` (one at least), each written before the next one is asked for."""
        self._turn += 1
        path = f"{self.root}/{tag}-{self._turn}"
        schema = None
        for df in frames:
            self._write(df, path)
            schema = schema or df.schema
        self._made[tag] = path
        return self.spark.read.schema(schema).parquet(path)

    def _write(self, df: DataFrame, path: str) -> None:
        before = self.spark.conf.get(_FREE_SHUFFLES, None)
        self.spark.conf.set(_FREE_SHUFFLES, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_FREE_SHUFFLES)
            else:
                self.spark.conf.set(_FREE_SHUFFLES, before)

    def drop(self, *tags: str) -> None:
        for tag in tags:
            path = self._made.pop(tag, None)
            if path:
                _delete(self.spark, path)

    def keep(self, *tags: str) -> None:
        """Drops all other tables."""
        self.drop(*[tag for tag in self._made if tag not in tags])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
