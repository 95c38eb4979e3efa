"""Tables of a folder and views built from them."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Paths:
    """Folders of a project; a recalculated result comes before a published one."""

    root: str = field(default_factory=lambda: os.environ.get("CAUDAL_ROOT", "."))
    published: str = "published"
    results: str = "results"

    def result(self, name: str) -> str:
        for folder in (self.results, self.published):
            path = os.path.join(self.root, folder, name)
            if os.path.exists(path):
                return path
        raise FileNotFoundError(name)


def mount(spark: SparkSession, folder: str, only: list[str] | None = None) -> list[str]:
    """A temporary view for each table of a folder; an error when there is none, or one asked for is missing."""
    there = sorted({n.removesuffix(".parquet") for n in os.listdir(folder) if n.endswith(".parquet") or os.path.isdir(os.path.join(folder, n))})
    names = only if only is not None else there
    missing = [n for n in names if n not in there]
    if missing or not names:
        raise FileNotFoundError(", ".join(missing) or folder)
    for n in names:
        path = os.path.join(folder, f"{n}.parquet")
        spark.read.parquet(path if os.path.exists(path) else os.path.join(folder, n)).createOrReplaceTempView(n)
    return names


class Views:
    """Builders of views with the tables they need; built once, in order of need."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._builders: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}

    def add(self, name: str, needs: tuple[str, ...], build: Callable[..., DataFrame]) -> None:
        self._builders[name] = (needs, build)

    def get(self, name: str, _open: tuple[str, ...] = ()) -> DataFrame:
        if name in _open:
            raise ValueError("views need each other: " + " > ".join((*_open, name)))
        if self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        if name not in self._builders:
            raise KeyError(name)
        needs, build = self._builders[name]
        df = build(*[self.get(n, (*_open, name)) for n in needs])
        df.createOrReplaceTempView(name)
        return df

    def ready(self) -> dict[str, bool]:
        """Whether each view's needs can be met."""

        def can(name: str, seen: frozenset[str] = frozenset()) -> bool:
            if self.spark.catalog.tableExists(name):
                return True
            return name in self._builders and name not in seen and all(can(n, seen | {name}) for n in self._builders[name][0])

        return {n: can(n) for n in self._builders}
