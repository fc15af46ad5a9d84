"""Registry of runnable queries with their check SQL and the inventory rows they cover."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weftline.session import spread


class Tables:
    """Lazy access to the parquet tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table) if name == "documents" else table


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable:
    """Register ``build(tables) -> DataFrame`` under ``name``."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, tuple(covers.split()), build, sql)
        return build

    return add


def load_all() -> dict[str, Query]:
    import importlib.util

    for part in (
        "manifests", "filtering", "texts", "tokenising", "joining", "scoring",
        "conversing", "statistics", "ordering", "splitting", "shaping", "streams",
    ):
        if importlib.util.find_spec(f"weftline.plans.{part}"):
            importlib.import_module(f"weftline.plans.{part}")
    return QUERIES
