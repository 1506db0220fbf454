"""Plug-in points: external sources as Spark data sources, enrichers as functions
from DataFrame to DataFrame, and slots for models that are injected."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, int], Iterable[tuple]]


def register_connector(spark: SparkSession, name: str, schema: str, fetch: Fetch, partitions: int = 1) -> None:
    """Makes ``spark.read.format(name).option("request", ..)`` call ``fetch(request, part)``
    on the executors, once for each part."""
    format_name, columns, parts = name, schema, partitions

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            return [InputPartition(i) for i in range(parts)]

        def read(self, partition):
            yield from fetch(self.options.get("request", ""), partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return format_name

        def schema(self):
            return columns

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Source)


class Enrichers:
    """Named functions applied in order of registration."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, f: Callable[[DataFrame], DataFrame]) -> None:
        if name in self.known:
            raise ValueError(f"{name} is registered already")
        self.known[name] = f

    def apply(self, df: DataFrame) -> DataFrame:
        for f in self.known.values():
            df = f(df)
        return df


class Tiers:
    """Extractor tiers (pattern, classifier, model): each sees what earlier ones
    found, and only memories they left without items. A tier is a function
    (memories, found so far or None) -> rows memory_id, extractor, target, surface."""

    def __init__(self, *tiers: Callable[[DataFrame, DataFrame | None], DataFrame]):
        self.tiers = tiers

    def run(self, memories: DataFrame) -> DataFrame:
        found = None
        for tier in self.tiers:
            todo = memories if found is None else memories.join(found.select("memory_id").distinct(), "memory_id", "left_anti")
            new = tier(todo, found)
            found = new if found is None else found.unionByName(new)
        if found is None:
            raise ValueError("no tier is given")
        return found
