"""A Python iterator as a source: spark.read.format("iterated") with a factory that yields the rows of each partition."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Part(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class IteratedReader(DataSourceReader):
    def __init__(self, factory: str, parts: int) -> None:
        self.factory, self.parts = factory, parts

    def partitions(self) -> list[Part]:
        return [Part(i) for i in range(self.parts)]

    def read(self, partition: Part) -> Iterator[tuple]:
        module, _, name = self.factory.partition(":")
        yield from getattr(importlib.import_module(module), name)(partition.number, self.parts)


class Iterated(DataSource):
    """Options: factory ("module:function", called with a partition's number and how many there are; it yields tuples of the given
    schema), partitions (1). The factory must give the same rows for a number each time, so that a lost partition can be read again."""

    @classmethod
    def name(cls) -> str:
        return "iterated"

    def schema(self) -> str:
        raise ValueError("give the rows' schema with .schema()")

    def reader(self, schema: object) -> IteratedReader:
        return IteratedReader(self.options["factory"], int(self.options.get("partitions", "1")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Iterated)
