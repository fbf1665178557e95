"""Registered connectors: a source of descriptors and items behind one protocol, read through Spark's data source interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_REGISTRY: dict[str, Callable[[dict], "Connector"]] = {}


class Connector:
    """What a kind of source implements. ``pages`` says how many pages a listing has, ``fetch_page`` gives the items of one.

    An item is (external_ref, title, markdown, url, author, modified as text).
    """

    def configured(self) -> str | None:
        """None, or what is missing."""
        return None

    def pages(self) -> int:
        raise NotImplementedError

    def fetch_page(self, page: int) -> Iterator[tuple]:
        raise NotImplementedError


def register(spark: SparkSession, kind: str, factory: Callable[[dict], Connector]) -> None:
    """Makes ``spark.read.format(kind).load()`` read a connector; the factory gets the reader's options.

    Spark plans and reads such a source in other processes, so the class
    carries its factory with it.
    """

    class Source(ConnectorSource):
        make = staticmethod(factory)

        @classmethod
        def name(cls) -> str:
            return kind

    _REGISTRY[kind] = factory
    spark.dataSource.register(Source)


def registered() -> list[str]:
    return sorted(_REGISTRY)


class ConnectorSource(DataSource):
    """One partition for each page of a connector's listing; a connector that isn't configured is an error."""

    make: Callable[[dict], Connector]

    def schema(self) -> str:
        return "external_ref string, title string, markdown string, url string, author string, modified string"

    def reader(self, schema) -> DataSourceReader:
        connector = self.make(dict(self.options))
        if missing := connector.configured():
            raise ValueError(f"the connector {self.name()!r} isn't configured: {missing}")
        return ConnectorReader(connector)


class ConnectorReader(DataSourceReader):
    def __init__(self, connector: Connector):
        self.connector = connector

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.connector.pages())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.connector.fetch_page(partition.value)
