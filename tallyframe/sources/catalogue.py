"""Model catalogues as a data source: spark.read.format("model_catalogue").option("url", ...).load().

Each address is a partition, which a task fetches once; options can't carry functions, so the way to
fetch is bound to the source's class when it is registered.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from .runlog import fetch

NAME = "model_catalogue"
SCHEMA = "catalogue string, name string, displayName string, supportedGenerationMethods array<string>"


class Address(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class CatalogueReader(DataSourceReader):
    """Rows of the models that each address lists, in the list's order; missing fields are null, and a reply without models has none."""

    def __init__(self, urls: Sequence[str], get: Callable[[str], str]) -> None:
        self.urls, self.get = list(urls), get

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Addresses that a query doesn't ask for aren't fetched."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("catalogue",):
                self.urls = [u for u in self.urls if u == f.value]
            else:
                yield f

    def partitions(self) -> list[Address]:
        return [Address(u) for u in self.urls]

    def read(self, partition: Address) -> Iterator[tuple]:
        for model in json.loads(self.get(partition.url)).get("models") or []:
            yield partition.url, model.get("name"), model.get("displayName"), model.get("supportedGenerationMethods")


def catalogue_source(get: Callable[[str], str] = fetch, name: str = NAME) -> type[DataSource]:
    """The data source's class, fetching by a function that is sent to tasks. Option url: addresses, one in each line."""

    class Catalogue(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: object) -> CatalogueReader:
            urls = [u for u in self.options.get("url", "").splitlines() if u]
            if not urls:
                raise ValueError("option url names no address")
            return CatalogueReader(urls, get)

    return Catalogue


def register(spark: SparkSession, get: Callable[[str], str] = fetch, name: str = NAME) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(catalogue_source(get, name))
    # Filters reach a Python source only where the session lets them.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
