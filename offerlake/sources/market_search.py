"""A Spark data source named market_search: the direct search pages of given queries, as candidates.

    spark.dataSource.register(MarketSearchSource)
    spark.read.format("market_search").option("queries", "tict ice cube|shimano stella").load()
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .providers import CATALOG, DIRECT


class _Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


class _Reader(DataSourceReader):
    def __init__(self, queries: list[str]):
        self.queries = queries

    def partitions(self):
        return [_Query(q) for q in self.queries]

    def read(self, partition):
        for rank, (ident, label, kind, _, _, _) in enumerate(CATALOG[:19], 1):
            yield partition.query, f"{label} search: {partition.query}", f"{DIRECT}:{ident}", kind, rank


class MarketSearchSource(DataSource):
    @classmethod
    def name(cls):
        return "market_search"

    def schema(self):
        return "query string, title string, sourceProvider string, kind string, rank int"

    def reader(self, schema):
        return _Reader([q for q in self.options.get("queries", "").split("|") if q])
