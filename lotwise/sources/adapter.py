"""A way to add a source of listings: a Spark data source whose partitions are the pages of a portal's capture.

Read as a batch it gives all pages there are; read as a stream it goes on where its checkpoint stands, page by page, and
pages that come later are read when they are there. Filters on columns that a portal can search by are pushed into it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual


class PageReader(DataSourceReader):
    """Reads every page in a task of its own, so that a lost one is read again alone."""

    def __init__(self, source: ListingSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(page) for page in self.source.pages()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.source.listings(partition.value)


class SearchingReader(PageReader):
    """Reads what the source finds by the filters that it can search by; Spark keeps the others."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the filters on searched columns and gives the others back."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual)) and len(f.attribute) == 1 else None
            if column in self.source.SEARCHED:
                kind = "=" if isinstance(f, EqualTo) else ">=" if isinstance(f, GreaterThanOrEqual) else "<="
                self.source.search.append((column, kind, f.value))
            else:
                yield f


class PageStream(DataSourceStreamReader):
    """Pages by their place in the capture, which only grows at its end. At most `pages_per_batch` of them make a batch."""

    def __init__(self, source: ListingSource):
        self.source = source
        self.most = int(source.options.get("pages_per_batch", "0"))
        self.planned = 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        there = len(self.source.pages())
        self.planned = min(there, self.planned + self.most) if self.most else there
        return {"page": self.planned}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.planned = max(self.planned, end["page"])
        return [InputPartition(page) for page in self.source.pages()[start["page"] : end["page"]]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.source.listings(partition.value)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: pages stay in the capture."""


class ListingSource(DataSource):
    """Subclasses give their `name`, FIELDS, the `pages` that there are by the options, and the `listings` of a page.

    Registered with spark.dataSource.register(), they are read by spark.read.format(name) or spark.readStream.format(name).
    A source that can search names the columns in SEARCHED; pages() and listings() then find (column, comparison, value) in
    `search` and must obey all of it. Such a source needs spark.sql.python.filterPushdown.enabled.
    """

    FIELDS = ""
    SEARCHED: frozenset[str] = frozenset()

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.search: list[tuple[str, str, object]] = []

    def pages(self) -> list:
        raise NotImplementedError

    def listings(self, page) -> Iterator[tuple]:
        raise NotImplementedError

    def schema(self) -> str:
        return self.FIELDS

    def reader(self, schema) -> DataSourceReader:
        return SearchingReader(self) if self.SEARCHED else PageReader(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(self)
