"""A Spark data source of pages, over whatever library can open the files.

``spark.dataSource.register(page_source(backend))`` and ``spark.read.format("page_content").option("paths", "a.pdf,b.pdf").load()``. A
partition is a run of pages of a file, which opens the file once. Filters on path and page_number are pushed down (with
spark.sql.python.filterPushdown.enabled): runs outside of them are never planned, and pages outside never asked of the backend.
Load it anew for each query: Spark 4.1 keeps what was pushed once with the loaded frame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .. import config as C
from ..shared import arrow_store
from .pages import ARROW_PAGE, PAGE, pages_of

_TESTS: dict[type, Callable] = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}


@dataclass
class Run(InputPartition):
    """Pages first to last of a file; the last run of a file has no end."""

    path: str
    first: int
    last: int | None


class PageReader(DataSourceReader):
    def __init__(self, backend, options: dict):
        self.backend, self.tests = backend, {"path": [], "page_number": []}
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.length, self.most = int(options.get("run_pages", "50")), int(options.get("max_pages", str(C.MAX_PAGES)))

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if type(f) in _TESTS and column in self.tests:
                self.tests[column].append((type(f), f.value))
            else:
                yield f

    def passes(self, column: str, value) -> bool:
        return all(_TESTS[kind](value, v) for kind, v in self.tests[column])

    def partitions(self):
        """Files are not opened here: runs go up to the most pages that a file may have, and a run that a file doesn't have is empty."""
        out = []
        for path in self.paths:
            if self.passes("path", path):
                firsts = range(1, self.most + 1, self.length)
                for first in firsts:
                    last = None if first == firsts[-1] else first + self.length - 1
                    # An open end may hold any page from its first on.
                    if any(self.passes("page_number", n) for n in range(first, (last or first + self.length - 1) + 1)) or (last is None and self._beyond(first)):
                        out.append(Run(path, first, last))
        return out

    def _beyond(self, first: int) -> bool:
        """Whether a page past the last run's length may pass."""
        named = [v if kind is In else (v,) for kind, v in self.tests["page_number"] if kind in (EqualTo, In)]
        return any(n >= first and self.passes("page_number", n) for vs in named for n in vs) if named else not any(kind in (LessThan, LessThanOrEqual) and v < first for kind, v in self.tests["page_number"])

    def read(self, partition: Run | None):
        import pyarrow as pa

        if partition is None:  # no run was planned
            return
        store, name = arrow_store(partition.path)
        with store.open_input_stream(name) as f:
            content = f.read()
        backend, reader = self.backend, self

        class Within:
            """The pages of a document that lie in the run and pass the filters."""

            def open(self, data):
                self.document = backend.open(data)
                return self

            def pages(self):
                return [n for n in self.document.pages() if partition.first <= n and (partition.last is None or n <= partition.last) and reader.passes("page_number", n)]

            def __getattr__(self, name):
                return getattr(self.document, name)

        got = [{"path": partition.path, **page} for page in pages_of(Within(), content, None)]
        if got:
            yield pa.RecordBatch.from_pylist(got, pa.schema([("path", pa.string()), *ARROW_PAGE]))


def page_source(backend, name: str = "page_content") -> type[DataSource]:
    """The data source of pages that backend opens, see ``sources.pages``: rows of path and PAGE."""

    class PageContent(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return f"path string, {PAGE}"

        def reader(self, schema):
            return PageReader(backend, self.options)

    return PageContent
