"""JSON records of many small files, listed by prefix, as a batch and as a stream.

A prefix is a folder below the root.  Its files, in order of names, are dealt to
tasks in pages; a cursor passes over all names up to it.  As a stream, the offset
is the last name taken of each prefix, so names must rise, as those that begin with a time do.

A file holds one record or a list of them.  A file that cannot be read is tried
at each fallback root; if none has it whole, it gives one row with the ``error``
and no record, so nothing is lost without a trace.  Records are JSON text, for
``from_json`` with the reader's schema.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "prefix string, file string, origin string, place int, record string, error string"


class Page(InputPartition):
    def __init__(self, prefix: str, files: list[str]):
        self.prefix, self.files = prefix, files


class _Folder:
    """The files below the roots, through Arrow's file systems."""

    def __init__(self, options: dict):
        self.roots = [r.rstrip("/") for r in (options["path"], *filter(None, options.get("fallback", "").split(",")))]
        self.prefixes = [p for p in options.get("prefixes", "").split(",") if p]
        self.page = int(options.get("page", 100))
        self.cursor = options.get("cursor", "")

    @staticmethod
    def _open(root: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)

    def _listed(self, root: str, prefix: str) -> set[str]:
        from pyarrow import fs

        system, base = self._open(root)
        found = system.get_file_info(fs.FileSelector(f"{base}/{prefix}", allow_not_found=True))
        return {f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(".json") and f.base_name[0] not in "._"}

    def names(self, prefix: str) -> list[str]:
        return sorted(set().union(*(self._listed(r, prefix) for r in self.roots)))

    def pages(self, bounds: dict[str, tuple[str, str | None]]) -> list[Page]:
        """Pages of each prefix's names after one and up to another."""
        out = []
        for prefix, (after, upto) in bounds.items():
            names = [n for n in self.names(prefix) if n > after and (upto is None or n <= upto)]
            out += [Page(prefix, names[i : i + self.page]) for i in range(0, len(names), self.page)]
        return out

    def records(self, page: Page) -> Iterator[tuple]:
        for name in page.files:
            trouble = ""
            for root in self.roots:
                try:
                    system, base = self._open(root)
                    with system.open_input_stream(f"{base}/{page.prefix}/{name}") as f:
                        found = json.loads(f.read())
                    rows = found if isinstance(found, list) else [found]
                    yield from [(page.prefix, name, root, k, json.dumps(r, ensure_ascii=False), None) for k, r in enumerate(rows)]
                    break
                except (OSError, ValueError) as e:
                    trouble = trouble or f"{type(e).__name__}: {str(e)[:200]}"
            else:
                yield (page.prefix, name, None, None, None, trouble)


class _Reader(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self):
        return self.folder.pages({p: (self.folder.cursor, None) for p in self.folder.prefixes}) or [Page("", [])]

    def read(self, partition):
        yield from self.folder.records(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {p: self.folder.cursor for p in self.folder.prefixes}

    def latestOffset(self) -> dict:
        return {p: max([self.folder.cursor, *self.folder.names(p)]) for p in self.folder.prefixes}

    def partitions(self, start: dict, end: dict):
        return self.folder.pages({p: (start.get(p, self.folder.cursor), end[p]) for p in end}) or [Page("", [])]

    def read(self, partition):
        yield from self.folder.records(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedJson(DataSource):
    """``spark.read.format("paged_json")`` with options path, prefixes, and optionally fallback, page and cursor."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Folder(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Folder(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
