"""Python data sources over files of pages and of deliveries.

Files are opened through Arrow's file systems, which know the common stores by the scheme of the path.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from datetime import datetime

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _text(path: str) -> str:
    """A file, or the only file with content of a folder that Spark wrote."""
    store, p = _at(path)
    if store.get_file_info(p).type == fs.FileType.Directory:
        p = next(f.path for f in sorted(store.get_file_info(fs.FileSelector(p)), key=lambda f: f.path) if f.is_file and f.base_name[0] not in "._")
    with store.open_input_stream(p) as f:
        return f.read().decode()


# -- pages ---------------------------------------------------------------------------------------------------------------


class _Page(InputPartition):
    def __init__(self, name: str, take: int):
        super().__init__(name)
        self.name, self.take = name, take


#: What a pushed filter asks of a value; a null value passes none of them.
_TESTS = {
    EqualTo: lambda v, f: v == f.value, In: lambda v, f: v in f.value, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value, IsNotNull: lambda v, f: True,
}


class _PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options, self.filters = [f.name for f in schema.fields], options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """A partition for each page, found by its link in the one before, up to the cap; of a page only its name is kept."""
        left, name, seen, out = int(self.options.get("most", 1 << 62)), self.options["first"], set(), []
        while name and left > 0:
            if name in seen:
                raise ValueError(f"the pages go round in a circle at {name}")
            seen.add(name)
            page = json.loads(_text(f"{self.options['path']}/{name}"))
            out.append(_Page(name, left))
            left -= len(page["items"])
            name = page.get("next")
        return out or [_Page("", 0)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        if not partition.name:
            return
        for item in json.loads(_text(f"{self.options['path']}/{partition.name}"))["items"][: partition.take]:
            if all((v := item.get(f.attribute[0])) is not None and _TESTS[type(f)](v, f) for f in self.filters):
                yield tuple(item.get(c) for c in self.columns)


class PageFiles(DataSource):
    """A listing in pages ``{"items": [...], "next": name}`` under a folder.

    Options: ``path``, ``first`` (the first page's name), ``most`` (the cap of items, which counts before filters).  The
    columns are those of the given schema, by the items' fields.
    """

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PageReader(schema, dict(self.options))


# -- deliveries ----------------------------------------------------------------------------------------------------------


class _Log(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _DeliveryReader(DataSourceStreamReader):
    """The offset is the name of the last log that was read; logs have rising names."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def _names(self) -> list[str]:
        store, p = _at(self.path)
        return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(p)) if f.is_file and f.base_name[0] not in "._")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Log(n) for n in self._names() if start["after"] < n <= end["after"]]

    def read(self, partition: _Log) -> Iterator[tuple]:
        for line in _text(f"{self.path}/{partition.name}").splitlines():
            if line:
                d = json.loads(line)
                yield d["delivery"], d["event"], datetime.fromisoformat(d["sent"]), d.get("signature"), base64.b64decode(d["body"])


class Deliveries(DataSource):
    """Webhook deliveries as a stream, from logs of JSON lines under ``path`` (``body`` in base64, ``sent`` in ISO 8601)."""

    @classmethod
    def name(cls) -> str:
        return "deliveries"

    def schema(self) -> str:
        return "delivery string, event string, sent timestamp, signature string, body binary"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _DeliveryReader(dict(self.options))
