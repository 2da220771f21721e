"""Page images as a data source: one partition per range of pages.

No PDF library comes with the engine: a renderer is given by import path (``module:function``) and is
called in the tasks as ``renderer(path, page_index, dpi) -> bytes``; ``page_count(path)`` likewise.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from folio.sources.files import MAX_IMAGE_BYTES


def _named(path: str):
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


class _Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.dpi = options["path"], int(options.get("dpi", "240"))
        self.renderer, self.counter = options["renderer"], options["page_count"]
        self.step = int(options.get("pages_per_partition", "16"))

    def partitions(self) -> list[InputPartition]:
        count = _named(self.counter)(self.path)
        return [_Pages(a, min(a + self.step, count)) for a in range(0, count, self.step)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        render = _named(self.renderer)
        for page in range(partition.first, partition.last):
            try:
                content, error = bytes(render(self.path, page, self.dpi)), None
                if len(content) > MAX_IMAGE_BYTES:
                    content, error = None, "page-image-too-large"
            except Exception:  # noqa: BLE001  a page that fails is a row, not the end of the scan
                content, error = None, "page-render-failed"
            yield page, self.dpi, content, error


class PageImages(DataSource):
    """spark.dataSource.register(PageImages); spark.read.format("page_images").options(...).load(path)."""

    @classmethod
    def name(cls) -> str:
        return "page_images"

    def schema(self) -> StructType | str:
        return "page_index int, dpi int, content binary, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))
