"""``spark.read.format("tesserae").load(root)``: an array as a table of cells, for SQL.

The options ``origin`` and ``extent`` (numbers by comma) name a region, and only its chunks are read. Filters are not
pushed into the scan: Spark keeps what a Python source has planned with its table, so the pruned chunks of one query
on a view would be those of the next. A partition is a run of chunks; each task reads its own objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesserae.errors import NodeNotFound
from tesserae.functions.geometry import chunk_key, index_columns
from tesserae.functions.strict_json import loads
from tesserae.plans import selection as S
from tesserae.plans.descriptor import ArrayDescriptor, parse_v2, parse_v3
from tesserae.sources.arrays import gathered, opened
from tesserae.sources.files import open_object

#: Chunks of a partition at least, and partitions at most.
CHUNKS, PARTITIONS = 16, 100_000


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CellSource)


class CellSource(DataSource):
    """Options: ``path`` of the store, ``node`` inside it, ``origin`` and ``extent`` of a region."""

    @classmethod
    def name(cls) -> str:
        return "tesserae"

    def _folder(self) -> str:
        root = self.options["path"].rstrip("/")
        node = self.options.get("node", "")
        return f"{root}/{node}" if node else root

    def _descriptor(self) -> ArrayDescriptor:
        get = lambda name: _read(f"{self._folder()}/{name}")
        if (raw := get("zarr.json")) is not None:
            return parse_v3(loads(raw))
        if (raw := get(".zarray")) is not None:
            attributes = get(".zattrs")
            return parse_v2(loads(raw), loads(attributes) if attributes else None)
        raise NodeNotFound(f"no array at {self._folder()}")

    def schema(self) -> str:
        d = self._descriptor()
        return ", ".join([*(f"{c} bigint" for c in index_columns(d.rank)), f"v {d.dtype.spark}"])

    def reader(self, schema) -> CellReader:
        d = self._descriptor()
        numbers = lambda name, default: [int(x) for x in self.options[name].split(",")] if name in self.options else default
        origin = numbers("origin", [0] * d.rank)
        extent = numbers("extent", [n - o for n, o in zip(d.shape, origin)])
        return CellReader(self._folder(), d, S.region(d.shape, origin, extent))


class CellReader(DataSourceReader):
    def __init__(self, folder: str, d: ArrayDescriptor, axes: tuple[S.Axis, ...]):
        self.folder, self.d, self.axes = folder, d, axes

    def _grid(self) -> tuple[list[int], list[int]]:
        axes = self.axes
        if any(a.length == 0 for a in axes):
            return [0] * len(axes), [0] * len(axes)
        bounds = [a.bounds(c) for a, c in zip(axes, self.d.chunks)]
        return [b[0] for b in bounds], [b[1] - b[0] + 1 for b in bounds]

    def partitions(self) -> list[InputPartition]:
        total = prod(self._grid()[1])
        step = max(CHUNKS, -(-total // PARTITIONS))
        return [InputPartition((at, min(total, at + step))) for at in range(0, total, step)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        d, axes = self.d, self.axes
        low, counts = self._grid()
        chunks = ([int(c) + a for c, a in zip(np.unravel_index(nth, counts), low)] if counts else [] for nth in range(*partition.value))
        yield from gathered(d, (part for c in chunks for part in opened(d, c, f"{self.folder}/{chunk_key(c, d.encoding, d.separator)}", axes)), axes, False)


def _read(uri: str) -> bytes | None:
    if (f := open_object(uri)) is None:
        return None
    with f:
        return f.read()
