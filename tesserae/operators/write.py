"""Creating arrays and groups.

Cells are brought together by chunk (or shard) with one shuffle and a sort, encoded from Arrow batches and written by the tasks
into a staging folder beside the target. The driver publishes the primary metadata last and then moves the folder in one
step, so a failed write leaves nothing at the target. Nothing is ever overwritten.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.errors import CodecError, DTypeMismatch, NodeExists, ResourceLimit
from tesserae.functions import codecs as C
from tesserae.functions.geometry import chunk_columns, chunk_key, index_columns
from tesserae.plans.descriptor import ArrayDescriptor, render_group, render_v2, render_v3
from tesserae.plans.shards import assemble, shard_slices
from tesserae.sources import files
from tesserae.sources.arrays import Array, open_array
from tesserae.sources.objects import Store, settled

#: Objects of one write, at most, and cells of small chunks that are encoded together.
MAX_OBJECTS, RUN_CELLS = 1_000_000_000, 1 << 14
#: Cells of a stretch of small chunks that come to one task together, at most, and such stretches of a wide grid, about, at least.
NEAR_CELLS, SPREAD = 1 << 20, 1 << 10
WRITTEN = "key string, length long, sha256 string, chunks long"


@dataclass(frozen=True)
class WriteReceipt:
    """What a write created: ``objects (key, length, sha256, chunks)`` as a DataFrame, and its sums."""

    objects: DataFrame
    documents: tuple[str, ...]
    n_objects: int
    n_bytes: int
    encoded_chunks: int
    omitted_chunks: int


def encoded(cells: DataFrame, d: ArrayDescriptor) -> DataFrame:
    """``cells (i0.., v)`` to ``(c0.., payload, chunks)``: an object for each chunk (or shard) that has a cell.

    Cells that a chunk lacks are fill; a chunk without cells has no row. Cells outside the shape, repeated coordinates
    and values outside the type are errors.

    Neighbouring chunks come to one task, sorted; small ones are encoded many at a time, and of a large one only its block is held.
    """
    d = d.checked()
    coords = [f"c{k}" for k in range(d.rank)]
    schema = ", ".join([*(f"{c} long" for c in coords), "payload binary", "chunks long"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, payloads, chunks in _payloads(batches, d):
            yield pa.RecordBatch.from_arrays([*map(pa.array, at.T), pa.array(payloads, pa.binary()), pa.array(chunks, pa.int64())], names=[*coords, "payload", "chunks"])

    return _sorted(cells, d).mapInArrow(encode, schema)


def _run(d: ArrayDescriptor) -> int:
    return max(1, RUN_CELLS // max(1, prod(d.chunks)))


def _sorted(cells: DataFrame, d: ArrayDescriptor) -> DataFrame:
    """The cells with their chunks, in which a chunk's are together and neighbouring chunks in one task."""
    coords = [f"c{k}" for k in range(d.rank)]
    rows = cells.select(*index_columns(d.rank), F.col("v").cast(d.dtype.spark).alias("v"), *chunk_columns(d.chunks))
    if not d.rank:
        return rows.coalesce(1)
    # A wide sparse array has few objects in a run of its grid, so there a task takes longer stretches of a folder.
    grid = prod(-(-s // n) for s, n in zip(d.shape, d.chunks))
    near = F.xxhash64(*coords[:-1], F.expr(f"{coords[-1]} div {max(_run(d), min(NEAR_CELLS // max(1, prod(d.chunks)), grid // SPREAD))}"))
    # Tasks walk through their runs in different orders, so they do not all create objects in the same folder.
    return rows.withColumn("near", near).repartition("near").sortWithinPartitions("near", *coords).drop("near")


def _payloads(batches: Iterator[pa.RecordBatch], d: ArrayDescriptor) -> Iterator[tuple[np.ndarray, list[bytes], list[int]]]:
    """(chunks, their objects, chunks of each) of runs."""
    for at, block, seen in _blocks(batches, d, _run(d)):
        out = [_payload(b, s, d) for b, s in zip(block, seen)]
        yield at, [p for p, _ in out], [n for _, n in out]


def _blocks(batches: Iterator[pa.RecordBatch], d: ArrayDescriptor, run: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, values, which of them are given) of runs of at most ``run`` chunks, from cells in which a chunk's are together."""
    rank, shape = d.rank, np.array(d.shape, np.int64)[:, None]
    names = [*(f"c{k}" for k in range(rank)), *(f"i{k}" for k in range(rank))]
    held = None  # the last chunk may go on in the next batch
    for batch in batches:
        if not len(batch):
            continue
        if any(batch.column(n).null_count for n in names):
            raise CodecError("cells without coordinates")
        at, index = (np.array([batch.column(f"{p}{k}").to_numpy() for k in range(rank)], np.int64).reshape(rank, len(batch)) for p in "ci")
        if ((index < 0) | (index >= shape)).any():
            raise CodecError(f"cells outside shape {list(d.shape)}")
        values = d.dtype.from_arrow(batch.column("v"))
        first = np.r_[0, np.flatnonzero((np.diff(at) != 0).any(0)) + 1]
        ends = np.r_[first[1:], len(batch)]
        for k in range(0, len(first), run):
            n, low, high = len(first[k : k + run]), first[k], ends[k : k + run][-1]
            own = at[:, first[k : k + run]].T
            if goes_on := held is not None and np.array_equal(held[0][0], own[0]):
                block, seen = held[1:]  # filled on, so that a large chunk is not copied with each batch
            elif held is not None:
                yield held
            if not goes_on or n > 1:
                more = n - goes_on
                fresh = np.full((more, *d.chunks), d.fill_value, d.dtype.numpy), np.zeros((more, *d.chunks), bool)
                block, seen = (np.concatenate(x) for x in zip((block, seen), fresh)) if goes_on else fresh
            local = (np.repeat(np.arange(n), (ends - first)[k : k + run]), *(index - at * np.array(d.chunks, np.int64)[:, None])[:, low:high])
            cell = np.ravel_multi_index(local, block.shape)
            again = seen[local]
            again[np.setdiff1d(np.arange(len(cell)), np.unique(cell, return_index=True)[1], True)] = True
            if again.any():
                raise CodecError(f"repeated coordinates in chunk {own[local[0][np.argmax(again)]].tolist()}")
            block[local], seen[local] = values[low:high], True
            if n > 1:
                yield own[:-1], block[:-1], seen[:-1]
            held = own[-1:], block[-1:], seen[-1:]
    if held is not None:
        yield held


def _payload(block: np.ndarray, seen: np.ndarray, d: ArrayDescriptor) -> tuple[bytes, int]:
    """The object of a chunk or shard, and how many chunks it has."""
    if d.sharding is None:
        return C.encode_chunk(block, d.codecs, d.dtype), 1
    parts: list[bytes | None] = []
    for _, low in shard_slices(d.sharding, d.chunks):
        box = tuple(slice(x, x + n) for x, n in zip(low, d.sharding.inner))
        parts.append(C.encode_chunk(block[box], d.sharding.codecs, d.dtype) if seen[box].any() else None)
    return C.encode_bytes(assemble(parts, d.sharding, d.chunks), d.codecs), sum(p is not None for p in parts)


def write_objects(objects: DataFrame, folder: str) -> DataFrame:
    """Write ``(key, payload, chunks)`` below a folder that executors share; returns ``(key, length, sha256, chunks)``.

    A repeated task leaves the same object: one that is there already, perhaps in part, is replaced in one step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        create = files.creator(folder)
        for batch in batches:
            yield _created(create, *(batch.column(n).to_pylist() for n in ("key", "payload", "chunks")))

    return objects.select("key", "payload", "chunks").mapInArrow(run, WRITTEN)


def write_cells(cells: DataFrame, d: ArrayDescriptor, folder: str) -> DataFrame:
    """``write_objects`` of what ``encoded`` makes of the cells, in the same tasks: payloads do not leave the process that encodes them."""
    d = d.checked()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        create = files.creator(folder)
        for at, payloads, chunks in _payloads(batches, d):
            yield _created(create, [chunk_key(c, d.encoding, d.separator) for c in at.tolist()], payloads, chunks)

    return _sorted(cells, d).mapInArrow(run, WRITTEN)


def _created(create: Callable[[str, bytes], None], keys: Sequence[str], payloads: Sequence[bytes], chunks: Sequence[int]) -> pa.RecordBatch:
    for key, payload in zip(keys, payloads):
        create(key, payload)
    length, sha256 = pa.array(map(len, payloads), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), length, sha256, pa.array(chunks, pa.int64())], names=["key", "length", "sha256", "chunks"])


def create_array(cells: DataFrame, root: str, d: ArrayDescriptor, path: str = "", max_objects: int = MAX_OBJECTS) -> WriteReceipt:
    """Write ``cells (i0.., v)`` as a new array; chunks without cells are left to the fill value.

    The target may not exist. Metadata are rendered first, so that a descriptor that cannot be written fails before
    any data; their primary document is written last. On failure the staging folder is removed.
    """
    d = d.checked()
    if d.zarr_format == 2 and d.encoding != "v2":
        d = replace(d, encoding="v2")
    documents = _documents(d)
    spark = cells.sparkSession
    store = Store(spark, root)
    if store.exists(path or "."):
        raise NodeExists(f"{path or root} exists")
    if cells.schema["v"].dataType.typeName() == "null":
        raise DTypeMismatch("cells have no values")
    target = f"{store.root}/{path}" if path else store.root
    parent, name = target.rsplit("/", 1)
    folder = f"{parent}/.staging-{name}-{uuid.uuid4().hex}"
    staging = Store(spark, folder)
    try:
        written = settled(write_cells(cells, d, _uri(folder)))
        n, size, chunks = written.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.sum("chunks"), F.lit(0))).first()
        if n + len(documents) > max_objects:
            raise ResourceLimit("written objects", max_objects, n + len(documents))
        for key, text in documents:
            staging.create(key, text.encode())
        if store.exists(path or ".") or not store.fs.rename(staging.path(""), store.path(path)):
            raise NodeExists(f"{path or root} exists")
    except BaseException:
        staging.fs.delete(staging.path(""), True)
        raise
    inner = prod(-(-s // i) for s, i in zip(d.shape, d.inner))
    return WriteReceipt(written, tuple(k for k, _ in documents), n, size, chunks, inner - chunks)


def _uri(folder: str) -> str:
    return "file://" + folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder


def _documents(d: ArrayDescriptor) -> list[tuple[str, str]]:
    """Metadata objects in the order of their writing, the primary one last."""
    if d.zarr_format == 3:
        return [("zarr.json", render_v3(d))]
    array, attributes = render_v2(d)
    return [*([(".zattrs", attributes)] if attributes else []), (".zarray", array)]


def create_fill_array(spark: SparkSession, root: str, d: ArrayDescriptor, path: str = "") -> WriteReceipt:
    """Metadata only: every chunk is fill."""
    schema = ", ".join([*(f"{c} long" for c in index_columns(d.rank)), f"v {d.dtype.spark}"])
    return create_array(spark.createDataFrame([], schema), root, d, path)


def create_and_open(cells: DataFrame, root: str, d: ArrayDescriptor, path: str = "") -> Array:
    create_array(cells, root, d, path)
    return open_array(cells.sparkSession, root, path)


def create_group(spark: SparkSession, root: str, path: str = "", attributes: Mapping | None = None, zarr_format: int = 3) -> None:
    """A new group; its folder may exist, its documents may not."""
    store = Store(spark, f"{root}/{path}" if path else root)
    own, extra = render_group(attributes, zarr_format)
    if any(store.exists(n) for n in ("zarr.json", ".zgroup", ".zarray")):
        raise NodeExists(f"{path or root} exists")
    if extra:
        store.create(".zattrs", extra.encode())
    store.create("zarr.json" if zarr_format == 3 else ".zgroup", own.encode())


def cells_of_rows(df: DataFrame, row: str, values: str) -> DataFrame:
    """``(i0, i1, v)`` of a table whose ``values`` column holds a row of the array as a list."""
    return df.select(F.col(row).cast("long").alias("i0"), F.posexplode(values).alias("i1", "v")).select("i0", F.col("i1").cast("long").alias("i1"), "v")


def cells_of_numpy(spark: SparkSession, values: np.ndarray, d: ArrayDescriptor) -> DataFrame:
    """``(i0.., v)`` of a local array of the descriptor's shape and exact type."""
    if values.shape != d.shape or values.dtype != d.dtype.numpy:
        raise DTypeMismatch(f"array of {values.dtype} {list(values.shape)}, not {d.dtype.name} {list(d.shape)}")
    index = [pa.array(x.ravel()) for x in np.indices(values.shape, np.int64)]
    names = [*index_columns(d.rank), "v"]
    return spark.createDataFrame(pa.Table.from_arrays([*index, d.dtype.to_arrow(np.ascontiguousarray(values).ravel())], names))
