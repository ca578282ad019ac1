"""Opening nodes and scanning arrays as DataFrames of cells.

A scan reads the touched objects, and only those. Where Python tasks can open the store, the plan's keys are spread over
the tasks, which open each object by its key, read of a shard the index and the ranges that are asked for, and fill where there
is none. Of a rectangle of many chunks in a local store they list the folders instead, and Spark expands what is missing.
Elsewhere one path pattern names the objects for Spark's own source, and keys that its listing lacks are filled. Nothing
physical is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice, product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.errors import InvalidMetadata, InvalidSelection, NodeNotFound, ResourceLimit
from tesserae.functions import codecs as C
from tesserae.functions.dtypes import DType
from tesserae.functions.geometry import chunk_key, chunk_key_column, index_columns, join_path
from tesserae.functions.strict_json import loads
from tesserae.plans import selection as S
from tesserae.plans.descriptor import ArrayDescriptor, parse_v2, parse_v3
from tesserae.plans.shards import index_entries, index_range, near_ranges, shard_slices
from tesserae.sources import files, http
from tesserae.sources.objects import Store, alternatives

#: Cells of one Arrow batch, and elements that the driver takes as one numpy array, at most.
BATCH_CELLS, MAX_LOCAL = 1 << 18, 1 << 28
#: Keys of one task, about, and tasks of one read, at most, beyond the cores that there are.
TASK_KEYS, MAX_TASKS = 1 << 13, 10_000
#: Chunks from which on a read lists its folders, of one task then, about, and cells of an axis that a row of fill stands for, at most.
LISTED_CHUNKS, LISTED_KEYS, FILL_CELLS = 1 << 13, 1 << 18, 1 << 13


@dataclass(frozen=True)
class Registry:
    """Data types and codecs beyond the built-in ones."""

    types: Mapping[str, DType] = field(default_factory=dict)
    codecs: Mapping[str, C.Maker] = field(default_factory=dict)


#: How consolidated metadata are used: where there are any, or else an error, or never.
MODES = ("prefer", "require", "ignore")


@dataclass(frozen=True)
class Group:
    """An opened group; what it opens below itself uses its registry and mode."""

    spark: SparkSession
    root: str
    path: str
    attributes: Mapping
    zarr_format: int
    document: Mapping = field(default_factory=dict)
    registry: Registry = field(default_factory=Registry)
    mode: str = "prefer"

    def open(self, path: str) -> Array | Group:
        """The node at ``path`` below this group."""
        return open_node(self.spark, self.root, self._below(path), self.registry, self.mode)

    def open_array(self, path: str, dtype: str | None = None) -> Array:
        return open_array(self.spark, self.root, self._below(path), dtype, self.registry, self.mode)

    def open_group(self, path: str) -> Group:
        return open_group(self.spark, self.root, self._below(path), self.registry, self.mode)

    def _below(self, path: str) -> str:
        return join_path(self.path, path)


def _document(store: Store | str, path: str, name: str):
    key = join_path(path, name) if path else name
    raw = http.read(store, key, 16 << 20) if isinstance(store, str) else store.read(key)
    return None if raw is None else loads(raw)


def open_node(spark: SparkSession, root: str, path: str = "", registry: Registry = Registry(), mode: str = "prefer") -> Array | Group:
    """The node at ``path`` of the store at ``root``: v3 first, then v2.

    Consolidated metadata at the root answer for the nodes below it where ``mode`` is prefer; require fails without
    them, ignore reads each node's own documents.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    store = root if http.is_http(root) else Store(spark, root)
    at = root if http.is_http(root) else store.root
    top = (_document(store, "", "zarr.json") or {}).get("consolidated_metadata") if path and mode != "ignore" else None
    v3 = top.get("metadata", {}) if isinstance(top, dict) and top.get("kind") == "inline" else None
    if mode == "require" and path and v3 is None and _document(store, "", ".zmetadata") is None:
        raise NodeNotFound("no consolidated metadata")
    if v3 is not None and path not in v3:
        raise NodeNotFound(f"no node at {path} of {root}")
    if (doc := v3[path] if v3 is not None else _document(store, path, "zarr.json")) is not None:
        if doc.get("node_type") == "array":
            return Array(spark, at, path, parse_v3(doc, registry.codecs, registry.types))
        if doc.get("node_type") == "group":
            return Group(spark, at, path, doc.get("attributes", {}), 3, doc, registry, mode)
        raise InvalidMetadata(f"node type {doc.get('node_type')!r}")
    inline = _document(store, "", ".zmetadata") if mode != "ignore" else None
    if inline is not None:
        known = inline.get("metadata", {})
        get = lambda name: known.get(join_path(path, name) if path else name)
    else:
        get = lambda name: _document(store, path, name)
    if (doc := get(".zarray")) is not None:
        return Array(spark, at, path, parse_v2(doc, get(".zattrs"), registry.codecs))
    if (doc := get(".zgroup")) is not None:
        return Group(spark, at, path, get(".zattrs") or {}, 2, inline or {}, registry, mode)
    raise NodeNotFound(f"no node at {path or 'the root'} of {root}")


def open_array(spark: SparkSession, root: str, path: str = "", dtype: str | None = None, registry: Registry = Registry(), mode: str = "prefer") -> Array:
    """An array; a group, or another type than ``dtype``, is an error before any data is read."""
    node = open_node(spark, root, path, registry, mode)
    if not isinstance(node, Array):
        raise InvalidMetadata(f"{path or 'the root'} is a group")
    if dtype is not None:
        node.descriptor.as_type(dtype)
    return node


def open_table(objects: DataFrame, path: str = "", registry: Registry = Registry()) -> Array:
    """An array of either format, v3 first, whose objects are rows ``(key, payload)`` of a table; of these only what a read asks for is read."""
    names = ("zarr.json", ".zarray", ".zattrs")
    keys = {join_path(path, n) if path else n: n for n in names}
    found = objects.where(F.col("key").isin(*keys)).select("key", "payload").limit(len(names)).collect()
    docs = {keys[r["key"]]: loads(bytes(r["payload"])) for r in found}
    if "zarr.json" in docs:
        d = parse_v3(docs["zarr.json"], registry.codecs, registry.types)
    elif ".zarray" in docs:
        d = parse_v2(docs[".zarray"], docs.get(".zattrs"), registry.codecs)
    else:
        raise NodeNotFound(f"no array at {path or 'the root'} of the table")
    return Array(objects.sparkSession, "", path, d, objects)


def open_group(spark: SparkSession, root: str, path: str = "", registry: Registry = Registry(), mode: str = "prefer") -> Group:
    """A group; an array is an error."""
    node = open_node(spark, root, path, registry, mode)
    if not isinstance(node, Group):
        raise InvalidMetadata(f"{path or 'the root'} is an array")
    return node


@dataclass(frozen=True)
class Array:
    """An opened array; every read is a lazy DataFrame."""

    spark: SparkSession
    root: str
    path: str
    descriptor: ArrayDescriptor
    table: DataFrame | None = None

    @property
    def columns(self) -> list[str]:
        return index_columns(self.descriptor.rank)

    def all_axes(self) -> tuple[S.Axis, ...]:
        return S.checked(self.descriptor.shape, [S.All()] * self.descriptor.rank)

    def read_all(self) -> DataFrame:
        """``(i0.., v)`` of every cell."""
        return self.cells(self.all_axes())

    def region(self, origin: Sequence[int], extent: Sequence[int]) -> DataFrame:
        """``(i0.., v)`` of a rectangle."""
        return self.cells(S.region(self.descriptor.shape, origin, extent))

    def select(self, *selectors: S.Selector) -> DataFrame:
        """``(o0.., i0.., v)`` of the product of one selector for each axis; ``o`` is the place in the result."""
        return self.cells(S.checked(self.descriptor.shape, selectors), placed=True)

    @property
    def by_key(self) -> bool:
        """Whether tasks open objects by their keys."""
        return self.table is None and not http.is_http(self.root) and files.opens(self._folder())

    def _folder(self) -> str:
        return Store(self.spark, self.root).root

    def objects(self, axes: Sequence[S.Axis]) -> DataFrame | None:
        """``(c0.., key, length, content)`` of the objects of the touched chunks that exist."""
        d = self.descriptor
        if self.table is not None:
            rows = self.table.select(F.col("key").alias("path"), F.length("payload").cast("long").alias("length"), F.col("payload").alias("content"))
            return self._asked(axes).join(rows, "path").drop("path")
        if http.is_http(self.root):
            return http.fetched(self._asked(axes), self.root)
        steps = []
        for axis, chunk in zip(axes, d.chunks):
            n = axis.touched(chunk)
            if axis.values is not None:
                values = np.unique(axis.values // chunk).tolist() if n <= 256 else ()
            else:
                values = sorted({(axis.start + k * axis.step) // chunk for k in range(axis.length)}) if axis.step >= chunk and n <= 256 else range(axis.bounds(chunk)[0], axis.bounds(chunk)[1] + 1) if n <= 256 else ()
            steps.append(alternatives(values, n))
        name = d.separator.join((["c"] if d.encoding == "default" else []) + steps) or "0"
        found = Store(self.spark, self.root).objects(join_path(self.path, "") + ("/" if self.path else "") + name)
        if found is None:
            return None
        number = rf"(?:^|/){'c' + d.separator if d.encoding == 'default' and d.rank else ''}"
        tail = number + d.separator.replace(".", r"\.").join(["([0-9]+)"] * d.rank) + "$" if d.rank else None
        own = F.expr(f"substr(key, {len(self.path) + 2 if self.path else 1})").alias("key")
        found = found.select(own, "length", "content")
        for k in range(d.rank):
            found = found.withColumn(f"c{k}", F.regexp_extract("key", tail.replace("c.", r"c\."), k + 1))
        keep = reduce(lambda a, b: a & b, [F.col(f"c{k}") != "" for k in range(d.rank)], F.lit(True))
        return found.where(keep).select(*[F.col(f"c{k}").cast("long").alias(f"c{k}") for k in range(d.rank)], "key", "length", "content")

    def _asked(self, axes: Sequence[S.Axis]) -> DataFrame:
        """The plan's keys with their paths in the store, one request to a row, spread over the tasks."""
        cores = self.spark.sparkContext.defaultParallelism
        total = reduce(lambda a, b: a * b, [a.touched(c) for a, c in zip(axes, self.descriptor.chunks)], 1)
        plan = S.keyed_plan(self.spark, self.descriptor, axes, max(cores, min(total // TASK_KEYS, MAX_TASKS)))
        path = F.concat(F.lit(f"{self.path}/"), "key") if self.path else F.col("key")
        plan = plan.select(*[f"c{k}" for k in range(self.descriptor.rank)], "key", path.alias("path"))
        return plan if self.table is not None or all(a.values is None for a in axes) else plan.repartition(cores)

    def _lists(self, axes: Sequence[S.Axis]) -> bool:
        """Whether a read lists the folders of its chunks: a rectangle of many chunks, of which each folder has a fair part."""
        d = self.descriptor
        if d.rank < 2 or d.separator != "/" or not self.by_key or not files.is_local(self._folder()) or any(a.values is not None or a.step != 1 for a in axes):
            return False
        counts = [a.touched(c) for a, c in zip(axes, d.chunks)]
        return prod(counts) > LISTED_CHUNKS and 4 * counts[-1] * d.chunks[-1] >= d.shape[-1]

    def _listed(self, axes: tuple[S.Axis, ...], placed: bool, schema: str) -> DataFrame:
        """Cells of a rectangle: each task lists its folders of chunks and opens what there is; stretches of fill are expanded by Spark.

        Objects that appear or vanish during the read can be missed, as in a read of Spark's own source.
        """
        d, cores = self.descriptor, self.spark.sparkContext.defaultParallelism
        top = f"{self._folder()}/{self.path}".rstrip("/")
        counts, lows = [a.touched(c) for a, c in zip(axes, d.chunks)], [a.start // c for a, c in zip(axes, d.chunks)]
        rows, last, total = prod(counts[:-1]), counts[-1], prod(counts)
        tasks = max(cores, min(max(min(total // TASK_KEYS, 4 * cores), total // LISTED_KEYS), MAX_TASKS))
        if rows > S.MAX_CHUNKS:
            raise ResourceLimit("folders of a read", S.MAX_CHUNKS, rows)
        pieces = min(-(-tasks // rows), 4 * cores, last)  # of a folder, which each of them lists
        stretches = self.spark.range(0, rows * pieces, 1, min(tasks, rows * pieces))

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], str, range, list[int]]]:
            for batch in batches:
                for nth in batch.column(0).to_pylist():
                    row, piece = divmod(nth, pieces)
                    at = [int(c) + low for c, low in zip(np.unravel_index(row, counts[:-1]), lows)]
                    folder, span = f"{top}/{chunk_key(at, d.encoding, '/')}", range(lows[-1] + last * piece // pieces, lows[-1] + last * (piece + 1) // pieces)
                    yield at, folder, span, sorted(n for n in files.numbers(folder) if n in span)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from gathered(d, (part for at, folder, _, found in listed(batches) for n in found for part in opened(d, [*at, n], f"{folder}/{n}", axes)), axes, placed)

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            boxes = (box for at, _, span, found in listed(batches) for box in fill_boxes(d, at, span, found, axes))
            while held := list(islice(boxes, 1 << 13)):
                ends = np.array(held, np.int64).reshape(len(held), -1)
                yield pa.RecordBatch.from_arrays([*map(pa.array, np.ascontiguousarray(ends.T)), d.dtype.to_arrow(np.full(len(held), d.fill_value, d.dtype.numpy))], names=[*names, "v"])

        names = [f"{end}{k}" for k in range(d.rank) for end in ("low", "high")]
        empty = stretches.mapInArrow(fill, ", ".join([*(f"{n} long" for n in names), f"v {d.dtype.spark}"]))
        for k, c in enumerate(self.columns):
            empty = empty.withColumn(c, F.explode(F.sequence(f"low{k}", f"high{k}")))
        places = [(F.col(c) - a.start).alias(o) for c, o, a in zip(self.columns, index_columns(d.rank, "o"), axes)] if placed else []
        return stretches.mapInArrow(read, schema).unionByName(empty.select(*places, *self.columns, "v"))

    def missing(self, axes: Sequence[S.Axis]) -> DataFrame:
        """``(c0..)`` of touched chunks without an object."""
        plan = S.keyed_plan(self.spark, self.descriptor, axes)
        found = http.fetched(self._asked(axes), self.root, content=False) if http.is_http(self.root) else self.objects(axes)
        cols = [f"c{k}" for k in range(self.descriptor.rank)]
        return (plan if found is None else plan.join(found.select("key"), "key", "left_anti")).select(*cols or [F.lit(0).alias("none")])

    def cells(self, axes: Sequence[S.Axis], placed: bool = False) -> DataFrame:
        """Selected cells; with ``placed`` also their places in the result."""
        d, axes = self.descriptor, tuple(axes)
        cols = [*(index_columns(d.rank, "o") if placed else []), *self.columns]
        schema = ", ".join([*(f"{c} long" for c in cols), f"v {d.dtype.spark}"])
        if 0 in S.output_shape(axes):
            return self.spark.createDataFrame([], schema)
        if self._lists(axes):
            return self._listed(axes, placed, schema)
        if self.by_key:
            root, names = self._folder(), [f"c{k}" for k in range(d.rank)]

            def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    paths, *coords = (batch.column(c).to_pylist() for c in ("path", *names))
                    at = zip(*coords) if coords else [()] * len(paths)
                    yield from gathered(d, (part for c, path in zip(at, paths) for part in opened(d, c, f"{root}/{path}", axes)), axes, placed)

            return self._asked(axes).select("path", *names).mapInArrow(read, schema)
        objects, coords = self.objects(axes), [f"c{k}" for k in range(d.rank)]

        def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = (part for row in batch.to_pylist() for part in blocks(d, [row[c] for c in coords], row["content"], axes))
                yield from gathered(d, parts, axes, placed)

        none = None if d.sharding is None else np.broadcast_to(d.fill_value, d.chunks)

        def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = (([row[c] * n for c, n in zip(coords, d.chunks)], none) for row in batch.to_pylist())
                yield from gathered(d, parts, axes, placed)

        fill = self.missing(axes).mapInArrow(filled, schema)
        return fill if objects is None else objects.select(*coords, "content").mapInArrow(decoded, schema).unionByName(fill)

    def points(self, points: DataFrame | Sequence[Sequence[int]]) -> DataFrame:
        """``(ord, i0.., v)``: one row for each point in the request, repeats included; ``ord`` is its place.

        ``points`` is a list, or a DataFrame ``(ord, i0..)``. Points are grouped by chunk and meet their chunk's
        object, each in one task; a chunk's points are a list, so a chunk that is asked for without end should be
        read as a region instead.
        """
        d = self.descriptor
        if not isinstance(points, DataFrame):
            rows = [(k, *map(int, p)) for k, p in enumerate(points)]
            if any(len(r) != d.rank + 1 or any(not 0 <= x < s for x, s in zip(r[1:], d.shape)) for r in rows):
                raise InvalidSelection(f"points outside shape {list(d.shape)}")
            points = self.spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ["ord", *self.columns]))
        else:
            outside = reduce(lambda a, b: a | b, [(F.col(f"i{k}") < 0) | (F.col(f"i{k}") >= s) for k, s in enumerate(d.shape)], F.lit(False))
            if points.where(outside).limit(1).count():
                raise InvalidSelection(f"points outside shape {list(d.shape)}")
        plan = S.point_plan(points, d).withColumn("key", chunk_key_column([f"c{k}" for k in range(d.rank)], d.encoding, d.separator))
        schema = ", ".join([f"{c} long" for c in ["ord", *self.columns]] + [f"v {d.dtype.spark}"])
        coords, names = [f"c{k}" for k in range(d.rank)], ["ord", *self.columns, "v"]

        def gathered_chunk(row: dict, content: bytes | pa.NativeFile | None) -> Iterator[pa.RecordBatch]:
            origin = np.array([row[c] * n for c, n in zip(coords, d.chunks)], np.int64)
            dest = pa.array([p["dest"] for p in row["points"]], pa.int64())
            local = np.stack(np.unravel_index([p["source"] for p in row["points"]], d.chunks), 1) if d.rank else np.zeros((len(dest), 0), np.int64)
            if content is None:
                values = np.broadcast_to(d.fill_value, len(dest))
            else:
                values = whole_chunk(d, [row[c] for c in coords], content, local + origin)[tuple(local.T)]
                values = np.broadcast_to(values, len(dest))
            index = [pa.array(x) for x in (local + origin).T]
            yield pa.RecordBatch.from_arrays([dest, *index, d.dtype.to_arrow(np.ascontiguousarray(values))], names)

        if self.by_key:
            root = f"{self._folder()}/{self.path}" if self.path else self._folder()

            def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in batch.to_pylist():
                        content = files.open_object(f"{root}/{row['key']}")
                        yield from gathered_chunk(row, content)
                        if content is not None:
                            content.close()

            return plan.select(*coords, "key", "points").mapInArrow(read, schema)
        limits = plan.agg(*[F.min(f"c{k}").alias(f"a{k}") for k in range(d.rank)], *[F.max(f"c{k}").alias(f"b{k}") for k in range(d.rank)], F.count("*").alias("n")).first()
        if not limits["n"]:
            return self.spark.createDataFrame([], schema)
        box = [S.Axis(limits[f"a{k}"] * c, 1, min(s, (limits[f"b{k}"] + 1) * c) - limits[f"a{k}"] * c) for k, (s, c) in enumerate(zip(d.shape, d.chunks))]
        objects = self.objects(box)

        def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield from gathered_chunk(row, row.get("content"))

        if objects is None:
            return plan.select(*coords, "points").mapInArrow(gathered, schema)
        met = plan.join(objects.select("key", "content"), "key").select(*coords, "points", "content")
        absent = plan.join(objects.select("key"), "key", "left_anti").select(*coords, "points")
        return met.mapInArrow(gathered, schema).unionByName(absent.mapInArrow(gathered, schema))

    def to_numpy(self, *selectors: S.Selector) -> np.ndarray:
        """A selection as one array on the driver, within ``MAX_LOCAL`` elements."""
        axes = S.checked(self.descriptor.shape, selectors) if selectors else self.all_axes()
        shape = S.output_shape(axes)
        if (n := reduce(lambda a, b: a * b, shape, 1)) > MAX_LOCAL:
            raise ResourceLimit("elements on the driver", MAX_LOCAL, n)
        got = self.cells(axes, placed=True).toArrow()
        out = np.zeros(shape, self.descriptor.dtype.numpy)
        out[tuple(got[f"o{k}"].to_numpy() for k in range(len(shape)))] = self.descriptor.dtype.from_arrow(got["v"]) if shape else self.descriptor.dtype.from_arrow(got["v"])[0]
        return out


def opened(d: ArrayDescriptor, coords: Sequence[int], uri: str, axes: Sequence[S.Axis]) -> Iterator[tuple[list[int], np.ndarray | None]]:
    """(origin, values) of the object at ``uri``; without values where there is none."""
    content = files.open_object(uri)
    if content is None:
        yield [c * n for c, n in zip(coords, d.chunks)], None if d.sharding is None else np.broadcast_to(d.fill_value, d.chunks)
        return
    with content:
        yield from blocks(d, coords, content, axes)


def fill_boxes(d: ArrayDescriptor, at: Sequence[int], span: range, found: Sequence[int], axes: Sequence[S.Axis]) -> Iterator[tuple[tuple[int, int], ...]]:
    """(first, last) cell on each axis of boxes that cover a folder's stretch of chunks but for those ``found``; the folder is that of ``at``."""
    ends = [*zip(at, (c + 1 for c in at))]
    for low, high in zip([span.start, *(n + 1 for n in found)], [*found, span.stop]):
        if low < high:
            cells = [(max(a.start, x * n), min(a.start + a.length, s, y * n)) for (x, y), n, s, a in zip([*ends, (low, high)], d.chunks, d.shape, axes)]
            yield from product(*([(x, min(x + FILL_CELLS, y) - 1) for x in range(x, y, FILL_CELLS)] for x, y in cells))


def blocks(d: ArrayDescriptor, coords: Sequence[int], content: bytes | pa.NativeFile, axes: Sequence[S.Axis]) -> Iterator[tuple[list[int], np.ndarray]]:
    """(origin, values) of a chunk, or of the selected inner chunks of a shard; inner chunks without data are fill.

    Of an open shard only the index and the selected chunks' ranges are read, near ones as one, unless the shard as a whole is encoded.
    """
    origin = [c * n for c, n in zip(coords, d.chunks)]
    if d.sharding is None:
        yield origin, C.decode_chunk(content if isinstance(content, bytes) else content.read(), d.chunks, d.codecs, d.dtype)
        return
    if d.codecs or isinstance(content, bytes):
        content = pa.BufferReader(C.decode_bytes(content if isinstance(content, bytes) else content.read(), d.codecs))
    start, n = index_range(content.size(), d.sharding, d.chunks)
    index = index_entries(content.read_at(n, start), content.size(), d.sharding)
    asked = []
    for local, at in shard_slices(d.sharding, d.chunks):
        low = [o + x for o, x in zip(origin, at)]
        if all(len(a.inside(x, min(x + n, s))[0]) for a, x, n, s in zip(axes, low, d.sharding.inner, d.shape)):
            asked.append((low, *index[local]))
    for low, offset, _ in asked:
        if offset is None:
            yield low, np.broadcast_to(d.fill_value, d.sharding.inner)
    held = sorted((x for x in asked if x[1] is not None), key=lambda x: x[1])
    for start, end in near_ranges([(offset, length) for _, offset, length in held]):
        part = content.read_at(end - start, start)
        while held and held[0][1] + held[0][2] <= end:
            low, offset, length = held.pop(0)
            yield low, C.decode_chunk(part[offset - start : offset - start + length], d.sharding.inner, d.sharding.codecs, d.dtype)


def whole_chunk(d: ArrayDescriptor, coords: Sequence[int], content: bytes | pa.NativeFile, points: np.ndarray) -> np.ndarray:
    """The nominal chunk with the parts decoded that hold the points."""
    axes = [S.Axis(length=len(p), values=p) for p in points.T]
    out = np.broadcast_to(d.fill_value, d.chunks).copy()
    origin = [c * n for c, n in zip(coords, d.chunks)]
    for low, block in blocks(d, coords, content, axes):
        out[tuple(slice(x - o, x - o + n) for x, o, n in zip(low, origin, block.shape))] = block
    return out


def gathered(d: ArrayDescriptor, parts: Iterable[tuple[Sequence[int], np.ndarray | None]], axes: Sequence[S.Axis], placed: bool) -> Iterator[pa.RecordBatch]:
    """Selected cells of (origin, values) parts, of a fill chunk where there are no values; small parts share their Arrow batches."""
    parts, limit = iter(parts), max(1, BATCH_CELLS // max(1, prod(d.inner)))
    while held := list(islice(parts, limit)):
        small = [(o, b) for o, b in held if b is None or b.shape == d.inner] if limit > 1 and d.rank else []
        if small:
            yield from _together(d, small, axes, placed)
        for origin, block in held if not small else [(o, b) for o, b in held if b is not None and b.shape != d.inner]:
            yield from selected(d, origin, np.broadcast_to(d.fill_value, d.inner) if block is None else block, axes, placed)


def _together(d: ArrayDescriptor, parts: Sequence[tuple[Sequence[int], np.ndarray | None]], axes: Sequence[S.Axis], placed: bool) -> Iterator[pa.RecordBatch]:
    """Selected cells of blocks of one shape; blocks with equally many of them on each axis are one Arrow batch."""
    origins = np.array([o for o, _ in parts], np.int64)
    values = np.full((len(parts), *d.inner), d.fill_value, d.dtype.numpy)
    for k, (_, block) in enumerate(parts):
        if block is not None:
            values[k] = block
    backs, found, sizes = [], [], np.empty_like(origins)
    for k, (a, n, s) in enumerate(zip(axes, d.inner, d.shape)):
        lows, back = np.unique(origins[:, k], return_inverse=True)
        found.append([a.inside(x, min(x + n, s)) for x in lows.tolist()])
        backs.append(back)
        sizes[:, k] = np.array([len(p) for p, _ in found[k]])[back]
    kinds, kind = np.unique(sizes, axis=0, return_inverse=True)
    names = [*(index_columns(d.rank, "o") if placed else []), *index_columns(d.rank), "v"]
    for nth, size in enumerate(kinds.tolist()):
        at = np.flatnonzero(kind.ravel() == nth)
        if prod(size) > prod(d.inner):  # listed positions that repeat
            for j in at:
                yield from selected(d, origins[j].tolist(), values[j], axes, placed)
        elif 0 not in size:
            along = lambda x, k: x.reshape(len(at), *[-1 if j == k else 1 for j in range(d.rank)])
            index, out = [], []
            for k, n in enumerate(size):
                table = np.array([x if len(x[0]) == n else np.zeros((2, n), np.int64) for x in found[k]], np.int64)[backs[k][at]]
                index.append(along(table[:, 0], k))
                out.append(along(table[:, 1], k))
            local = [x - along(origins[at, k], k) for k, x in enumerate(index)]
            block = values[(at.reshape(-1, *[1] * d.rank), *local)]
            columns = [pa.array(np.ascontiguousarray(np.broadcast_to(x, block.shape)).ravel()) for x in (*(out if placed else ()), *index)]
            yield pa.RecordBatch.from_arrays([*columns, d.dtype.to_arrow(block.ravel())], names)


def selected(d: ArrayDescriptor, origin: Sequence[int], block: np.ndarray, axes: Sequence[S.Axis], placed: bool) -> Iterator[pa.RecordBatch]:
    """The block's selected cells in Arrow batches of bounded size."""
    found = [a.inside(o, min(o + n, s)) for a, o, n, s in zip(axes, origin, block.shape, d.shape)]
    sizes = [len(p) for p, _ in found]
    if 0 in sizes:
        return
    rest = max(1, reduce(lambda a, b: a * b, sizes[1:], 1))
    step = max(1, BATCH_CELLS // rest)
    for at in range(0, sizes[0] if sizes else 1, step):
        part = [(p[at : at + step], o[at : at + step]) if k == 0 else (p, o) for k, (p, o) in enumerate(found)]
        values = block[np.ix_(*[p - x for (p, _), x in zip(part, origin)])] if part else block
        spread = lambda xs: [pa.array(np.ascontiguousarray(np.broadcast_to(x, values.shape)).ravel()) for x in (np.ix_(*xs) if xs else ())]
        index, out = spread([p for p, _ in part]), spread([o for _, o in part]) if placed else []
        names = [*(f"o{k}" for k in range(len(out))), *(f"i{k}" for k in range(len(index))), "v"]
        yield pa.RecordBatch.from_arrays([*out, *index, d.dtype.to_arrow(np.ascontiguousarray(values).ravel())], names)
