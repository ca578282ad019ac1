"""Metadata documents of v2 and v3 as one descriptor, and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np

from tesserae.errors import DTypeMismatch, InvalidMetadata, ResourceLimit, Unsupported
from tesserae.functions import codecs as C
from tesserae.functions.dtypes import DType, dtype, v2_dtype
from tesserae.functions.geometry import element_count, grid_shape, shape_of
from tesserae.functions.strict_json import dumps, whole

#: Limits at open: axes, and decoded bytes of a chunk (of an inner chunk where there are shards).
MAX_RANK, MAX_CHUNK_BYTES = 32, 512 << 20


@dataclass(frozen=True)
class Sharding:
    """Inner chunks inside an object, found by an index at its start or end."""

    inner: tuple[int, ...]
    codecs: tuple[C.Codec, ...] = (C.Bytes(),)
    index_codecs: tuple[C.Codec, ...] = (C.Bytes(), C.Crc32c())
    location: str = "end"

    def counts(self, shard: Sequence[int]) -> tuple[int, ...]:
        return tuple(s // i for s, i in zip(shard, self.inner))

    def index_length(self, shard: Sequence[int]) -> int:
        """Bytes of the encoded index: 16 for each inner chunk, through codecs of fixed length."""
        n = 16 * element_count(self.counts(shard))
        for c in self.index_codecs[1:]:
            n = c.fixed_length(n)
        return n


@dataclass(frozen=True)
class ArrayDescriptor:
    """What a v2 or v3 array is, independent of its format."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: DType
    fill: Any = 0
    codecs: tuple[C.Codec, ...] = (C.Bytes(),)
    sharding: Sharding | None = None
    encoding: str = "default"
    separator: str = "/"
    names: tuple[str | None, ...] | None = None
    attributes: Mapping = field(default_factory=dict)
    zarr_format: int = 3

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def grid(self) -> tuple[int, ...]:
        return grid_shape(self.shape, self.chunks)

    @property
    def fill_value(self) -> np.ndarray:
        return self.dtype.fill(self.fill)

    @property
    def inner(self) -> tuple[int, ...]:
        """Shape of what is decoded by itself."""
        return self.sharding.inner if self.sharding else self.chunks

    def checked(self) -> ArrayDescriptor:
        """Itself, filled in and within the limits, or an error before any data is touched."""
        shape_of(self.shape)
        shape_of(self.chunks, "chunks", 1)
        grid_shape(self.shape, self.chunks)
        element_count(self.shape)
        if self.rank > MAX_RANK:
            raise ResourceLimit("axes", MAX_RANK, self.rank)
        if (n := element_count(self.inner) * self.dtype.width) > MAX_CHUNK_BYTES:
            raise ResourceLimit("bytes of a chunk", MAX_CHUNK_BYTES, n)
        if self.names is not None and len(self.names) != self.rank:
            raise InvalidMetadata(f"{len(self.names)} dimension names for rank {self.rank}")
        self.dtype.fill(self.fill)
        out, sharding = self, self.sharding
        if sharding:
            if self.zarr_format == 2:
                raise Unsupported("shards in a v2 array")
            shape_of(sharding.inner, "inner chunks", 1)
            if len(sharding.inner) != self.rank or any(c % i for c, i in zip(self.chunks, sharding.inner)):
                raise InvalidMetadata(f"inner chunks {list(sharding.inner)} do not divide {list(self.chunks)}")
            if any(c.kind != "bytes" for c in self.codecs):
                raise InvalidMetadata("only byte codecs may follow shards")
            if sharding.location not in ("start", "end"):
                raise InvalidMetadata(f"index location {sharding.location!r}")
            first, *rest = sharding.index_codecs or (None,)
            if first != C.Bytes("little") or any(c.fixed_length(16) is None for c in rest):
                raise Unsupported("index codecs are little-endian bytes, then codecs of fixed length")
            chain = C.checked_chain(C.typed(sharding.codecs, self.dtype), sharding.inner, self.dtype)
            return replace(out, sharding=replace(sharding, codecs=chain))
        return replace(out, codecs=C.checked_chain(C.typed(self.codecs, self.dtype), self.chunks, self.dtype))

    def as_type(self, name: str) -> ArrayDescriptor:
        """Itself, if it has this type; otherwise an error before any data is read."""
        if self.dtype.name != name:
            raise DTypeMismatch(f"array of {self.dtype.name}, not {name}")
        return self


def _fields(doc: Any, required: Sequence[str], what: str) -> dict:
    if not isinstance(doc, dict):
        raise InvalidMetadata(f"{what} is not an object")
    if missing := [f for f in required if f not in doc]:
        raise InvalidMetadata(f"{what} lacks {', '.join(missing)}")
    return doc


def _extension(value: Any, what: str) -> tuple[str, dict, bool]:
    """Name, configuration and whether it must be understood."""
    if isinstance(value, str):
        return value, {}, True
    doc = _fields(value, ("name",), what)
    must = doc.get("must_understand", True)
    if not isinstance(doc["name"], str) or not isinstance(doc.get("configuration", {}), dict) or not isinstance(must, bool):
        raise InvalidMetadata(f"{what} {value!r}")
    return doc["name"], doc.get("configuration", {}), must


def _ints(values: Any, what: str, least: int = 0) -> tuple[int, ...]:
    if not isinstance(values, list):
        raise InvalidMetadata(f"{what} is not a list")
    return tuple(whole(v, what, least) for v in values)


def _codecs(values: Any, kind: DType, makers: Mapping[str, C.Maker] | None) -> tuple[list[C.Codec], Sharding | None]:
    if not isinstance(values, list) or not values:
        raise InvalidMetadata("codecs are not a list with entries")
    known, out, sharding = {**C.BUILT_IN, **(makers or {})}, [], None
    for value in values:
        name, config, must = _extension(value, "codec")
        if name == "sharding_indexed":
            if out or sharding:
                raise Unsupported("codecs before shards")
            _fields(config, ("chunk_shape", "codecs"), "sharding")
            inner, nested = _codecs(config["codecs"], kind, makers)
            index, _ = _codecs(config.get("index_codecs", ["bytes", "crc32c"]), dtype("uint8"), makers)
            if nested:
                raise Unsupported("shards inside shards")
            sharding = Sharding(_ints(config["chunk_shape"], "chunk_shape", 1), tuple(inner), tuple(C.Bytes("little") if c == C.Bytes(None) else c for c in index), config.get("index_location", "end"))
        elif name in known:
            out.append(known[name](config, kind))
            kind = out[-1].astype if isinstance(out[-1], C.Delta) else kind
        elif must:
            raise Unsupported(f"codec {name!r}")
    return out, sharding


def parse_v3(doc: Any, makers: Mapping[str, C.Maker] | None = None, types: Mapping[str, DType] | None = None) -> ArrayDescriptor:
    """A ``zarr.json`` of node type array."""
    _fields(doc, ("zarr_format", "node_type", "shape", "data_type", "chunk_grid", "chunk_key_encoding", "fill_value", "codecs"), "array metadata")
    if whole(doc["zarr_format"], "zarr_format") != 3 or doc["node_type"] != "array":
        raise InvalidMetadata("not a v3 array")
    must = []
    kind_name, _, m = _extension(doc["data_type"], "data_type")
    must.append(m)
    grid, grid_config, m = _extension(doc["chunk_grid"], "chunk_grid")
    must.append(m)
    keys, keys_config, m = _extension(doc["chunk_key_encoding"], "chunk_key_encoding")
    must.append(m)
    if not all(must):
        raise InvalidMetadata("data type, chunk grid and chunk keys must be understood")
    if grid != "regular":
        raise Unsupported(f"chunk grid {grid!r}")
    if keys not in ("default", "v2"):
        raise Unsupported(f"chunk keys {keys!r}")
    separator = keys_config.get("separator", "/" if keys == "default" else ".")
    if separator not in ("/", "."):
        raise InvalidMetadata(f"separator {separator!r}")
    for t in doc.get("storage_transformers", []):
        if _extension(t, "storage transformer")[2]:
            raise Unsupported("storage transformers")
    known = ("zarr_format", "node_type", "shape", "data_type", "chunk_grid", "chunk_key_encoding", "fill_value", "codecs", "attributes", "dimension_names", "storage_transformers")
    for name, value in doc.items():
        if name not in known and not (isinstance(value, dict) and value.get("must_understand") is False):
            raise Unsupported(f"field {name!r}")
    names = doc.get("dimension_names")
    if names is not None and (not isinstance(names, list) or any(n is not None and type(n) is not str for n in names)):
        raise InvalidMetadata("dimension_names")
    kind = dtype(kind_name, dict(types or {}))
    chain, sharding = _codecs(doc["codecs"], kind, makers)
    return ArrayDescriptor(
        _ints(doc["shape"], "shape"), _ints(grid_config.get("chunk_shape"), "chunk_shape", 1), kind, kind.fill(doc["fill_value"]), tuple(chain), sharding,
        keys, separator, tuple(names) if names is not None else None, doc.get("attributes", {}), 3,
    ).checked()


def parse_v2(doc: Any, attributes: Mapping | None = None, makers: Mapping[str, C.Maker] | None = None) -> ArrayDescriptor:
    """A ``.zarray`` with the content of its ``.zattrs``: order F is a transpose, delta precedes the bytes, filters the compressor."""
    _fields(doc, ("zarr_format", "shape", "chunks", "dtype", "compressor", "fill_value", "order", "filters"), "v2 array metadata")
    if whole(doc["zarr_format"], "zarr_format") != 2:
        raise InvalidMetadata("not a v2 array")
    if not isinstance(doc["dtype"], str):
        raise Unsupported("structured v2 types")
    kind, order = v2_dtype(doc["dtype"])
    if doc["order"] not in ("C", "F"):
        raise InvalidMetadata(f"order {doc['order']!r}")
    shape, chunks = _ints(doc["shape"], "shape"), _ints(doc["chunks"], "chunks", 1)
    known = {**C.BUILT_IN, **(makers or {})}

    def make(config: dict, what: str) -> C.Codec:
        name = _fields(config, ("id",), what)["id"]
        if name not in known or name in ("bytes", "transpose"):
            raise Unsupported(f"{what} {name!r}")
        if name == "blosc":
            shuffles = ("noshuffle", "shuffle", "bitshuffle")
            at = whole(config.get("shuffle", 1), "shuffle", 0)
            if at >= len(shuffles):
                raise InvalidMetadata(f"blosc shuffle {at}")
            config = {"typesize": kind.width, "blocksize": 0, **config, "shuffle": shuffles[at]}
        return known[name](config, kind)

    filters = [make(f, "filter") for f in doc["filters"] or []]
    arrays = [f for f in filters if f.kind == "array"]
    if len(arrays) > 1 or arrays and filters[0].kind != "array":
        raise InvalidMetadata("one delta at most, before other filters")
    chain: list[C.Codec] = [C.Transpose(tuple(range(len(shape)))[::-1])] if doc["order"] == "F" and len(shape) > 1 else []
    stored = arrays[0].astype if arrays else kind
    chain += [*arrays, C.Bytes(order if stored.width > 1 and stored.kind != "V" else None), *(f for f in filters if f.kind != "array")]
    if doc["compressor"] is not None:
        chain.append(make(doc["compressor"], "compressor"))
    attributes = dict(attributes or {})
    names = attributes.get("_ARRAY_DIMENSIONS")
    separator = doc.get("dimension_separator", ".")
    if separator not in (".", "/"):
        raise InvalidMetadata(f"dimension_separator {separator!r}")
    return ArrayDescriptor(
        shape, chunks, kind, kind.fill(doc["fill_value"]), tuple(chain), None, "v2", separator,
        tuple(names) if isinstance(names, list) and all(type(n) is str for n in names) and len(names) == len(shape) else None, attributes, 2,
    ).checked()


def _codec_json(c: C.Codec) -> dict:
    return {"name": c.name} | ({"configuration": c.config()} if c.config() else {})


def render_v3(d: ArrayDescriptor) -> str:
    """The ``zarr.json`` of an array, keys sorted."""
    chain = [_codec_json(c) for c in d.codecs]
    if s := d.sharding:
        config = {"chunk_shape": list(s.inner), "codecs": [_codec_json(c) for c in s.codecs], "index_codecs": [_codec_json(c) for c in s.index_codecs], "index_location": s.location}
        chain.insert(0, {"name": "sharding_indexed", "configuration": config})
    doc = {
        "zarr_format": 3, "node_type": "array", "shape": list(d.shape), "data_type": d.dtype.name,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(d.chunks)}},
        "chunk_key_encoding": {"name": d.encoding, "configuration": {"separator": d.separator}},
        "fill_value": d.dtype.fill_json(d.fill_value), "codecs": chain, "attributes": dict(d.attributes),
    }
    if d.names is not None:
        doc["dimension_names"] = list(d.names)
    return dumps(doc)


def render_v2(d: ArrayDescriptor) -> tuple[str, str | None]:
    """The ``.zarray`` of an array and, where it has attributes, its ``.zattrs``."""
    if d.sharding:
        raise Unsupported("shards in a v2 array")
    chain, order, filters, compressor = list(d.codecs), "C", [], None
    if isinstance(chain[0], C.Transpose):
        if chain[0].order != tuple(range(d.rank))[::-1]:
            raise Unsupported("v2 has no transpose but that of order F")
        order = "F"
        chain.pop(0)
    if isinstance(chain[0], C.Delta):
        filters.append({"id": "delta", **chain.pop(0).config()})
    endian = chain.pop(0).endian if isinstance(chain[0], C.Bytes) else None
    for c in chain:
        if compressor or c.kind != "bytes":
            raise Unsupported("v2 has one compressor, after its filters")
        if isinstance(c, C.Shuffle):
            filters.append({"id": "shuffle", **c.config()})
        else:
            config = dict(c.config())
            if isinstance(c, C.Blosc):
                config["shuffle"] = ("noshuffle", "shuffle", "bitshuffle").index(c.shuffle)
            compressor = {"id": c.name, **config}
    kind = d.dtype.v2.replace("<", ">") if endian == "big" else d.dtype.v2
    doc = {
        "zarr_format": 2, "shape": list(d.shape), "chunks": list(d.chunks), "dtype": kind, "compressor": compressor,
        "fill_value": d.dtype.fill_json(d.fill_value), "order": order, "filters": filters or None, "dimension_separator": d.separator,
    }
    attributes = dict(d.attributes)
    if d.names is not None and all(d.names):
        attributes["_ARRAY_DIMENSIONS"] = list(d.names)
    return dumps(doc), dumps(attributes) if attributes else None


def render_group(attributes: Mapping | None = None, zarr_format: int = 3) -> tuple[str, str | None]:
    """A group's document and, in v2, its ``.zattrs``."""
    if zarr_format == 3:
        return dumps({"zarr_format": 3, "node_type": "group", "attributes": dict(attributes or {})}), None
    return dumps({"zarr_format": 2}), dumps(dict(attributes)) if attributes else None
