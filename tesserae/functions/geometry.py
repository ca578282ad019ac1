"""Index arithmetic: small checks on the driver, and the same arithmetic as column expressions.

Cells carry their coordinates in BIGINT columns ``i0, i1, ...``; chunks theirs in ``c0, c1, ...``. An array of rank 0
has neither and is one row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.errors import InvalidKey, InvalidMetadata, InvalidSelection, ResourceLimit

MAX_LONG = (1 << 63) - 1
_SEGMENT = re.compile(r"[A-Za-z0-9._\-~!$&'()+,;=@ ]+")


def shape_of(values: Sequence[int], what: str = "shape", least: int = 0) -> tuple[int, ...]:
    """A checked tuple of whole numbers of at least ``least``."""
    out = tuple(values)
    if any(isinstance(v, bool) or not isinstance(v, int) or v < least or v > MAX_LONG for v in out):
        raise InvalidMetadata(f"{what} {list(out)} is not a list of whole numbers from {least}")
    return out


def element_count(shape: Sequence[int]) -> int:
    """Cells of a shape; an overflow of 63 bits is an error unless an axis is empty."""
    n = prod(shape)
    if n > MAX_LONG:
        raise ResourceLimit("elements", MAX_LONG, n)
    return n


def grid_shape(shape: Sequence[int], chunks: Sequence[int]) -> tuple[int, ...]:
    """Chunks along each axis; an empty axis has none."""
    if len(shape) != len(chunks):
        raise InvalidMetadata(f"chunks {list(chunks)} have another rank than shape {list(shape)}")
    return tuple(-(-s // c) for s, c in zip(shape, chunks))


def checked_region(shape: Sequence[int], origin: Sequence[int], extent: Sequence[int]) -> tuple[tuple[int, int], ...]:
    """(origin, extent) by axis, inside the shape; extents may be empty."""
    if not len(shape) == len(origin) == len(extent):
        raise InvalidSelection(f"origin {list(origin)} and extent {list(extent)} do not have rank {len(shape)}")
    for s, o, e in zip(shape, origin, extent):
        if o < 0 or e < 0 or o + e > s:
            raise InvalidSelection(f"region at {list(origin)} of {list(extent)} is outside shape {list(shape)}")
    return tuple(zip(origin, extent))


def index_columns(rank: int, prefix: str = "i") -> list[str]:
    return [f"{prefix}{k}" for k in range(rank)]


def chunk_columns(chunks: Sequence[int], prefix: str = "i", out: str = "c") -> list[Column]:
    """The chunk of a cell, by axis."""
    return [F.expr(f"{prefix}{k} div {c}").alias(f"{out}{k}") for k, c in enumerate(chunks)]


def linear(columns: Sequence[str], shape: Sequence[int]) -> Column:
    """C-order offset of the coordinates in ``columns``; ANSI arithmetic raises on overflow."""
    out = F.lit(0).cast("long")
    for c, s in zip(columns, shape):
        out = out * F.lit(s) + F.col(c)
    return out


def unravel(linear_column: str, shape: Sequence[int], prefix: str) -> list[Column]:
    """Coordinates of a C-order number."""
    out, stride = [], 1
    for k in range(len(shape) - 1, -1, -1):
        out.append(F.expr(f"({linear_column} div {stride}) % {max(1, shape[k])}").cast("long").alias(f"{prefix}{k}"))
        stride *= max(1, shape[k])
    return out[::-1]


def chunk_key(coords: Sequence[int], encoding: str = "default", separator: str = "/") -> str:
    """Object name of a chunk: ``c/0/1`` (default) or ``0.1`` (v2); rank 0 is ``c`` or ``0``."""
    if encoding == "default":
        return separator.join(["c", *map(str, coords)])
    return separator.join(map(str, coords)) if coords else "0"


def chunk_key_column(columns: Sequence[str], encoding: str = "default", separator: str = "/") -> Column:
    if encoding == "default":
        return F.concat_ws(separator, F.lit("c"), *columns)
    return F.concat_ws(separator, *columns) if columns else F.lit("0")


def valid_key(key: str) -> str:
    """A store key as it is, or an error: relative, portable, without empty or dot segments."""
    if not key or key.startswith("/") or "\\" in key or re.search("(?i)%2f|%5c", key):
        raise InvalidKey(f"store key {key!r} is not a portable relative path")
    for segment in key.split("/"):
        if segment in ("", ".", "..") or not _SEGMENT.fullmatch(segment):
            raise InvalidKey(f"store key {key!r} has the segment {segment!r}")
    return key


def is_valid_key(key: Column) -> Column:
    """The same as a predicate."""
    parts = F.split(key, "/")
    bad = F.exists(parts, lambda s: s.isin("", ".", "..") | ~s.rlike(f"^{_SEGMENT.pattern}$"))
    return ~(key.rlike(r"(?i)%2f|%5c|\\") | bad)


def join_path(node: str, child: str) -> str:
    """Path of a child node; the root is the empty path."""
    return valid_key("/".join(p for p in (node, child) if p)) if node or child else ""
