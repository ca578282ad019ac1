"""Scalar types: their numpy form inside a chunk and their Spark form in the column ``v``."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tesserae.errors import DTypeMismatch, InvalidMetadata
from tesserae.functions.strict_json import Number

# Name, numpy code, Spark type. Unsigned types widen; half floats and uint64 have no narrower carrier.
_TYPES = (
    ("bool", "b1", "boolean"), ("int8", "i1", "tinyint"), ("uint8", "u1", "smallint"), ("int16", "i2", "smallint"),
    ("uint16", "u2", "int"), ("int32", "i4", "int"), ("uint32", "u4", "bigint"), ("int64", "i8", "bigint"),
    ("uint64", "u8", "decimal(20,0)"), ("float16", "f2", "float"), ("float32", "f4", "float"), ("float64", "f8", "double"),
    ("complex64", "c8", "struct<re:float,im:float>"), ("complex128", "c16", "struct<re:double,im:double>"),
)


@dataclass(frozen=True)
class DType:
    name: str
    code: str
    spark: str

    @property
    def numpy(self) -> np.dtype:
        return np.dtype(self.code)

    @property
    def width(self) -> int:
        return self.numpy.itemsize

    @property
    def kind(self) -> str:
        return self.numpy.kind

    @property
    def v2(self) -> str:
        """The v2 name, little-endian."""
        return ("|" if self.width == 1 or self.kind == "V" else "<") + self.code

    def fill(self, value) -> np.ndarray:
        """A JSON fill value, or one of the type itself, as an array of rank 0."""
        if isinstance(value, (np.ndarray, np.generic)) and value.dtype == self.numpy:
            return np.array(value)
        try:
            return np.array(self._fill(value), self.numpy)
        except (ValueError, OverflowError, struct.error):
            raise InvalidMetadata(f"fill value {value!r} is not a {self.name}") from None

    def _fill(self, value):
        kind = self.kind
        if kind == "b":
            if isinstance(value, (bool, np.bool_)):
                return bool(value)
        elif kind in "iu":
            n = value.whole() if isinstance(value, Number) else int(value) if isinstance(value, (int, np.integer)) and not isinstance(value, bool) else None
            info = np.iinfo(self.numpy)
            if n is not None and info.min <= n <= info.max:
                return n
        elif kind == "f":
            return _float(value, self.width)
        elif kind == "c":
            if isinstance(value, (complex, int, float)) and not isinstance(value, bool):
                return value
            if isinstance(value, (list, tuple)) and len(value) == 2:
                parts = np.array([_float(x, self.width // 2) for x in value], f"f{self.width // 2}")
                return parts.view(self.code)[0]
        elif isinstance(value, bytes) and len(value) == self.width:
            return np.frombuffer(value, self.numpy)[0]
        elif isinstance(value, (list, tuple)) and len(value) == self.width:
            raw = [x.whole() if isinstance(x, Number) else x for x in value]
            if all(isinstance(x, int) and 0 <= x <= 255 for x in raw):
                return np.frombuffer(bytes(raw), self.numpy)[0]
        raise ValueError

    def fill_json(self, fill: np.ndarray):
        """The JSON form that reads back to the same bits."""
        kind = self.kind
        if kind == "b":
            return bool(fill)
        if kind in "iu":
            return int(fill)
        if kind == "f":
            return _float_json(fill)
        if kind == "c":
            half = f"f{self.width // 2}"
            return [_float_json(x) for x in fill.reshape(1).view(half)]
        return list(fill.tobytes())

    def to_arrow(self, values: np.ndarray) -> pa.Array:
        """Flat numpy values to the Spark carrier."""
        kind = self.kind
        if kind == "V":
            return pa.array([x.tobytes() for x in values], pa.binary())
        if kind == "c":
            parts = np.ascontiguousarray(values).view(f"f{self.width // 2}").reshape(-1, 2)
            return pa.StructArray.from_arrays([pa.array(parts[:, 0]), pa.array(parts[:, 1])], ["re", "im"])
        if self.name == "uint64":
            return pa.array(values).cast(pa.decimal128(20, 0))
        wide = {"uint8": "i2", "uint16": "i4", "uint32": "i8", "float16": "f4"}.get(self.name)
        return pa.array(values.astype(wide) if wide else values)

    def from_arrow(self, column) -> np.ndarray:
        """The Spark carrier back to numpy; values that the type does not hold, and nulls, are errors."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if column.null_count:
            raise DTypeMismatch(f"null is not a {self.name}")
        if self.kind == "V":
            return np.frombuffer(b"".join(column.to_pylist()), self.numpy)
        if self.kind == "c":
            half = f"f{self.width // 2}"
            parts = [np.asarray(f).astype(half) for f in column.flatten()]
            return np.ascontiguousarray(np.stack(parts, 1)).view(self.code).ravel()
        if self.name == "uint64":
            return column.cast(pa.uint64()).to_numpy()
        values = column.to_numpy(zero_copy_only=False)
        out = values.astype(self.numpy)
        if self.kind in "iu" and not np.array_equal(out, values):
            raise DTypeMismatch(f"values outside {self.name}")
        return out


def _float(value, width: int):
    if isinstance(value, (float, int, np.floating)) and not isinstance(value, bool):
        return value
    if isinstance(value, Number):
        return float(value)
    named = {"NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
    if value in named:
        return named[value]
    if isinstance(value, str) and re.fullmatch(r"0x[0-9a-fA-F]{%d}" % (2 * width), value):
        return np.frombuffer(bytes.fromhex(value[2:])[::-1], f"<f{width}")[0]
    raise ValueError


def _float_json(x):
    if np.isnan(x):
        plain = np.array(np.nan, x.dtype)
        return "NaN" if x.tobytes() == plain.tobytes() else "0x" + x.astype(x.dtype.newbyteorder(">")).tobytes().hex()
    if np.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    return float(x)


BUILT_IN = {name: DType(name, code, spark) for name, code, spark in _TYPES}


def dtype(name: str, registry: dict[str, DType] | None = None) -> DType:
    """A type by its v3 name; ``rN`` is raw bytes of N bits."""
    if found := (registry or {}).get(name) or BUILT_IN.get(name):
        return found
    if m := re.fullmatch(r"r([0-9]+)", name):
        bits = int(m[1])
        if bits and bits % 8 == 0:
            return DType(name, f"V{bits // 8}", "binary")
    raise InvalidMetadata(f"data type {name!r} is not known")


def v2_dtype(text: str) -> tuple[DType, str]:
    """A v2 type string to its type and byte order, ``little`` or ``big``."""
    m = re.fullmatch(r"([<>|])([biufcV])([0-9]+)", text)
    if m:
        code = f"{m[2]}{m[3]}"
        found = next((t for t in BUILT_IN.values() if t.code == code), None)
        if m[2] == "V" and int(m[3]) > 0:
            found = dtype(f"r{8 * int(m[3])}")
        if found and (m[1] != "|" or found.width == 1 or found.kind == "V"):
            return found, "big" if m[1] == ">" else "little"
    raise InvalidMetadata(f"v2 data type {text!r} is not known")
