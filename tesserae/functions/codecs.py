"""Codecs of chunks, as small numpy helpers that run inside Spark tasks.

A chain is array codecs, one codec from array to bytes, then byte codecs. Each codec is a frozen value that can be
pickled to the executors; encoding runs the chain forwards, decoding backwards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache
from math import prod

import numpy as np

from tesserae.errors import CodecError, InvalidMetadata, Unsupported
from tesserae.functions.dtypes import DType, v2_dtype
from tesserae.functions.strict_json import whole

#: Decoded bytes of one stage, at most.
MAX_DECODED = 512 << 20


class Codec:
    name = ""
    kind = "bytes"  # array, serial or bytes

    def config(self) -> dict:
        return {}

    def fixed_length(self, n: int) -> int | None:
        """Encoded length of n bytes where it does not depend on them."""
        return None


@dataclass(frozen=True)
class Bytes(Codec):
    """Values to bytes in one byte order."""

    endian: str | None = "little"
    name, kind = "bytes", "serial"

    def config(self):
        return {"endian": self.endian} if self.endian else {}

    def _order(self, dtype: DType) -> np.dtype:
        return dtype.numpy.newbyteorder(">" if self.endian == "big" else "<") if dtype.width > 1 and dtype.kind != "V" else dtype.numpy

    def encode(self, values: np.ndarray, dtype: DType) -> bytes:
        return np.ascontiguousarray(values).astype(self._order(dtype)).tobytes()

    def decode(self, data: bytes, shape: Sequence[int], dtype: DType) -> np.ndarray:
        if len(data) != prod(shape) * dtype.width:
            raise CodecError(f"chunk of {len(data)} bytes where {prod(shape) * dtype.width} were expected")
        if dtype.kind == "b" and data and max(data) > 1:
            raise CodecError("boolean byte other than 0 and 1")
        return np.frombuffer(data, self._order(dtype)).astype(dtype.numpy).reshape(shape)


@dataclass(frozen=True)
class Transpose(Codec):
    """Axes in another order."""

    order: tuple[int, ...] = ()
    name, kind = "transpose", "array"

    def config(self):
        return {"order": list(self.order)}

    def encode(self, values: np.ndarray, dtype: DType) -> np.ndarray:
        return values.transpose(self.order)

    def decode(self, values: np.ndarray, dtype: DType) -> np.ndarray:
        return values.transpose(np.argsort(self.order))

    def shape(self, shape: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(shape[k] for k in self.order)


@dataclass(frozen=True)
class Delta(Codec):
    """Differences along the flattened chunk, stored as ``astype``; the first value stays."""

    dtype: DType = None
    astype: DType = None
    name, kind = "delta", "array"

    def config(self):
        return {"dtype": self.dtype.v2, "astype": self.astype.v2}

    def encode(self, values: np.ndarray, dtype: DType) -> np.ndarray:
        flat = values.ravel()
        out = flat.astype(self.astype.numpy)
        if len(flat) > 1:
            with np.errstate(over="ignore", invalid="ignore"):
                step = flat[1:] != flat[:-1] if dtype.kind == "b" else flat[1:] - flat[:-1]
                out[1:] = step.astype(self.astype.numpy)
        return out.reshape(values.shape)

    def decode(self, values: np.ndarray, dtype: DType) -> np.ndarray:
        flat = values.ravel().astype(self.dtype.numpy)
        if self.dtype.kind == "b":
            return np.logical_xor.accumulate(flat).reshape(values.shape)
        with np.errstate(over="ignore", invalid="ignore"):  # accumulate rounds (or wraps) in the type at every step
            return np.add.accumulate(flat, dtype=self.dtype.numpy).reshape(values.shape)

    def shape(self, shape: tuple[int, ...]) -> tuple[int, ...]:
        return shape


@dataclass(frozen=True)
class Shuffle(Codec):
    """Byte planes: first bytes of all elements, then second ones."""

    elementsize: int = 1
    name = "shuffle"

    def config(self):
        return {"elementsize": self.elementsize}

    def encode(self, data: bytes) -> bytes:
        if len(data) % self.elementsize:
            raise CodecError(f"{len(data)} bytes are not whole elements of {self.elementsize}")
        return np.frombuffer(data, np.uint8).reshape(-1, self.elementsize).T.tobytes()

    def decode(self, data: bytes, limit: int) -> bytes:
        if len(data) % self.elementsize:
            raise CodecError(f"{len(data)} bytes are not whole elements of {self.elementsize}")
        return np.frombuffer(data, np.uint8).reshape(self.elementsize, -1).T.tobytes()

    def fixed_length(self, n: int) -> int:
        return n


def _inflate(data: bytes, limit: int, wbits: int) -> bytes:
    out, rest = b"", data
    try:
        while rest:
            d = zlib.decompressobj(wbits)
            out += d.decompress(rest, limit + 1 - len(out))
            if len(out) > limit:
                raise CodecError(f"decoded length exceeds {limit}")
            if not d.eof:
                raise CodecError("truncated stream")
            rest = d.unused_data
            if rest and wbits == 15:
                raise CodecError("bytes after the stream")
    except zlib.error as e:
        raise CodecError(str(e)) from None
    if not data:
        raise CodecError("truncated stream")
    return out


@dataclass(frozen=True)
class Gzip(Codec):
    level: int = 5
    name = "gzip"

    def config(self):
        return {"level": self.level}

    def encode(self, data: bytes) -> bytes:
        c = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()

    def decode(self, data: bytes, limit: int) -> bytes:
        return _inflate(data, limit, 31)


@dataclass(frozen=True)
class Zlib(Codec):
    level: int = 1
    name = "zlib"

    def config(self):
        return {"level": self.level}

    def encode(self, data: bytes) -> bytes:
        return zlib.compress(data, self.level)

    def decode(self, data: bytes, limit: int) -> bytes:
        return _inflate(data, limit, 15)


@dataclass(frozen=True)
class Zstd(Codec):
    level: int = 0
    checksum: bool = False
    name = "zstd"

    def config(self):
        return {"level": self.level, "checksum": self.checksum}

    def encode(self, data: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=self.level or 3, write_checksum=self.checksum).compress(data)

    def decode(self, data: bytes, limit: int) -> bytes:
        import zstandard

        try:
            size = zstandard.frame_content_size(data)
            if size < 0:
                raise CodecError("zstd frame does not declare its size")
            if size > limit:
                raise CodecError(f"decoded length {size} exceeds {limit}")
            return zstandard.ZstdDecompressor().decompress(data, max_output_size=max(size, 1))
        except zstandard.ZstdError as e:
            raise CodecError(str(e)) from None


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


def _apply(columns: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Remainders through a matrix over two elements, one column for each bit."""
    bits = (crc[..., None] >> np.arange(32, dtype=np.uint32)) & 1
    return np.bitwise_xor.reduce(np.where(bits == 1, columns, 0), axis=-1).astype(np.uint32)


def _zeros(n: int) -> np.ndarray:
    """The matrix that appends n zero bytes, by squaring that of one."""
    bit = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
    out, step = bit, _crc_table()[bit & 0xFF] ^ (bit >> 8)
    while n:
        out = _apply(step, out) if n & 1 else out
        step, n = _apply(step, step), n >> 1
    return out


def crc32c(data: bytes) -> int:
    """CRC-32C. Data are cut into lanes that are read side by side and joined in pairs; zeros in front change nothing."""
    table = _crc_table()
    lanes = 1 << (len(data).bit_length() // 2)
    width = -(-len(data) // lanes)
    crc = np.zeros(lanes, np.uint32)
    for byte in np.ascontiguousarray(np.frombuffer(data.rjust(width * lanes, b"\0"), np.uint8).reshape(lanes, width).T):
        crc = table[(crc ^ byte) & 0xFF] ^ (crc >> 8)
    shift = _zeros(width)
    while len(crc) > 1:
        crc = _apply(shift, crc[0::2]) ^ crc[1::2]
        shift = _apply(shift, shift)
    start = _apply(_zeros(len(data)), np.array([0xFFFFFFFF], np.uint32))
    return int(crc[0] ^ start[0]) ^ 0xFFFFFFFF


@dataclass(frozen=True)
class Crc32c(Codec):
    """Four bytes of CRC-32C behind the data."""

    name = "crc32c"

    def encode(self, data: bytes) -> bytes:
        return data + struct.pack("<I", crc32c(data))

    def decode(self, data: bytes, limit: int) -> bytes:
        if len(data) < 4 or struct.pack("<I", crc32c(data[:-4])) != data[-4:]:
            raise CodecError("CRC-32C differs")
        return data[:-4]

    def fixed_length(self, n: int) -> int:
        return n + 4


@dataclass(frozen=True)
class Blosc(Codec):
    """Blosc frames with Zstandard inside."""

    cname: str = "zstd"
    clevel: int = 5
    shuffle: str = "shuffle"
    typesize: int = 1
    blocksize: int = 0
    name = "blosc"

    def config(self):
        return {"cname": self.cname, "clevel": self.clevel, "shuffle": self.shuffle, "typesize": self.typesize, "blocksize": self.blocksize}

    def encode(self, data: bytes) -> bytes:
        from tesserae.functions.blosc import compress

        return compress(data, self.clevel, self.shuffle, self.typesize, self.blocksize)

    def decode(self, data: bytes, limit: int) -> bytes:
        from tesserae.functions.blosc import decompress

        return decompress(data, limit)


def _level(config: dict, low: int, high: int, default: int | None = None) -> int:
    if "level" not in config and default is not None:
        return default
    n = whole(config.get("level"), "level", low)
    if n > high:
        raise InvalidMetadata(f"level {n} is not from {low} to {high}")
    return n


def _bytes(config: dict, dtype: DType) -> Bytes:
    endian = config.get("endian")
    if endian not in (None, "little", "big"):
        raise InvalidMetadata(f"endian {endian!r}")
    if endian is None and dtype.width > 1 and dtype.kind != "V":
        raise InvalidMetadata(f"codec bytes needs endian for {dtype.name}")
    return Bytes(endian)


def _transpose(config: dict, dtype: DType) -> Transpose:
    order = tuple(whole(x, "order") for x in config.get("order", ()))
    if sorted(order) != list(range(len(order))):
        raise InvalidMetadata(f"order {list(order)} is not a permutation")
    return Transpose(order)


def _delta(config: dict, dtype: DType) -> Delta:
    own = v2_dtype(config["dtype"])[0] if "dtype" in config else dtype
    stored = v2_dtype(config["astype"])[0] if "astype" in config else own
    family = lambda t: "i" if t.kind in "iu" else t.kind
    if own.name != dtype.name:
        raise InvalidMetadata(f"delta of {own.name} in an array of {dtype.name}")
    if own.kind not in "biuf" or family(own) != family(stored):
        raise InvalidMetadata(f"delta from {own.name} to {stored.name}")
    return Delta(own, stored)


def _blosc(config: dict, dtype: DType) -> Blosc:
    if config.get("cname") != "zstd":
        raise Unsupported(f"blosc compressor {config.get('cname')!r}")
    if config.get("shuffle") not in ("noshuffle", "shuffle", "bitshuffle"):
        raise InvalidMetadata(f"blosc shuffle {config.get('shuffle')!r}")
    if config["shuffle"] != "noshuffle" and "typesize" not in config:
        raise InvalidMetadata("blosc with shuffle needs typesize")
    size, level = whole(config.get("typesize", 1), "typesize", 1), whole(config.get("clevel"), "clevel")
    if size > 255 or level > 9:
        raise InvalidMetadata("blosc typesize is at most 255 and clevel at most 9")
    return Blosc("zstd", level, config["shuffle"], size, whole(config.get("blocksize", 0), "blocksize"))


Maker = Callable[[dict, DType], Codec]
#: Codecs by name; a registry of one's own has further makers.
BUILT_IN: dict[str, Maker] = {
    "bytes": _bytes,
    "transpose": _transpose,
    "delta": _delta,
    "shuffle": lambda c, t: Shuffle(whole(c.get("elementsize", t.width), "elementsize", 1)),
    "gzip": lambda c, t: Gzip(_level(c, 0, 9)),
    "zlib": lambda c, t: Zlib(_level(c, -1, 9)),
    "crc32c": lambda c, t: Crc32c(),
    "zstd": lambda c, t: Zstd(_level(c, -131072, 22, 0), bool(c.get("checksum", False))),
    "blosc": _blosc,
}


def checked_chain(codecs: Sequence[Codec], shape: tuple[int, ...], dtype: DType) -> tuple[Codec, ...]:
    """The chain, if its kinds are in order and its array codecs fit the shape."""
    kinds = "".join({"array": "a", "serial": "s", "bytes": "b"}[c.kind] for c in codecs)
    if kinds.strip("a").rstrip("b") != "s" or "a" in kinds.lstrip("a") or kinds.count("s") != 1:
        raise InvalidMetadata(f"codecs {[c.name for c in codecs]} are not array codecs, one to bytes, byte codecs")
    for c in codecs:
        if isinstance(c, Transpose) and len(c.order) != len(shape):
            raise InvalidMetadata(f"order {list(c.order)} has another rank than {list(shape)}")
    return tuple(codecs)


def encode_chunk(values: np.ndarray, codecs: Sequence[Codec], dtype: DType) -> bytes:
    data, kind = values, dtype
    for c in codecs:
        if c.kind == "array":
            data = c.encode(data, kind)
            kind = c.astype if isinstance(c, Delta) else kind
        elif c.kind == "serial":
            data = c.encode(data, kind)
        else:
            data = c.encode(data)
    return data


def decode_chunk(data: bytes, shape: Sequence[int], codecs: Sequence[Codec], dtype: DType) -> np.ndarray:
    """A chunk of ``shape``; intermediate lengths are bounded, the final one is exact."""
    steps, kind, at = [], dtype, tuple(shape)
    for c in codecs:
        steps.append((c, kind, at))
        if c.kind == "array":
            at, kind = c.shape(at), c.astype if isinstance(c, Delta) else kind
    out = data
    for c, kind, at in reversed(steps):
        if c.kind == "bytes":
            out = c.decode(out, MAX_DECODED)
        elif c.kind == "serial":
            out = c.decode(out, at, kind)
        else:
            out = c.decode(out, kind)
    return out


def decode_bytes(data: bytes, codecs: Sequence[Codec], limit: int = MAX_DECODED) -> bytes:
    for c in reversed(codecs):
        data = c.decode(data, limit)
    return data


def encode_bytes(data: bytes, codecs: Sequence[Codec]) -> bytes:
    for c in codecs:
        data = c.encode(data)
    return data


def typed(codecs: Sequence[Codec], dtype: DType) -> tuple[Codec, ...]:
    """Codecs of a specification with what they leave to the array's type filled in."""
    out = []
    for c in codecs:
        if isinstance(c, Delta) and c.dtype is None:
            c = replace(c, dtype=dtype, astype=c.astype or dtype)
        if isinstance(c, Bytes) and (dtype.width == 1 or dtype.kind == "V"):
            c = Bytes(None)
        dtype = c.astype if isinstance(c, Delta) else dtype
        out.append(c)
    return tuple(out)
