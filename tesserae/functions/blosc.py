"""Blosc version 1 frames with Zstandard blocks."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

from tesserae.errors import CodecError

# The frame's format numbers, flag bits and limits.
VERSION, ZSTD_VERSION, ZSTD_FORMAT = 2, 1, 4
SHUFFLED, COPIED, BITS, WHOLE_BLOCKS = 1, 2, 4, 16
HEADER = 16


def _bit_planes(block: bytes, size: int, back: bool) -> bytes:
    """Bit transposition of all elements in multiples of eight; the rest stays."""
    n = len(block) // size // 8 * 8
    if not n:
        return block
    head = np.frombuffer(block, np.uint8, n * size)
    if back:
        bits = np.unpackbits(head.reshape(size * 8, n // 8), axis=1, bitorder="little")
        out = np.packbits(bits.T, axis=1, bitorder="little")
    else:
        bits = np.unpackbits(head.reshape(n, size), axis=1, bitorder="little")
        out = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return out.tobytes() + block[n * size :]


def _planes(block: bytes, size: int, back: bool) -> bytes:
    n = len(block) // size
    head = np.frombuffer(block, np.uint8, n * size)
    head = head.reshape(size, n).T if back else head.reshape(n, size).T
    return head.tobytes() + block[n * size :]


def decompress(frame: bytes, limit: int) -> bytes:
    if len(frame) < HEADER:
        raise CodecError("blosc frame is shorter than its header")
    version, _, flags, size, total, block, length = struct.unpack("<4B3I", frame[:HEADER])
    if length != len(frame):
        raise CodecError(f"blosc frame declares {length} bytes, not {len(frame)}")
    if total > limit:
        raise CodecError(f"decoded length {total} exceeds {limit}")
    if flags & COPIED:
        if length != HEADER + total:
            raise CodecError("blosc frame of copied bytes has another length")
        return frame[HEADER:]
    if flags >> 5 != ZSTD_FORMAT:
        raise CodecError(f"blosc format {flags >> 5} is not Zstandard")
    if total and (not block or not size):
        raise CodecError("blosc frame has no block size")
    out, n = [], -(-total // block) if block else 0
    starts = struct.unpack(f"<{n}I", frame[HEADER : HEADER + 4 * n]) if len(frame) >= HEADER + 4 * n else None
    if starts is None:
        raise CodecError("blosc frame is truncated")
    for k, at in enumerate(starts):
        want = min(block, total - k * block)
        split = size if not flags & WHOLE_BLOCKS and want == block and block % size == 0 and size <= 16 and block // size >= 128 else 1
        parts = []
        for _ in range(split):
            (n_in,) = struct.unpack("<i", frame[at : at + 4]) if at + 4 <= length else (-1,)
            piece = frame[at + 4 : at + 4 + n_in]
            if n_in <= 0 or len(piece) != n_in:
                raise CodecError("blosc block is truncated")
            at += 4 + n_in
            try:
                parts.append(piece if n_in == want // split else zstandard.ZstdDecompressor().decompress(piece, max_output_size=want // split))
            except zstandard.ZstdError as e:
                raise CodecError(str(e)) from None
        data = b"".join(parts)
        if len(data) != want:
            raise CodecError(f"blosc block of {len(data)} bytes, not {want}")
        if flags & BITS:
            data = _bit_planes(data, size, True)
        elif flags & SHUFFLED and size > 1:
            data = _planes(data, size, True)
        out.append(data)
    return b"".join(out)


def compress(data: bytes, level: int, shuffle: str, size: int, block: int) -> bytes:
    block = min(block or 1 << 18, max(len(data), 1)) // size * size or max(len(data), 1)
    flags = (ZSTD_FORMAT << 5) | WHOLE_BLOCKS | {"noshuffle": 0, "shuffle": SHUFFLED, "bitshuffle": BITS}[shuffle]
    parts = []
    for at in range(0, len(data), block):
        raw = data[at : at + block]
        if shuffle != "noshuffle":
            raw = (_planes if shuffle == "shuffle" else _bit_planes)(raw, size, False)
        packed = zstandard.ZstdCompressor(level=max(1, 2 * level - 1)).compress(raw) if level else raw
        parts.append(packed if len(packed) < len(raw) else raw)
    starts, at = [], HEADER + 4 * len(parts)
    for p in parts:
        starts.append(at)
        at += 4 + len(p)
    if at >= HEADER + len(data) or not data:
        head = struct.pack("<4B3I", VERSION, ZSTD_VERSION, flags | COPIED, size, len(data), block, HEADER + len(data))
        return head + data
    head = struct.pack("<4B3I", VERSION, ZSTD_VERSION, flags, size, len(data), block, at)
    return head + struct.pack(f"<{len(starts)}I", *starts) + b"".join(struct.pack("<i", len(p)) + p for p in parts)
