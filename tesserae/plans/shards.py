"""Shards: their index as bytes and as a DataFrame, and the byte ranges a read of them takes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.errors import CodecError, ResourceLimit
from tesserae.functions.codecs import decode_bytes, encode_bytes
from tesserae.plans.descriptor import Sharding

# Both numbers of an inner chunk without data, and how near ranges are read as one.
EMPTY = (1 << 64) - 1
MAX_GAP, MAX_SPAN = 4096, 8 << 20


def shard_slices(s: Sharding, shard: Sequence[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(number, origin inside the shard) of the inner chunks in C order."""
    for local, at in enumerate(np.ndindex(*s.counts(shard))):
        yield local, tuple(int(a) * n for a, n in zip(at, s.inner))


def index_range(size: int, s: Sharding, shard: Sequence[int]) -> tuple[int, int]:
    """Start and length of the index in a shard of ``size`` bytes."""
    n = s.index_length(shard)
    if size < n:
        raise CodecError(f"shard of {size} bytes is shorter than its index of {n}")
    return (0 if s.location == "start" else size - n), n


def decode_index(content: bytes, s: Sharding, shard: Sequence[int]) -> list[tuple[int | None, int | None]]:
    """(offset, length) by inner chunk of a whole shard, (None, None) without data."""
    start, n = index_range(len(content), s, shard)
    return index_entries(content[start : start + n], len(content), s)


def near_ranges(ranges: Sequence[tuple[int, int]], max_gap: int = MAX_GAP, max_span: int = MAX_SPAN) -> list[tuple[int, int]]:
    """(start, end) of ranges (offset, length) of one object, near ones read as one."""
    out: list[tuple[int, int]] = []
    for offset, length in sorted(ranges):
        end = max(out[-1][1], offset + length) if out else 0
        if out and offset - out[-1][1] <= max_gap and end - out[-1][0] <= max_span:
            out[-1] = (out[-1][0], end)
        else:
            out.append((offset, offset + length))
    return out


def index_entries(content: bytes, size: int, s: Sharding) -> list[tuple[int | None, int | None]]:
    """The entries of an encoded index of a shard of ``size`` bytes."""
    raw = decode_bytes(content, s.index_codecs[1:])
    out = []
    for offset, length in np.frombuffer(raw, "<u8").reshape(-1, 2).tolist():
        if offset == EMPTY and length == EMPTY:
            out.append((None, None))
        elif EMPTY in (offset, length):
            raise CodecError("shard index entry is half empty")
        elif offset >= 1 << 63 or length >= 1 << 63:
            raise ResourceLimit("shard index entry", (1 << 63) - 1, max(offset, length))
        elif offset + length > size:
            raise CodecError("shard index entry lies outside the shard")
        else:
            out.append((offset, length))
    return out


def assemble(parts: Sequence[bytes | None], s: Sharding, shard: Sequence[int]) -> bytes | None:
    """The shard of encoded inner chunks in C order; without any there is no object."""
    if not any(p is not None for p in parts):
        return None
    n = s.index_length(shard)
    at, entries = n if s.location == "start" else 0, []
    for p in parts:
        entries += (EMPTY, EMPTY) if p is None else (at, len(p))
        at += len(p or b"")
    index = encode_bytes(np.array(entries, "<u8").tobytes(), s.index_codecs[1:])
    body = b"".join(p for p in parts if p is not None)
    return index + body if s.location == "start" else body + index


def index_table(objects: DataFrame, s: Sharding, shard: tuple[int, ...], coords: Sequence[str], outer: Sequence = ()) -> DataFrame:
    """``(c0.., local, offset, length)`` of the shards' inner chunks; offset and length are null without data."""
    from tesserae.functions.codecs import decode_bytes as unpack

    schema = ", ".join([*(f"{c} long" for c in coords), "local long", "offset long", "length long"])

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                index = decode_index(unpack(row["content"], outer), s, shard)
                n = len(index)
                at = [pa.array([row[c]] * n, pa.int64()) for c in coords]
                yield pa.RecordBatch.from_arrays(
                    [*at, pa.array(range(n), pa.int64()), pa.array([o for o, _ in index], pa.int64()), pa.array([x for _, x in index], pa.int64())],
                    [*coords, "local", "offset", "length"],
                )

    return objects.select(*coords, "content").mapInArrow(rows, schema)


def coalesced(ranges: DataFrame, by: Sequence[str], max_gap: int = MAX_GAP, max_span: int = MAX_SPAN) -> DataFrame:
    """``(by.., start, end, members)``: byte ranges ``(by.., offset, length)`` of an object, near ones read as one.

    Ranges are taken in the order of their offsets; one joins the range before while the gap and the span of both
    stay within the limits. A fold over the sorted ranges of each object, of which a shard has one for each inner chunk.
    """
    pair = F.struct("offset", "length")
    kind = "array<struct<start:bigint,end:bigint,members:bigint>>"

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        end = x["offset"] + x["length"]
        grown = F.greatest(last["end"], end)
        joins = (F.size(acc) > 0) & (x["offset"] - last["end"] <= max_gap) & (grown - last["start"] <= max_span)
        one = lambda a, b, n: F.array(F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), n.cast("long").alias("members")))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), one(last["start"], grown, last["members"] + 1))).otherwise(
            F.concat(acc, one(x["offset"], end, F.lit(1)))
        )

    grouped = ranges.groupBy(*by).agg(F.array_sort(F.collect_list(pair)).alias("ranges"))
    merged = F.aggregate("ranges", F.array().cast(kind), step)
    return grouped.select(*by, F.explode(merged).alias("r")).select(*by, "r.start", "r.end", "r.members")
