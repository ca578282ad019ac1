"""Receipts: requests and bytes that a read takes, as DataFrame aggregates over its plan.

A direct chunk is one object request. A shard with an index at its end takes its length, its index range and then
data ranges; at its start no length. Regions read near ranges as one, folds and factored reads do not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.plans import selection as S
from tesserae.plans.shards import coalesced, index_table
from tesserae.sources.arrays import Array

_COUNTS = ("object_requests", "range_requests", "length_requests", "index_bytes", "data_bytes", "bytes_read", "touched_chunks", "touched_shards", "requested_elements", "logical_bytes")


def requests(array: Array, axes: Sequence[S.Axis], coalesce: bool = True) -> DataFrame:
    """``(kind, key, start, end)`` of each request; kind is object, length, index or data. Missing objects are asked for, too."""
    d, coords = array.descriptor, [f"c{k}" for k in range(array.descriptor.rank)]
    plan = S.keyed_plan(array.spark, d, axes)
    found = array.objects(axes)
    lengths = found.select("key", "length") if found is not None else array.spark.createDataFrame([], "key string, length long")
    whole = plan.join(lengths, "key", "left").select(*coords, "key", F.col("length").alias("size"))
    request = lambda rows, kind, start, end: rows.select(F.lit(kind).alias("kind"), "key", F.expr(start).cast("long").alias("start"), F.expr(end).cast("long").alias("end"))
    if d.sharding is None or d.codecs:
        return request(whole, "object", "0", "coalesce(size, 0)")
    n = d.sharding.index_length(d.chunks)
    present = whole.where("size is not null")
    out = request(present, "index", "0", f"{n}") if d.sharding.location == "start" else request(present, "index", f"size - {n}", "size").unionByName(request(whole, "length", "0", "0"))
    if d.sharding.location == "start":
        out = out.unionByName(request(whole.where("size is null"), "index", "0", "0"))
    if found is None:
        return out
    entries = index_table(found, d.sharding, d.chunks, coords).where("offset is not null")
    shards = S.shard_plan(array.spark, d, axes).select(*[F.col(f"s{k}").alias(f"c{k}") for k in range(d.rank)], "local")
    ranges = shards.join(entries, [*coords, "local"]).join(plan.select(*coords, "key"), coords).select("key", "offset", "length")
    if coalesce:
        return out.unionByName(request(coalesced(ranges, ["key"]), "data", "start", "end"))
    return out.unionByName(request(ranges, "data", "offset", "offset + length"))


def receipt(array: Array, axes: Sequence[S.Axis], coalesce: bool = True) -> DataFrame:
    """One row: requests, bytes, touched chunks and shards, and how many bytes are read for each that was asked for."""
    d = array.descriptor
    size = F.col("end") - F.col("start")
    zero = F.lit(0).cast("long")
    part = lambda rows, **columns: rows.select(*[columns.get(c, zero).cast("long").alias(c) for c in (*_COUNTS[:5], *_COUNTS[6:9])])
    one, of = F.lit(1), lambda *kinds: F.col("kind").isin(*kinds).cast("long")
    rows = part(
        requests(array, axes, coalesce), object_requests=one, range_requests=of("index", "data"), length_requests=of("length"),
        index_bytes=of("index") * size, data_bytes=of("data", "object") * size,
    )
    rows = rows.unionByName(part(S.chunk_plan(array.spark, d, axes, inner=True), touched_chunks=one, requested_elements=F.col("elements")))
    if d.sharding:
        rows = rows.unionByName(part(S.chunk_plan(array.spark, d, axes), touched_shards=one))
    row = rows.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in rows.columns])
    row = row.select("*", (F.col("index_bytes") + F.col("data_bytes")).alias("bytes_read"), (F.col("requested_elements") * d.dtype.width).alias("logical_bytes"))
    amplification = F.coalesce(F.try_divide(F.col("bytes_read").cast("double"), F.col("logical_bytes")), F.lit(0.0)).alias("read_amplification")
    return row.select(*_COUNTS, amplification)


def reuse(log: DataFrame) -> DataFrame:
    """``(hits, misses, fetched_bytes, served_bytes)`` of a request log ``(ord, kind, key, start, end)`` with an unbounded cache.

    A request is a hit where an earlier one read the same range, or the whole object, of the key; lengths are known
    once the whole object is.
    """
    same = Window.partitionBy("key", "kind", "start", "end").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    hit = (F.count("*").over(same) > 0) | (F.max(F.when(F.col("kind") == "object", 1)).over(whole) == 1)
    size = F.col("end") - F.col("start")
    rows = log.withColumn("hit", F.coalesce(hit, F.lit(False)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        total(F.when(~F.col("hit"), size)).alias("fetched_bytes"), total(size).alias("served_bytes"),
    )
