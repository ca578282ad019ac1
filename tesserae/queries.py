"""Queries over arrays made from the driver's tables, each a round trip through a store, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import codecs as C
from tesserae.functions.dtypes import dtype
from tesserae.functions.geometry import chunk_key_column, unravel
from tesserae.operators import fold, hierarchy, receipts, relational, write
from tesserae.plans import selection as S
from tesserae.plans.descriptor import ArrayDescriptor, Sharding
from tesserae.plans.shards import coalesced
from tesserae.sources.arrays import Array, open_array
from tesserae.sources.objects import Store, scratch

LITTLE = C.Bytes("little")


def fresh(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{scratch(spark, 'arrays-')}/arrays-{uuid.uuid4().hex}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _embeddings(spark: SparkSession, sf_dir: str, **changes) -> Array:
    rows = _table(spark, sf_dir, "embeddings")
    n = rows.agg(F.max("vec_id")).first()[0] + 1
    d = ArrayDescriptor((n, 64), (64, 16), dtype("float32"), 0, names=("vector", "component"))
    return write.create_and_open(write.cells_of_rows(rows, "vec_id", "embedding"), fresh(spark), replace(d, **changes))


def _column(spark: SparkSession, sf_dir: str, table: str, key: str, value: str, kind: str, chain: tuple, chunk: int = 4096) -> Array:
    rows = _table(spark, sf_dir, table).select(F.col(key).cast("long").alias("i0"), F.col(value).alias("v"))
    n = rows.agg(F.max("i0")).first()[0] + 1
    return write.create_and_open(rows, fresh(spark), ArrayDescriptor((n,), (chunk,), dtype(kind), 0, chain))


def q_read_all(spark, sf_dir):
    return _embeddings(spark, sf_dir).read_all()


def q_region_direct(spark, sf_dir):
    return _embeddings(spark, sf_dir).region((10, 4), (3, 4))


def q_region_border(spark, sf_dir):
    a = _embeddings(spark, sf_dir)
    return a.region((a.descriptor.shape[0] - 5, 0), (5, 64))


POINTS = ((499, 63), (0, 0), (64, 16), (499, 63), (63, 15), (3, 40), (64, 16))


def q_points(spark, sf_dir):
    return _embeddings(spark, sf_dir).points(POINTS)


def q_factored(spark, sf_dir):
    return _embeddings(spark, sf_dir).select(S.Indices([3, 1, 1, 499]), S.Slice(0, 64, 5))


def _sparse(spark, sf_dir, chunk: int) -> tuple[DataFrame, ArrayDescriptor]:
    """The values of all events, at twice their numbers: every other cell, and of chunks of one every other chunk, is empty."""
    rows = _table(spark, sf_dir, "events")
    n = rows.agg(F.max("event_id") + 1).first()[0]
    cells = rows.select((F.col("event_id").cast("long") * 2).alias("i0"), F.col("value").alias("v"))
    return cells, ArrayDescriptor((2 * n,), (chunk,), dtype("float64"), -1)


def q_fill_sparse(spark, sf_dir):
    """Whole table; chunks of users who have no events in a stretch stay empty."""
    cells, d = _by_user(spark, sf_dir)
    return write.create_and_open(cells, fresh(spark), d).read_all()


def _by_user(spark, sf_dir) -> tuple[DataFrame, ArrayDescriptor]:
    """The number of events by user and hour of the stream, sparse by itself."""
    rows = _table(spark, sf_dir, "events")
    users, events = rows.agg(F.max("user_id") + 1, F.max("event_id") + 1).first()
    cells = rows.groupBy(F.col("user_id").cast("long").alias("i0"), F.expr("event_id div 200").cast("long").alias("i1")).agg(F.count("*").cast("int").alias("v"))
    return cells, ArrayDescriptor((users, -(-events // 200)), (8, 5), dtype("int32"), -1)


def q_write_receipt(spark, sf_dir):
    cells, d = _by_user(spark, sf_dir)
    r = write.create_array(cells, fresh(spark), d)
    return spark.createDataFrame([(r.n_objects, r.n_bytes, r.encoded_chunks, r.omitted_chunks)], "objects long, bytes long, encoded long, omitted long")


def q_transpose(spark, sf_dir):
    return _embeddings(spark, sf_dir, codecs=(C.Transpose((1, 0)), LITTLE)).read_all()


def q_delta_int(spark, sf_dir):
    return _column(spark, sf_dir, "events", "event_id", "user_id", "int64", (C.Delta(), LITTLE), 1024).read_all()


def q_delta_encoded(spark, sf_dir):
    cells = _table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("i0"), F.col("user_id").cast("long").alias("v"))
    return relational.delta_encoded(cells, (64,))


def q_delta_decoded(spark, sf_dir):
    return relational.delta_decoded(q_delta_encoded(spark, sf_dir), (64,))


def _prices(*chain):
    def query(spark, sf_dir):
        return _column(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "float64", (LITTLE, *chain)).read_all()

    return query


q_shuffle_gzip = _prices(C.Shuffle(8), C.Gzip(1))
q_zlib = _prices(C.Zlib(6))
q_zstd = _prices(C.Zstd(3, True))
q_crc32c = _prices(C.Crc32c())
q_blosc = _prices(C.Blosc("zstd", 3, "bitshuffle", 8, 0))


def q_big_endian_i2(spark, sf_dir):
    return _column(spark, sf_dir, "nation", "n_nationkey", "n_nationkey", "int16", (C.Bytes("big"),), 7).read_all()


def _sharded(location: str, outer: tuple = ()):
    def query(spark, sf_dir):
        sharding = Sharding((64, 16), (LITTLE, C.Zlib(1)), location=location)
        return _embeddings(spark, sf_dir, chunks=(192, 64), sharding=sharding, codecs=outer).read_all()

    return query


q_shard_end, q_shard_start, q_shard_outer_gzip = _sharded("end"), _sharded("start"), _sharded("end", (C.Gzip(1),))


def q_v2_c(spark, sf_dir):
    return _embeddings(spark, sf_dir, zarr_format=2, separator=".", codecs=(LITTLE, C.Zlib(1))).read_all()


def q_v2_f(spark, sf_dir):
    return _embeddings(spark, sf_dir, zarr_format=2, separator="/", codecs=(C.Transpose((1, 0)), LITTLE, C.Shuffle(4), C.Gzip(1))).read_all()


def _region_of(n: int) -> tuple[ArrayDescriptor, tuple]:
    d = ArrayDescriptor((n, 64), (64, 16), dtype("float32"), 0)
    return d, S.region(d.shape, (60, 10), (200, 40))


def q_chunk_plan(spark, sf_dir):
    d, axes = _region_of(_table(spark, sf_dir, "embeddings").count())
    return S.chunk_plan(spark, d, axes).select("c0", "c1", "elements")


def q_factored_plan(spark, sf_dir):
    d, _ = _region_of(_table(spark, sf_dir, "embeddings").count())
    axes = S.checked(d.shape, [S.Slice(3, 480, 100), S.Indices([40, 1, 40, 63])])
    return S.chunk_plan(spark, d, axes).select("c0", "c1", "elements")


def q_shard_plan(spark, sf_dir):
    d, axes = _region_of(_table(spark, sf_dir, "embeddings").count())
    d = replace(d, chunks=(192, 64), sharding=Sharding((64, 16)), codecs=())
    return S.shard_plan(spark, d, axes).groupBy("s0", "s1").agg(F.count("*").alias("inner_chunks"), F.sum("elements").alias("elements"))


def q_chunk_keys(spark, sf_dir):
    grid = spark.range(8 * 4).select(*unravel("id", (8, 4), "c"))
    keys = [chunk_key_column(["c0", "c1"], e, s).alias(n) for n, e, s in (("slash", "default", "/"), ("dot", "default", "."), ("v2_dot", "v2", "."), ("v2_slash", "v2", "/"))]
    return grid.select("c0", "c1", *keys)


def q_coalesce(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    rows = _table(spark, sf_dir, "orders").select((k / 5000).cast("long").alias("object"), (k * 100 + F.expr("o_orderkey div 50") * 10000).cast("long").alias("offset"), F.lit(60).cast("long").alias("length"))
    return coalesced(rows, ["object"]).select("object", "start", "end", "members")


def q_receipt_region(spark, sf_dir):
    a = _embeddings(spark, sf_dir)
    return receipts.receipt(a, S.region(a.descriptor.shape, (10, 4), (100, 20)))


EVIDENCE = {
    "direct-balanced": dict(chunks=(16, 16, 8, 8)),
    "direct-volume": dict(chunks=(32, 32, 16, 1)),
    "sharded-balanced": dict(chunks=(32, 32, 16, 16), sharding=Sharding((16, 16, 8, 8)), codecs=()),
}
WORKLOADS = {
    "volume": ((0, 0, 0, 8), (32, 32, 16, 1)), "movie-16": ((0, 0, 0, 16), (32, 32, 16, 16)),
    "aligned-roi": ((16, 16, 8, 16), (16, 16, 8, 8)), "voxel-series": ((10, 10, 5, 0), (1, 1, 1, 64)),
}


def evidence_array(spark, layout: str) -> Array:
    d = ArrayDescriptor((32, 32, 16, 64), (1,) * 4, dtype("int16"), 0)
    d = replace(d, **EVIDENCE[layout])
    cells = spark.range(1 << 20).select(*unravel("id", d.shape, "i"), (F.col("id") * 17 % 1024).cast("smallint").alias("v"))
    return write.create_and_open(cells, fresh(spark), d)


def q_evidence(spark, sf_dir):
    """Receipts of three layouts and four workloads."""
    out = None
    for layout in EVIDENCE:
        a = evidence_array(spark, layout)
        for name, box in WORKLOADS.items():
            row = receipts.receipt(a, S.region(a.descriptor.shape, *box)).select(F.lit(layout).alias("layout"), F.lit(name).alias("workload"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def q_cache_stats(spark, sf_dir):
    """Two equal reads through a cache: the second fetches nothing."""
    out = None
    for layout in ("direct-balanced", "sharded-balanced"):
        a = evidence_array(spark, layout)
        log = receipts.requests(a, S.region(a.descriptor.shape, *WORKLOADS["volume"]))
        twice = log.withColumn("ord", F.lit(1)).unionByName(log.withColumn("ord", F.lit(2)))
        row = receipts.reuse(twice).select(F.lit(layout).alias("layout"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def q_hierarchy(spark, sf_dir):
    root = fresh(spark)
    write.create_group(spark, root, attributes={"title": "root"})
    write.create_group(spark, root, "derived")
    d = ArrayDescriptor((3,), (2,), dtype("int32"), 7)
    write.create_fill_array(spark, root, d, "derived/mask")
    write.create_fill_array(spark, root, d, "bold")
    return hierarchy.nodes(spark, root)


def q_cell_stats(spark, sf_dir):
    cells = _embeddings(spark, sf_dir).read_all()
    v = F.col("v").cast("double")
    return cells.groupBy("i1").agg(F.round(F.avg(v), 9).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"))


def q_half_floats(spark, sf_dir):
    """Sizes of parts as half floats."""
    return _column(spark, sf_dir, "part", "p_partkey", "p_size", "float16", (LITTLE, C.Zlib(1))).read_all()


def q_delta_bool(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("i0"), (F.col("user_id") % 2 == 1).alias("v"))
    n = rows.agg(F.max("i0")).first()[0] + 1
    return write.create_and_open(rows, fresh(spark), ArrayDescriptor((n,), (512,), dtype("bool"), False, (C.Delta(), LITTLE))).read_all()


def q_delta_float(spark, sf_dir):
    """Values in quarters, whose differences are exact."""
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("i0"), (F.floor(F.col("value") * 4) / 4).alias("v"))
    n = rows.agg(F.max("i0")).first()[0] + 1
    return write.create_and_open(rows, fresh(spark), ArrayDescriptor((n,), (1024,), dtype("float64"), 0, (C.Delta(), LITTLE, C.Gzip(1)))).read_all()


def q_object_digests(spark, sf_dir):
    """Digests of the objects of an array of letters, a byte each."""
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("i0"), (F.col("user_id") % 26 + 65).cast("smallint").alias("v"))
    n = rows.agg(F.max("i0")).first()[0] + 1
    return write.create_array(rows, fresh(spark), ArrayDescriptor((n,), (1000,), dtype("uint8"), 0)).objects.select("key", "length", "sha256")


def q_v2_blosc(spark, sf_dir):
    return _embeddings(spark, sf_dir, zarr_format=2, separator=".", codecs=(LITTLE, C.Blosc("zstd", 3, "shuffle", 4, 0))).read_all()


def q_datasource(spark, sf_dir):
    """An array as a table of ``format("tesserae")``."""
    from tesserae.sources.datasource import register

    a = _embeddings(spark, sf_dir)
    register(spark)
    return spark.read.format("tesserae").load(f"{Store(spark, a.root).root}/{a.path}".rstrip("/")).select("i0", "i1", "v")


def q_region_wide(spark, sf_dir):
    """More than 256 chunks of an axis, of which only the touched are opened."""
    return _embeddings(spark, sf_dir, chunks=(1, 64)).region((100, 0), (290, 64))


def q_shard_inner(spark, sf_dir):
    """A box of inner chunks, read by their ranges."""
    return _embeddings(spark, sf_dir, chunks=(192, 64), sharding=Sharding((64, 16), (LITTLE, C.Zlib(1))), codecs=()).region((10, 4), (183, 24))


def q_fold_stop(spark, sf_dir):
    """Cells of the first two chunks; the fold then stops."""
    a = _embeddings(spark, sf_dir)
    seen: list[pa.Table] = []

    def step(state, table):
        seen.append(table)
        return state + len(table), len(seen) < 2

    total, r = fold.fold_chunks(a, S.region(a.descriptor.shape, (0, 0), (128, 32)), 0, step)
    values = float(np.concatenate([t["v"].to_numpy() for t in seen]).astype(float).sum())
    return spark.createDataFrame([(total, r.planned, r.visited, r.decoded, r.completed, round(values, 6))], "cells long, planned long, visited long, decoded long, completed boolean, total double")


def q_fold_all(spark, sf_dir):
    """Sums over all cells by partial folds, one for each run of chunks."""
    a = _embeddings(spark, sf_dir, chunks=(192, 64), sharding=Sharding((64, 16), (LITTLE, C.Zlib(1))), codecs=())
    count = lambda state, table: ((state[0] + len(table), state[1] + float(table["v"].to_numpy().astype(float).sum())), True)
    (cells, total), r = fold.fold_ranges(a, a.all_axes(), (0, 0.0), count, lambda x, y: (x[0] + y[0], x[1] + y[1]))
    return spark.createDataFrame([(cells, r.planned, r.visited, r.completed, round(total, 6))], "cells long, planned long, visited long, completed boolean, total double")


def q_dense(spark, sf_dir):
    cells, d = _sparse(spark, sf_dir, 4096)
    return relational.dense(spark, cells, d.shape, -1.0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("q_")}


_CELLS = "SELECT vec_id AS i0, i - 1 AS i1, embedding[i] AS v FROM embeddings, range(1, 65) t(i)"
_PRICES = "SELECT o_orderkey::BIGINT AS i0, o_totalprice AS v FROM orders"
_DENSE = "SELECT i0, coalesce(value, -1)::DOUBLE AS v FROM (SELECT range AS i0 FROM range((SELECT 2 * max(event_id) + 2 FROM events))) LEFT JOIN events ON event_id * 2 = i0"
_GRID = "SELECT u.range AS i0, h.range AS i1 FROM range((SELECT max(user_id) + 1 FROM events)) u, range((SELECT max(event_id) // 200 + 1 FROM events)) h"
_BY_USER = "SELECT user_id::BIGINT AS i0, (event_id // 200)::BIGINT AS i1, count(*)::INTEGER AS v FROM events GROUP BY ALL"
_FILLED = f"SELECT g.i0, g.i1, coalesce(v, -1)::INTEGER AS v FROM ({_GRID}) g LEFT JOIN ({_BY_USER}) b ON g.i0 = b.i0 AND g.i1 = b.i1"
_DELTA = "SELECT event_id::BIGINT AS i0, (user_id - coalesce(lag(user_id) OVER (PARTITION BY event_id // 64 ORDER BY event_id), 0))::BIGINT AS v FROM events"
_USERS = "SELECT event_id::BIGINT AS i0, user_id::BIGINT AS v FROM events"
# Published receipts of these layouts and workloads.
_EVIDENCE = """
SELECT layout, workload, o AS object_requests, r AS range_requests, l AS length_requests, ib AS index_bytes, b - ib AS data_bytes, b AS bytes_read,
       c AS touched_chunks, s AS touched_shards, lb // 2 AS requested_elements, lb AS logical_bytes, b::DOUBLE / lb AS read_amplification
FROM (VALUES
  ('direct-balanced', 'volume', 32768::BIGINT, 262144::BIGINT, 0::BIGINT, 8::BIGINT, 0::BIGINT, 0::BIGINT, 8::BIGINT, 0::BIGINT),
  ('direct-balanced', 'movie-16', 524288, 524288, 0, 16, 0, 0, 16, 0),
  ('direct-balanced', 'aligned-roi', 32768, 32768, 0, 1, 0, 0, 1, 0),
  ('direct-balanced', 'voxel-series', 128, 262144, 0, 8, 0, 0, 8, 0),
  ('direct-volume', 'volume', 32768, 32768, 0, 1, 0, 0, 1, 0),
  ('direct-volume', 'movie-16', 524288, 524288, 0, 16, 0, 0, 16, 0),
  ('direct-volume', 'aligned-roi', 32768, 262144, 0, 8, 0, 0, 8, 0),
  ('direct-volume', 'voxel-series', 128, 2097152, 0, 64, 0, 0, 64, 0),
  ('sharded-balanced', 'volume', 32768, 262404, 260, 10, 9, 1, 8, 1),
  ('sharded-balanced', 'movie-16', 524288, 524548, 260, 3, 2, 1, 16, 1),
  ('sharded-balanced', 'aligned-roi', 32768, 33028, 260, 3, 2, 1, 1, 1),
  ('sharded-balanced', 'voxel-series', 128, 263184, 1040, 12, 8, 4, 8, 4)
) t(layout, workload, lb, b, ib, o, r, l, c, s)
"""


def oracle_sql() -> dict[str, str]:
    cells = {n: _CELLS for n in ("q_read_all", "q_transpose", "q_v2_c", "q_v2_f", "q_shard_end", "q_shard_start", "q_shard_outer_gzip", "q_v2_blosc", "q_datasource")}
    prices = {n: _PRICES for n in ("q_shuffle_gzip", "q_zlib", "q_zstd", "q_crc32c", "q_blosc")}
    points = ", ".join(f"({k}::BIGINT, {a}::BIGINT, {b}::BIGINT)" for k, (a, b) in enumerate(POINTS))
    return cells | prices | {
        "q_region_direct": f"SELECT * FROM ({_CELLS}) WHERE i0 BETWEEN 10 AND 12 AND i1 BETWEEN 4 AND 7",
        "q_region_border": f"SELECT * FROM ({_CELLS}) WHERE i0 >= (SELECT max(vec_id) - 4 FROM embeddings)",
        "q_points": f"SELECT p.ord, p.i0, p.i1, c.v FROM (VALUES {points}) p(ord, i0, i1) JOIN ({_CELLS}) c ON p.i0 = c.i0 AND p.i1 = c.i1",
        "q_factored": f"SELECT a.o0, b.o1, c.i0, c.i1, c.v FROM (VALUES (0::BIGINT, 3), (1, 1), (2, 1), (3, 499)) a(o0, x) CROSS JOIN (SELECT range AS o1, 5 * range AS y FROM range(13)) b JOIN ({_CELLS}) c ON c.i0 = a.x AND c.i1 = b.y",
        "q_fill_sparse": _FILLED,
        "q_dense": _DENSE,
        "q_write_receipt": f"SELECT count(*)::BIGINT AS objects, 160 * count(*)::BIGINT AS bytes, count(*)::BIGINT AS encoded, ((SELECT (max(user_id) // 8 + 1) * (max(event_id) // 1000 + 1) FROM events) - count(*))::BIGINT AS omitted FROM (SELECT DISTINCT i0 // 8, i1 // 5 FROM ({_BY_USER}))",
        "q_half_floats": "SELECT p_partkey::BIGINT AS i0, p_size::FLOAT AS v FROM part",
        "q_delta_bool": "SELECT event_id::BIGINT AS i0, user_id % 2 = 1 AS v FROM events",
        "q_delta_float": "SELECT event_id::BIGINT AS i0, floor(value * 4) / 4 AS v FROM events",
        "q_object_digests": "SELECT 'c/' || event_id // 1000 AS key, 1000::BIGINT AS length, sha256(string_agg(chr((65 + user_id % 26)::INTEGER), '' ORDER BY event_id)) AS sha256 FROM events GROUP BY event_id // 1000",
        "q_region_wide": f"SELECT * FROM ({_CELLS}) WHERE i0 >= 100 AND i0 < 390",
        "q_shard_inner": f"SELECT * FROM ({_CELLS}) WHERE i0 BETWEEN 10 AND 192 AND i1 BETWEEN 4 AND 27",
        "q_delta_int": _USERS,
        "q_delta_encoded": _DELTA,
        "q_delta_decoded": _USERS,
        "q_big_endian_i2": "SELECT n_nationkey::BIGINT AS i0, n_nationkey::SMALLINT AS v FROM nation",
        "q_chunk_plan": "SELECT i0 // 64 AS c0, i1 // 16 AS c1, count(*)::BIGINT AS elements FROM (SELECT range AS i0 FROM range(60, 260)), (SELECT range AS i1 FROM range(10, 50)) GROUP BY ALL",
        "q_factored_plan": "SELECT i0 // 64 AS c0, i1 // 16 AS c1, count(*)::BIGINT AS elements FROM (SELECT range AS i0 FROM range(3, 480, 100)), (VALUES (40::BIGINT), (1), (40), (63)) t(i1) GROUP BY ALL",
        "q_shard_plan": "SELECT i0 // 192 AS s0, i1 // 64 AS s1, count(DISTINCT (i0 // 64, i1 // 16))::BIGINT AS inner_chunks, count(*)::BIGINT AS elements FROM (SELECT range AS i0 FROM range(60, 260)), (SELECT range AS i1 FROM range(10, 50)) GROUP BY ALL",
        "q_chunk_keys": "SELECT c0, c1, 'c/' || c0 || '/' || c1 AS slash, 'c.' || c0 || '.' || c1 AS dot, c0 || '.' || c1 AS v2_dot, c0 || '/' || c1 AS v2_slash FROM (SELECT range AS c0 FROM range(8)), (SELECT range AS c1 FROM range(4))",
        "q_coalesce": "SELECT (o_orderkey // 5000)::BIGINT AS object, min(o_orderkey * 100 + (o_orderkey // 50) * 10000)::BIGINT AS start, max(o_orderkey * 100 + (o_orderkey // 50) * 10000 + 60)::BIGINT AS \"end\", count(*)::BIGINT AS members FROM orders GROUP BY o_orderkey // 5000, o_orderkey // 50",
        "q_receipt_region": "SELECT 4::BIGINT AS object_requests, 0::BIGINT AS range_requests, 0::BIGINT AS length_requests, 0::BIGINT AS index_bytes, 16384::BIGINT AS data_bytes, 16384::BIGINT AS bytes_read, 4::BIGINT AS touched_chunks, 0::BIGINT AS touched_shards, 2000::BIGINT AS requested_elements, 8000::BIGINT AS logical_bytes, 2.048::DOUBLE AS read_amplification",
        "q_evidence": _EVIDENCE,
        "q_cache_stats": "SELECT * FROM (VALUES ('direct-balanced', 8::BIGINT, 8::BIGINT, 262144::BIGINT, 524288::BIGINT), ('sharded-balanced', 10, 10, 262404, 524808)) t(layout, hits, misses, fetched_bytes, served_bytes)",
        "q_hierarchy": "SELECT * FROM (VALUES ('', 'group', 3), ('bold', 'array', 3), ('derived', 'group', 3), ('derived/mask', 'array', 3)) t(path, kind, format)",
        "q_cell_stats": f"SELECT i1, round(avg(v::DOUBLE), 9) AS mean, min(v) AS least, max(v) AS most, count(*)::BIGINT AS n FROM ({_CELLS}) GROUP BY i1",
        "q_fold_all": f"SELECT count(*)::BIGINT AS cells, count(DISTINCT i0 // 192)::BIGINT AS planned, count(DISTINCT i0 // 192)::BIGINT AS visited, true AS completed, round(sum(v::DOUBLE), 6) AS total FROM ({_CELLS})",
        "q_fold_stop": f"SELECT count(*)::BIGINT AS cells, 4::BIGINT AS planned, 2::BIGINT AS visited, 2::BIGINT AS decoded, false AS completed, round(sum(v::DOUBLE), 6) AS total FROM ({_CELLS}) WHERE i0 < 64 AND i1 < 32",
    }
