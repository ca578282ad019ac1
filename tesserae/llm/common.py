"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.objects import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder that the session names.

    Only where neither ``spark.checkpoint.dir`` nor a checkpoint folder is set, on one machine, is a temporary folder
    used; elsewhere that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch(df.sparkSession, "checkpoint-"))
    return df.checkpoint()


def map_rows(df: DataFrame, columns: list, fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Send ``columns`` of ``df`` through ``fn`` (rows in, rows out) in Arrow batches."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        held, n = [], 0
        for row in fn(rows()):
            held.append(row)
            n += 1
            if n == 2000:
                yield _batch(held, out)
                held, n = [], 0
        if held:
            yield _batch(held, out)

    return df.select(*columns).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def span_string(spans: Iterable[tuple[int, int, str, int]]) -> str:
    """``kind:start:end`` by start, then the kind's rank, then end; spans are (start, rank, kind, end)."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans, key=lambda s: (s[0], s[1], s[3])))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a BIGINT column (nulls aside), found by narrowing histograms.

    Each pass groups on the cluster and brings at most 4096 counts to the driver. ``None`` where ``k`` is below 1
    or above the number of values.
    """
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or k > n:
        return None
    low, high = int(low), int(high)
    while low < high:
        width = max(1, -(-(high - low + 1) // 4096))
        inside = df.where(F.col(column).between(low, high))
        bins = inside.groupBy(F.expr(f"({column} - ({low})) div {width}").alias("bin")).count().collect()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if k <= b["count"]:
                low, high = low + b["bin"] * width, min(high, low + (b["bin"] + 1) * width - 1)
                break
            k -= b["count"]
    return low


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows from the driver, as a local relation that needs no Python on the executors."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    columns = list(zip(*rows)) or [[] for _ in kinds]
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)
    return spark.createDataFrame(table, _parse_datatype_string(schema))
