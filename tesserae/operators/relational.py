"""Array transforms as relations over cells, where no bytes are wanted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.geometry import element_count, index_columns, unravel


def _chunks(cells: DataFrame, chunks: Sequence[int]):
    keys = [F.expr(f"i{k} div {c}") for k, c in enumerate(chunks)]
    return Window.partitionBy(*keys).orderBy(*index_columns(len(chunks)))


def delta_encoded(cells: DataFrame, chunks: Sequence[int]) -> DataFrame:
    """Integer cells as differences along each chunk in C order; its first cell stays."""
    return cells.withColumn("v", F.col("v") - F.coalesce(F.lag("v").over(_chunks(cells, chunks)), F.lit(0)))


def delta_decoded(cells: DataFrame, chunks: Sequence[int], bits: int = 64) -> DataFrame:
    """Running sums along each chunk, wrapped to a signed type of so many bits."""
    total = F.sum(F.col("v").cast("decimal(38,0)")).over(_chunks(cells, chunks).rowsBetween(Window.unboundedPreceding, 0))
    whole = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    half = whole(1 << (bits - 1))
    return cells.withColumn("v", (F.pmod(total + half, whole(1 << bits)) - half).cast("long"))


def transposed(cells: DataFrame, order: Sequence[int]) -> DataFrame:
    """Axes renamed: axis k of the result is axis ``order[k]`` of the cells."""
    return cells.select(*[F.col(f"i{o}").alias(f"i{k}") for k, o in enumerate(order)], "v")


def dense(spark: SparkSession, cells: DataFrame, shape: Sequence[int], fill) -> DataFrame:
    """Every cell of the shape, with ``fill`` where ``cells`` has none."""
    grid = spark.range(element_count(shape)).select(*unravel("id", shape, "i"))
    cols = index_columns(len(shape))
    if not cols:
        return cells
    return grid.join(cells, cols, "left").select(*cols, F.coalesce("v", F.lit(fill)).alias("v"))
