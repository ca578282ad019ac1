"""Selections of an array, and the chunks they touch, as DataFrames.

A selection has one selector for each axis: a range (whole axis, region, slice with a step) or an ordered list of
indices. The plan of an axis is a small DataFrame of its touched chunks; the plan of the array numbers the product of
the axes with ``range`` and looks each axis up by position, so an axis span is never enumerated and no cross join is
needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.errors import InvalidSelection, ResourceLimit
from tesserae.functions.geometry import checked_region, chunk_key_column, linear
from tesserae.plans.descriptor import ArrayDescriptor

#: Chunks of one read and entries of one index list, at most.
MAX_CHUNKS, MAX_INDICES = 1_000_000_000, 10_000_000


@dataclass(frozen=True)
class All:
    """The whole axis."""


@dataclass(frozen=True)
class Slice:
    """From start to stop (exclusive) by step; a stop beyond the axis is an error."""

    start: int
    stop: int
    step: int = 1


@dataclass(frozen=True)
class Indices:
    """Listed positions, in this order, repeats included."""

    values: tuple[int, ...]

    def __init__(self, values: Sequence[int]):
        object.__setattr__(self, "values", tuple(int(v) for v in values))


Selector = All | Slice | Indices


@dataclass(frozen=True)
class Axis:
    """A checked selector: either start, step and length, or values."""

    start: int = 0
    step: int = 1
    length: int = 0
    values: np.ndarray | None = None

    def touched(self, chunk: int) -> int:
        """Number of chunks."""
        if self.values is not None:
            return len(np.unique(self.values // chunk))
        if not self.length:
            return 0
        return self.length if self.step >= chunk else (self.start + (self.length - 1) * self.step) // chunk - self.start // chunk + 1

    def bounds(self, chunk: int) -> tuple[int, int]:
        """First and last touched chunk."""
        if self.values is not None:
            return int(self.values.min()) // chunk, int(self.values.max()) // chunk
        return self.start // chunk, (self.start + (self.length - 1) * self.step) // chunk

    def inside(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Selected positions from low to high (exclusive), and where they come out."""
        if self.values is not None:
            out = np.flatnonzero((self.values >= low) & (self.values < high))
            return self.values[out], out
        first = max(0, -(-(low - self.start) // self.step))
        last = min(self.length, -(-(high - self.start) // self.step))
        out = np.arange(first, max(first, last), dtype=np.int64)
        return self.start + out * self.step, out


def checked(shape: Sequence[int], selectors: Sequence[Selector]) -> tuple[Axis, ...]:
    """Selectors against a shape, one for each axis."""
    if len(shape) != len(selectors):
        raise InvalidSelection(f"{len(selectors)} selectors for rank {len(shape)}")
    out = []
    for size, s in zip(shape, selectors):
        if isinstance(s, All):
            out.append(Axis(0, 1, size))
        elif isinstance(s, Slice):
            if s.step <= 0 or s.start < 0 or s.stop < s.start or s.stop > size:
                raise InvalidSelection(f"{s} on an axis of {size}")
            out.append(Axis(s.start, s.step, -(-(s.stop - s.start) // s.step)))
        elif isinstance(s, Indices):
            if len(s.values) > MAX_INDICES:
                raise ResourceLimit("indices of an axis", MAX_INDICES, len(s.values))
            values = np.array(s.values, np.int64)
            if len(values) and (values.min() < 0 or values.max() >= size):
                raise InvalidSelection(f"index outside an axis of {size}")
            out.append(Axis(length=len(values), values=values))
        else:
            raise InvalidSelection(f"{s!r} is not a selector")
    return tuple(out)


def region(shape: Sequence[int], origin: Sequence[int], extent: Sequence[int]) -> tuple[Axis, ...]:
    return tuple(Axis(o, 1, e) for o, e in checked_region(shape, origin, extent))


def output_shape(axes: Sequence[Axis]) -> tuple[int, ...]:
    return tuple(a.length for a in axes)


def _regular(axis: Axis, chunk: int, pos: Column) -> tuple[Column, Column]:
    """Chunk and number of selected positions of the touched chunk at ``pos``, for a selector with a step."""
    if axis.step >= chunk:
        at = F.lit(axis.start).cast("long") + pos * F.lit(axis.step).cast("long")
        return F.call_function("div", at, F.lit(chunk).cast("long")), F.lit(1).cast("long")
    c = pos + (axis.start // chunk if axis.length else 0)
    whole = lambda x: F.call_function("div", x - axis.start + axis.step - 1, F.lit(axis.step).cast("long"))
    upto = lambda at: F.greatest(F.lit(0), F.least(F.lit(axis.length), whole(at)))
    return c, (upto((c + 1) * chunk) - upto(c * chunk)).cast("long")


def _listed(spark: SparkSession, axis: Axis, chunk: int) -> DataFrame:
    """``(pos, chunk, n)`` for listed positions."""
    rows = spark.createDataFrame([(int(v),) for v in axis.values], "v long").groupBy(F.expr(f"v div {chunk}").alias("chunk")).agg(F.count("*").alias("n"))
    return rows.select((F.row_number().over(Window.orderBy("chunk")) - 1).cast("long").alias("pos"), "chunk", "n")


def axis_plan(spark: SparkSession, axis: Axis, chunk: int) -> DataFrame:
    """``(pos, chunk, n)``: the touched chunks of an axis in order, with how many selected positions each has."""
    if axis.values is not None:
        return _listed(spark, axis, chunk)
    c, n = _regular(axis, chunk, F.col("id"))
    return spark.range(axis.touched(chunk)).select(F.col("id").alias("pos"), c.alias("chunk"), n.alias("n"))


def chunk_plan(spark: SparkSession, d: ArrayDescriptor, axes: Sequence[Axis], inner: bool = False, tasks: int | None = None) -> DataFrame:
    """``(nth, c0.., elements)``: touched chunks (inner ones where asked for) in C order with their selected cells.

    Axes with a step are arithmetic on the number; only listed positions are looked up. Without them ``tasks`` have equal runs of the plan.
    """
    chunks = d.inner if inner else d.chunks
    counts = [a.touched(c) for a, c in zip(axes, chunks)]
    total = reduce(lambda a, b: a * b, counts, 1)
    if total > MAX_CHUNKS:
        raise ResourceLimit("chunks of a read", MAX_CHUNKS, total)
    rows, stride = spark.range(0, total, 1, tasks).withColumnRenamed("id", "nth").withColumn("elements", F.lit(1).cast("long")), total
    for k, (axis, chunk, n) in enumerate(zip(axes, chunks, counts)):
        stride = stride // n if n else 1
        pos = F.expr(f"(nth div {stride}) % {max(1, n)}")
        if axis.values is None:
            c, selected = _regular(axis, chunk, pos)
            rows = rows.withColumns({f"c{k}": c, "elements": F.col("elements") * selected})
        else:
            plan = _listed(spark, axis, chunk).select(F.col("pos").alias("_pos"), F.col("chunk").alias(f"c{k}"), F.col("n").alias("_n"))
            rows = rows.withColumn("_pos", pos).join(plan, "_pos").withColumn("elements", F.col("elements") * F.col("_n")).drop("_pos", "_n")
    return rows.select("nth", *[f"c{k}" for k in range(len(axes))], "elements")


def keyed_plan(spark: SparkSession, d: ArrayDescriptor, axes: Sequence[Axis], tasks: int | None = None) -> DataFrame:
    """The plan of objects with their keys."""
    plan = chunk_plan(spark, d, axes, tasks=tasks)
    return plan.withColumn("key", chunk_key_column([f"c{k}" for k in range(d.rank)], d.encoding, d.separator))


def shard_plan(spark: SparkSession, d: ArrayDescriptor, axes: Sequence[Axis]) -> DataFrame:
    """``(s0.., local, elements)``: each touched inner chunk with its shard and its number inside it."""
    counts = d.sharding.counts(d.chunks)
    plan = chunk_plan(spark, d, axes, inner=True)
    for k, n in enumerate(counts):
        plan = plan.withColumn(f"s{k}", F.expr(f"c{k} div {n}")).withColumn(f"l{k}", F.expr(f"c{k} % {n}"))
    local = linear([f"l{k}" for k in range(d.rank)], counts)
    return plan.withColumn("local", local).select(*[f"s{k}" for k in range(d.rank)], "local", "elements")


def point_plan(points: DataFrame, d: ArrayDescriptor) -> DataFrame:
    """``(c0.., points)``: ordered points by chunk, each with its place in the result and its offset in the nominal chunk."""
    for k, c in enumerate(d.chunks):
        points = points.withColumn(f"c{k}", F.expr(f"i{k} div {c}")).withColumn(f"_l{k}", F.expr(f"i{k} % {c}"))
    offset = linear([f"_l{k}" for k in range(d.rank)], d.chunks)
    pair = F.struct(F.col("ord").alias("dest"), offset.alias("source"))
    return points.groupBy(*[f"c{k}" for k in range(d.rank)]).agg(F.array_sort(F.collect_list(pair)).alias("points"))


def plan_stats(d: ArrayDescriptor, axes: Sequence[Axis]) -> dict[str, int]:
    """Size of a factored plan: it grows with the sum of the axes, not with their product."""
    counts = [a.touched(c) for a, c in zip(axes, d.inner)]
    total = reduce(lambda a, b: a * b, counts, 1)
    listed = sum(a.length for a in axes if a.values is not None)
    return {"chunks": total, "axis_groups": sum(counts), "explicit_indices": listed, "axis_references": total * len(counts), "elements": reduce(lambda a, b: a * b, output_shape(axes), 1)}
