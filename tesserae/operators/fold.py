"""Ordered folds over the chunks of a selection, with early stop.

``fold_ranges`` folds runs of chunks in tasks and merges their states in order; it is the one for whole arrays. Where
the next step needs the state of all before it, a left fold is sequential by its meaning: ``fold_chunks`` walks the
plan lazily on the driver and reads one chunk at a time, so nothing is read after the fold has stopped.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.errors import Unsupported
from tesserae.plans import selection as S
from tesserae.sources import files
from tesserae.sources.arrays import Array, blocks, selected


@dataclass(frozen=True)
class FoldReceipt:
    """Chunks planned, visited, decoded and filled, cells handed over, and whether the fold went to the end."""

    planned: int
    visited: int
    decoded: int
    filled: int
    elements: int
    completed: bool


def fold_chunks(array: Array, axes: Sequence[S.Axis], initial: Any, step: Callable[[Any, pa.Table], tuple[Any, bool]]) -> tuple[Any, FoldReceipt]:
    """``step(state, cells)`` for each touched chunk in C order, until it returns ``(state, False)``.

    ``cells`` has the places in the result ``o0..``, the coordinates ``i0..`` and ``v``.
    """
    d, rank = array.descriptor, array.descriptor.rank
    plan = S.chunk_plan(array.spark, d, axes)
    planned = plan.count()
    found = array.objects(axes)
    coords = [f"c{k}" for k in range(rank)]
    known = plan.withColumn("there", F.lit(False)) if found is None else plan.join(found.select(*coords, F.lit(True).alias("there")), coords, "left") if rank else plan.withColumn("there", F.lit(True))
    state, visited, decoded, elements, going = initial, 0, 0, 0, True
    for row in known.orderBy("nth").toLocalIterator():
        box = [_clipped(a, row[c] * n, min((row[c] + 1) * n, s)) for a, c, n, s in zip(axes, coords, d.chunks, d.shape)]
        cells = array.cells([a for a, _ in box], placed=True)
        for k, (_, shift) in enumerate(box):
            cells = cells.withColumn(f"o{k}", shift(F.col(f"o{k}")))
        table = cells.orderBy(*[f"o{k}" for k in range(rank)]).toArrow() if rank else cells.toArrow()
        visited, decoded, elements = visited + 1, decoded + bool(row["there"]), elements + len(table)
        state, going = step(state, table)
        if not going:
            break
    return state, FoldReceipt(planned, visited, decoded, visited - decoded, elements, going)


def fold_ranges(array: Array, axes: Sequence[S.Axis], initial: Any, step: Callable[[Any, pa.Table], tuple[Any, bool]], merge: Callable[[Any, Any], Any], runs: int | None = None) -> tuple[Any, FoldReceipt]:
    """``step(state, cells)`` for each fragment, ``initial`` at the start of every run of chunks; states are merged in C order.

    A fragment is a part of a chunk, or of an inner chunk of a shard, of bounded size, ``(i0.., v)``; inner chunks come
    one by one in the order of their bytes. Runs are of about equal numbers of chunks, ``runs`` of them; a run that returned ``(state,
    False)`` is the last that is merged, what later ones read is dropped. Only states, one for each run, reach the driver.
    """
    if not array.by_key:
        raise Unsupported("a fold in tasks needs a store that they can open")
    d, coords = array.descriptor, [f"c{k}" for k in range(array.descriptor.rank)]
    root = f"{array._folder()}/{array.path}" if array.path else array._folder()
    plan = S.keyed_plan(array.spark, d, axes).select("nth", *coords, "key")
    plan = plan.repartitionByRange(runs or array.spark.sparkContext.defaultParallelism, "nth").sortWithinPartitions("nth")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, going, first = initial, True, None
        visited = decoded = elements = 0
        for row in (row for batch in batches for row in batch.to_pylist()):
            first = row["nth"] if first is None else first
            if not going:
                break
            at = [row[c] for c in coords]
            content = files.open_object(f"{root}/{row['key']}")
            visited, decoded = visited + 1, decoded + (content is not None)
            fill = [([c * n for c, n in zip(at, d.chunks)], np.broadcast_to(d.fill_value, d.chunks))]
            for origin, block in blocks(d, at, content, axes) if content is not None else fill:
                for part in selected(d, origin, block, axes, False):
                    if going:
                        elements += part.num_rows
                        state, going = step(state, pa.Table.from_batches([part]))
        if first is not None:
            row = {"nth": first, "state": pickle.dumps(state), "visited": visited, "decoded": decoded, "elements": elements, "going": going}
            yield pa.RecordBatch.from_pylist([row])

    done = plan.mapInArrow(fold, "nth long, state binary, visited long, decoded long, elements long, going boolean").orderBy("nth").collect()
    state, counts, going = initial, [0, 0, 0], True
    for k, row in enumerate(done):
        state = merge(state, pickle.loads(row["state"])) if k else pickle.loads(row["state"])
        counts = [a + row[c] for a, c in zip(counts, ("visited", "decoded", "elements"))]
        if not (going := row["going"]):
            break
    planned = S.plan_stats(d, axes)["chunks"] if d.sharding is None else S.chunk_plan(array.spark, d, axes).count()
    return state, FoldReceipt(planned, counts[0], counts[1], counts[0] - counts[1], counts[2], going)


def _clipped(axis: S.Axis, low: int, high: int) -> tuple[S.Axis, Callable]:
    """The axis inside a chunk, and the places of its positions in the whole result."""
    values, out = axis.inside(low, high)
    if axis.values is not None:
        places = F.array(*[F.lit(int(o)) for o in out])
        return S.Axis(length=len(values), values=values), lambda o: F.element_at(places, (o + 1).cast("int")).cast("long")
    first = int(out[0]) if len(out) else 0
    return S.Axis(int(values[0]) if len(values) else 0, axis.step, len(values)), lambda o: o + F.lit(first)
