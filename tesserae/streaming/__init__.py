"""Streams of cells into stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tesserae.errors import NodeExists
from tesserae.operators.write import create_array
from tesserae.plans.descriptor import ArrayDescriptor


def write_batches(cells: DataFrame, root: str, d: ArrayDescriptor) -> DataStreamWriter:
    """A stream ``(i0.., v)`` as one new array ``batch-<id>`` below ``root`` for each micro-batch.

    An array appears in one step and is never changed, so a batch that is run again after a failure finds its array
    and leaves it: each batch is stored exactly once. A batch that repeats a coordinate fails.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        try:
            create_array(batch, root, d, f"batch-{batch_id:08d}")
        except NodeExists:
            pass

    return cells.writeStream.foreachBatch(store)
