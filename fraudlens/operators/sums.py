"""Sums of dense vectors that tasks have made, such as gradients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed(parts: DataFrame, tasks: int, fan_in: int) -> np.ndarray:
    """Sum of the vectors of ``parts`` (part long, v binary; about ``tasks`` of
    them) in a tree; the driver adds the last ``fan_in``."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(1):
                x = np.frombuffer(v.as_buffer(), dtype=float)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

    while tasks > fan_in:
        tasks = -(-tasks // fan_in)
        parts = parts.repartition(tasks, "part").mapInArrow(add, "part long, v binary").withColumn("part", F.spark_partition_id().cast("long"))
    # the order of addition does not depend on which task ends first
    got = sorted((r["part"], bytes(r["v"])) for r in parts.collect())
    return np.sum([np.frombuffer(v, dtype=float) for _, v in got], axis=0)
