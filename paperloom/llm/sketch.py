"""Counts of hashed items over a whole table in an array of fixed size.

The array has ``2**bits`` counters whatever the corpus holds, so it may be sent to
the driver and broadcast. Each task's array is cut into blocks; blocks are summed in a
tree, so that no merging task is given more than ``FAN`` parts, however many tasks
the table has.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 1 << 15
#: Parts that one task sums at most.
FAN = 64
_SCHEMA = "lane int, block int, task long, part binary"


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    total: np.ndarray | None = None
    for part in pdf["part"]:
        one = np.frombuffer(zlib.decompress(part), np.int64)
        total = one.copy() if total is None else total + one
    return pd.DataFrame({"lane": pdf["lane"][:1], "block": pdf["block"][:1], "task": pdf["task"][:1] // FAN, "part": [zlib.compress(total.tobytes(), 1)]})


def hashed_counts(df: DataFrame, slots: Callable[[pa.RecordBatch], list[np.ndarray]], lanes: int, bits: int, fan: int = FAN) -> list[np.ndarray]:
    """slots: gives, for a batch and each of the lanes, the slots to count up."""
    size = 1 << bits

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        counts = np.zeros((lanes, size), np.int64)
        seen = False
        for rb in batches:
            if rb.num_rows:
                seen = True
                for lane, at in enumerate(slots(rb)):
                    if len(at) * 8 > size:
                        counts[lane] += np.bincount(at, minlength=size)
                    else:  # costs the size of the batch, not of the array
                        u, c = np.unique(at, return_counts=True)
                        counts[lane][u] += c
        if seen:
            for lane in range(lanes):
                for block in range(0, size, BLOCK):
                    part = counts[lane, block : block + BLOCK]
                    if part.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lane], pa.int32()), pa.array([block], pa.int32()), pa.array([task], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())],
                            ["lane", "block", "task", "part"],
                        )

    parts = materialize(df.mapInArrow(partial, _SCHEMA))
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > fan:
        parts = materialize(parts.groupBy("lane", "block", F.floor(F.col("task") / fan)).applyInPandas(lambda p: _merge(p).assign(task=p["task"][:1] // fan), _SCHEMA))
        tasks = -(-tasks // fan)
    out = [np.zeros(size, np.int64) for _ in range(lanes)]
    for r in parts.groupBy("lane", "block").applyInPandas(_merge, _SCHEMA).collect():
        n = min(BLOCK, size)
        out[r["lane"]][r["block"] : r["block"] + n] = np.frombuffer(zlib.decompress(r["part"]), np.int64)
    return out
