"""The FIFO cache model as a stateful streaming operator; batch semantics, one state a cache."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.paging import fifo_step, page_of

OUT = "cache bigint, hits bigint, misses bigint"


def fifo_stream(trace: DataFrame, slots: int, cache: str = "block") -> DataFrame:
    """Running (cache, hits, misses) after each micro-batch; rows of a batch are taken in seq order."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        queue, hits, misses = state.get if state.exists else ([], 0, 0)
        q = deque(queue)
        seen = pd.concat(list(frames)).sort_values("seq")
        h, m = fifo_step(seen["page"].tolist(), slots, q, set(q))
        state.update((list(q), hits + h, misses + m))
        yield pd.DataFrame([(key[0], hits + h, misses + m)], columns=["cache", "hits", "misses"])

    t = trace.select(F.col(cache).cast("bigint").alias("cache"), "seq", page_of().alias("page"))
    return t.groupBy("cache").applyInPandasWithState(run, OUT, "queue array<bigint>, hits bigint, misses bigint", "update", "NoTimeout")
