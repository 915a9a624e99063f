"""Incremental statistics over arriving texts with Structured Streaming.

Counts of context and byte are plain grouped sums, kept by Spark's own state store. Run statistics depend on order and
keep a small state per key with ``applyInPandasWithState``; state of keys that stay silent is given up by timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bytestream import byte_counts


def streaming_byte_counts(stream: DataFrame, content: str = "text", order: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Running counts; write them in ``update`` or ``complete`` mode. Works on batches too."""
    if not stream.isStreaming:
        return byte_counts(stream, order, content, by)
    from ..operators.bytestream import byte_rows, code

    rows = byte_rows(stream, content, by, order)
    names = ["b", *(f"c{k}" for k in range(1, order + 1))]
    return rows.groupBy(*by, *[code(F.col(c)).alias(c) for c in names]).agg(F.count(F.lit(1)).alias("n"))


def streaming_runs(stream: DataFrame, key: str, order_col: str, value: str, timeout: str | None = None) -> DataFrame:
    """key, value, run, at: the current run of equal values of each key, after each micro-batch. Rows of a micro-batch
    are taken in the order of ``order_col``."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, run, at = state.get if state.exists else (None, 0, None)
        rows = pd.concat(list(frames)).sort_values("o", kind="stable")
        for o, v in zip(rows["o"], rows["v"]):
            last, run, at = v, run + 1 if v == last else 1, int(o)
        state.update((last, run, at))
        if timeout:
            state.setTimeoutDuration(int(timeout))
        yield pd.DataFrame({"key": [str(k[0])], "value": [last], "run": [run], "at": [at]})

    rows = stream.select(F.col(key).alias("k"), F.col(order_col).cast("long").alias("o"), F.col(value).cast("string").alias("v"))
    return rows.groupBy("k").applyInPandasWithState(
        update,
        "key string, value string, run long, at long",
        "value string, run long, at long",
        "update",
        GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout,
    )


def windowed_counts(stream: DataFrame, time_col: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per time window and key; late rows are taken until the watermark passes."""
    return (
        stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
        .withWatermark(time_col, late)
        .groupBy(F.window(time_col, width).alias("w"), by)
        .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
    )
