"""Streams of observations: what is new or changed, an append-only log, and counts in windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changed_content(stream: DataFrame, keys: list[str], digest: str, order: str) -> DataFrame:
    """Observations whose content differs from the key's last one. State is one digest for each key.

    A micro-batch's observations of a key are taken in order; failed ones (null digest) change nothing.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)

    def fn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        keep = []
        for value in rows[digest]:
            keep.append(value is not None and value != last)
            last = value if value is not None else last
        if last is not None:
            state.update((last,))
        yield rows[keep]

    return stream.groupBy(*keys).applyInPandasWithState(fn, schema, "digest string", "append", GroupStateTimeout.NoTimeout)


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream to a Parquet log; each micro-batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def window_counts(stream: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Rows of each tumbling window; rows later than the watermark are left out. An extension of the operator set."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def session_counts(df: DataFrame, time: str, gap: str, by: list[str]) -> DataFrame:
    """Rows of each session: runs of rows less than gap apart. An extension of the operator set."""
    out = df.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
