"""Counts of a stream in windows of event time, with a clock for each key, state that goes once a window is over, and late rows counted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What keeps the state: values and maps of a key, on disk beside the executor and in the stream's checkpoint.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeyedWindows(StatefulProcessor):
    """State of a key: its latest event time so far, and the counts of its windows that are still open.

    Times are whole seconds. A micro-batch is judged by the clock at its beginning, so the order of its rows doesn't matter and they are
    never held together.
    """

    def __init__(self, time: str, width: int, delay: int, names: list[str]) -> None:
        self.time, self.width, self.delay, self.names = time, width, delay, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "latest bigint")
        self.open = handle.getMapState("open", "start bigint", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock = self.clock.get()[0] if self.clock.exists() else None
        latest, late = clock, 0
        for batch in rows:
            times = batch[self.time].dropna().astype("int64")
            if clock is not None:
                on_time = times >= clock - self.delay
                late, times = late + int((~on_time).sum()), times[on_time]
            for start, n in (times // self.width * self.width).value_counts().items():
                before = self.open.getValue((int(start),))[0] if self.open.containsKey((int(start),)) else 0
                self.open.updateValue((int(start),), (before + int(n),))
            if len(times):
                latest = max(int(times.max()), latest if latest is not None else int(times.max()))
        out = [("late", None, late)] if late else []
        if latest is not None:
            self.clock.update((latest,))
            over = sorted(start for (start,) in self.open.keys() if start + self.width <= latest - self.delay)
            for start in over:
                out.append(("window", start, self.open.getValue((start,))[0]))
                self.open.removeKey((start,))
        found = pd.DataFrame(out, columns=["kind", "start", "n"]).astype({"start": "Int64", "n": "int64"})
        for name, value in zip(self.names, key, strict=True):
            found.insert(0, name, value)
        yield found[[*self.names, "kind", "start", "n"]]

    def close(self) -> None:
        pass


def keyed_windows(stream: DataFrame, by: list[str], time: str, width: int, delay: int) -> DataFrame:
    """by, kind, start (seconds), n: each window of width seconds once the key's clock is delay seconds past its end, and how many rows of a
    micro-batch came too late for their key (start null). Rows without a time count nowhere.

    A key's clock is its latest event time up to the last micro-batch. A window that is over leaves the state, so a key holds
    as many counts as windows fit in delay, besides the one open.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "kind string, start bigint, n bigint"])
    rows = stream.select(*by, F.unix_seconds(F.col(time).cast("timestamp")).alias("seconds"))
    return rows.groupBy(*by).transformWithStateInPandas(KeyedWindows("seconds", width, delay, by), schema, "append", "None")
