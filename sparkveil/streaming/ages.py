"""Things on layers that go when they are older than their layer allows: a timer of event time for each.

State is one value for each (layer, id), kept in RocksDB and not on the heap; a newer report moves the timer. When the
watermark passes a timer the thing is told as gone and its state is cleared. The ages come from a table of layers, which
is joined to the stream; things on layers without an age stay for good and keep no state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GONE = "layer string, id string, t long, gone_at long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Ages(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long, age long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        have = self.last.get() if self.last.exists() else None
        gone = []
        if have is not None and (have[0] + have[1]) * 1000 <= timerValues.getCurrentWatermarkInMs():
            gone, old, have = [(key[0], key[1], have[0], have[0] + have[1])], have, None  # went before it was told of anew
            self.handle.deleteTimer((old[0] + old[1]) * 1000)
        newest, age = have if have is not None else (None, None)
        for frame in rows:
            at = int(frame["t"].max())
            if newest is None or at > newest:
                newest, age = at, int(frame["max_age_s"].iloc[0])
        if newest is not None and (have is None or newest != have[0]):
            if have is not None:
                self.handle.deleteTimer((have[0] + have[1]) * 1000)
            self.last.update((newest, age))
            self.handle.registerTimer((newest + age) * 1000)
        yield pd.DataFrame(gone, columns=["layer", "id", "t", "gone_at"]).astype({"layer": object, "id": object, "t": "int64", "gone_at": "int64"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        t, age = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"layer": [key[0]], "id": [key[1]], "t": [t], "gone_at": [t + age]})

    def close(self) -> None:
        pass


def removals(reports: DataFrame, layers: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Append stream (layer, id, t, gone_at) of what has gone: ``t`` is the last report, ``gone_at`` that and the layer's age.

    ``reports`` has layer, id, t (seconds) and the event time ``ts``; ``layers`` has layer and max_age_s (null: no age).
    Reports without layer, id or time are left out. It must run inside ``kept_on_disk``.
    """
    aged = layers.where("max_age_s is not null").select("layer", F.col("max_age_s").cast("long").alias("max_age_s"))
    rows = reports.where("layer is not null and id is not null and t is not null").withWatermark("ts", lateness).join(aged, "layer").select("layer", "id", "t", "max_age_s", "ts")
    return rows.groupBy("layer", "id").transformWithStateInPandas(_Ages(), outputStructType=GONE, outputMode="Append", timeMode="EventTime")


@contextmanager
def kept_on_disk(spark: SparkSession):
    """State of streams that start inside is kept in RocksDB; the session's setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
