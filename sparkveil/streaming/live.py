"""Live feeds: raw lines to emissions, layer messages, quality counters, one track of several sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import aggregates, feeds, merges
from .tracks import _expire_after, _in_order

#: Rows from the future by more than this (seconds) go.
FUTURE_S = 1800


def positions(lines: DataFrame, text: str = "raw") -> DataFrame:
    """Emissions of a stream of position reports; reports without a position go."""
    return feeds.vessels(lines, text)[0]


def timely(events: DataFrame, arrived: str, future_s: int = FUTURE_S) -> DataFrame:
    """Events that lie at most ``future_s`` after their arrival; those without a time go."""
    return events.where(f"t <= {arrived} + {future_s}")


def follow(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds", mode: str = "append") -> StreamingQuery:
    """Flushes what has come in every two seconds; how much one flush takes is the source's option
    (``maxFilesPerTrigger``, ``maxBytesPerTrigger`` or ``maxOffsetsPerTrigger``)."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(write).start()


def layer_messages(batch: DataFrame, number: int) -> DataFrame:
    """The messages of one micro-batch of writes (layer, id, seq, props): one for each layer."""
    return merges.layer_deltas(batch.selectExpr(f"{number}L as batch", "layer", "id", "seq", "props"))


def quality(emissions: DataFrame, as_of: int) -> DataFrame:
    """Running counts of emissions that break a rule, by type (update stream; a row of state for each type)."""
    return aggregates.quality_counts(emissions, as_of)


_COLUMNS = ["id", "seq", "t", "lat", "lon", "name", "flags"]


def _merge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The fold of ``merges.merged_tracks`` with the running fix kept between batches."""
    if state.hasTimedOut:
        state.remove()
        return
    now = list(state.get) if state.exists else None
    for x in _in_order(frames, -float("inf")).itertuples(index=False):
        rank, name = merges.SOURCE_RANK.get(x.source, 9), None if pd.isna(x.name) else x.name
        fix = [int(x.seq), int(x.t), rank, float(x.lat), float(x.lon)]
        if now is None:
            now = [*fix, name, int(x.flags)]
        elif fix[1] > now[1] + 1 or (abs(fix[1] - now[1]) <= 1 and rank < now[2]):
            now = [*fix, name if name is not None else now[5], now[6] | int(x.flags)]
        else:
            now[5], now[6] = now[5] if now[5] is not None else name, now[6] | int(x.flags)
    if now is None:
        return
    state.update(tuple(now))
    _expire_after(state, now[1])
    yield pd.DataFrame([(key[0], *now[:2], *now[3:])], columns=_COLUMNS)


def merged(fixes: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Update stream of one track for each aircraft out of several sources (within a second the better source wins);
    rows of a batch are applied in order of ``seq``."""
    kept = "seq long, t long, rank int, lat double, lon double, name string, flags long"
    keyed = fixes.where("id is not null").withWatermark("ts", lateness).groupBy("id")
    return keyed.applyInPandasWithState(_merge, "id string, seq long, t long, lat double, lon double, name string, flags long", kept, "update", GroupStateTimeout.EventTimeTimeout)
