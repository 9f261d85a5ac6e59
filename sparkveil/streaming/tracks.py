"""Structured Streaming versions of the stateful operators.

State is keyed by track, so it is spread over all tasks; each key keeps a few values only and goes after
``IDLE_MS`` without fixes (event-time timeout). Batches of one key are applied in order of arrival, the rows of a batch
in order of ``seq``. Rows that the state already rules out go frame by frame; what is left of a track in one batch is
bounded by the bytes that the source gives a batch (``run.stream_of``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE_MS = 40 * 86_400_000
STATE = "id string, t long, lat double, lon double, alt double, name string, heading double, speed double"


def _in_order(frames: Iterator[pd.DataFrame], least: float) -> pd.DataFrame:
    """The rows of one batch with ``t`` of at least ``least``, by ``seq``."""
    return pd.concat([f[f["t"] >= least] for f in frames]).sort_values("seq")


def _expire_after(state: GroupState, t: int) -> None:
    """Lets the state go ``IDLE_MS`` after event time ``t`` (seconds), or after the watermark if that is later."""
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), t * 1000, 0) + IDLE_MS)


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Newest-wins state of one track: older fixes than the newest never overwrite it."""
    if state.hasTimedOut:
        state.remove()
        return
    have = state.get if state.exists else None
    rows = _in_order(frames, -float("inf") if have is None else have[0])
    rows = rows[rows["t"] == rows["t"].cummax()]  # those that are no older than any before
    if len(rows):
        last = rows.iloc[-1]
        known = [rows[c].dropna() for c in ("name", "heading", "speed")]
        kept = have[4:] if have is not None else (None, None, None)
        alt = None if pd.isna(last["alt"]) else float(last["alt"])
        have = (int(last["t"]), float(last["lat"]), float(last["lon"]), alt, *[c.iloc[-1] if len(c) else o for o, c in zip(kept, known, strict=True)])
    if have is None:
        return
    state.update(have)
    _expire_after(state, have[0])
    yield pd.DataFrame([(key[0], *have)], columns=["id", "t", "lat", "lon", "alt", "name", "heading", "speed"])


def latest_tracks(fixes: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Update stream of track states from a stream of fixes with an event time ``ts``."""
    schema = "t long, lat double, lon double, alt double, name string, heading double, speed double"
    keyed = fixes.withWatermark("ts", lateness).groupBy("id")
    return keyed.applyInPandasWithState(_fold, STATE, schema, "update", GroupStateTimeout.EventTimeTimeout)


def downsample(gap_s: int):
    """State function that keeps fixes at least ``gap_s`` after the last kept one.

    A state goes only when the watermark is ``IDLE_MS`` past its last kept fix. With a gap below that, the next fix that
    isn't late would be kept with or without the state.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = state.get[0] if state.exists else None
        rows = _in_order(frames, -float("inf") if kept is None else kept + gap_s)
        keep = []
        for t in rows["t"]:
            ok = kept is None or t - kept >= gap_s
            kept = int(t) if ok else kept
            keep.append(ok)
        if kept is None:
            return
        state.update((kept,))
        _expire_after(state, kept)
        yield rows[keep][["id", "seq", "t"]]

    return run


def thinned(fixes: DataFrame, gap_s: int, lateness: str = "2 hours") -> DataFrame:
    """Append stream of downsampled fixes from a stream of fixes with an event time ``ts``."""
    keyed = fixes.withWatermark("ts", lateness).groupBy("id")
    return keyed.applyInPandasWithState(downsample(gap_s), "id string, seq long, t long", "kept long", "append", GroupStateTimeout.EventTimeTimeout)


def distinct_keys(events: DataFrame, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def slots(events: DataFrame, width: str = "15 minutes", lateness: str = "1 hour") -> DataFrame:
    """Events by layer in tumbling windows."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "layer").agg(F.count("*").alias("events"))


def matched(stream: DataFrame, indicators: DataFrame, key: str) -> DataFrame:
    """Arriving rows that a static indicator table lists."""
    return stream.join(indicators.select(F.col("key").alias(key), "list"), key)
