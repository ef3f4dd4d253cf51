"""Event streams by hour: tumbling windows under a watermark, and running differences by stateful grouped maps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly(events: DataFrame, late: str = "2 hours", length: str = "1 hour") -> DataFrame:
    """(hour, series, n, total) per tumbling window; rows later than the watermark are dropped."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", length), F.col("event_type"))
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), F.col("event_type").alias("series"), "n", "total")


def differences(events: DataFrame) -> DataFrame:
    """(user_id, ts, diff): each user's change of value since the one before, batch after batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in frames:
            ordered = frame.sort_values(["ts", "event_id"])
            before = ordered["value"].shift()
            if last is not None and len(ordered):
                before.iloc[0] = last
            if len(ordered):
                last = float(ordered["value"].iloc[-1])
            kept = before.notna()
            yield pd.DataFrame({"user_id": key[0], "ts": ordered["ts"][kept], "diff": (ordered["value"] - before)[kept]})
        if last is not None:
            state.update((last,))

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, ts timestamp, diff double", "last double", "append", GroupStateTimeout.NoTimeout)
