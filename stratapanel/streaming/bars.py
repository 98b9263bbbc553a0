"""Bars from a stream of events, with a watermark for late ones, and an exponential average per symbol kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(
    events: DataFrame, width: str = "1 day", late: str = "2 hours", key: str = "user_id", time: str = "ts", value: str = "value",
) -> DataFrame:
    """Open, high, low, close, volume and turnover per symbol and window; works on a stream and on a table alike."""
    rows = events.withColumn("__ts", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("__ts", late) if events.isStreaming else rows
    out = rows.groupBy(F.window("__ts", width).alias("w"), F.col(key).alias("sym")).agg(
        F.min_by(value, "__ts").alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, "__ts").alias("close"), F.count("*").alias("volume"), F.sum(value).alias("turnover")
    )
    return out.select("sym", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "turnover")


def running_ema(events: DataFrame, w: int, key: str = "user_id", time: str = "ts", value: str = "value") -> DataFrame:
    """The exponential average after each event, NULL until ``w`` events: the state of a symbol is (average, events)."""
    alpha = 2.0 / (w + 1)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        e, n = state.get if state.exists else (None, 0)
        # a symbol's rows of one batch are bounded by the trigger; they are ordered before they are folded
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for at, v in zip(rows["at"], rows["v"], strict=True):
            if v == v and v is not None:
                e, n = (v if e is None else alpha * v + (1 - alpha) * e), n + 1
            out.append((k[0], at, e if n >= w else None))
        state.update((e, n))
        yield pd.DataFrame(out, columns=["sym", "at", "ema"])

    rows = events.select(F.col(key).alias("sym"), F.col(time).cast("timestamp").alias("at"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("sym").applyInPandasWithState(
        step, "sym long, at timestamp, ema double", "e double, n long", "append", GroupStateTimeout.NoTimeout,
    )
