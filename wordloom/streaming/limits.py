"""Request limits over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wordloom.operators.quota import LOCAL, MINUTE_LIMIT, MINUTE_MS, ZONE, hour_key

_STATE = "hour long, count long, start long, minute long"


def limited_stream(requests: DataFrame, client: str, ts: str, order: str, cap: int, late: str = "1 hour", zone: str = ZONE, success: str | None = None) -> DataFrame:
    """The streaming form of ``limited_requests``: client, order, allowed, reason.

    State per client is four numbers and goes two hours after its last request;
    within a micro-batch requests are taken in order of time.
    """
    rows = requests.withWatermark(ts, late).select(
        F.col(client).cast("string").alias("client"), F.col(order).alias("request"), F.col(ts).alias("ts"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.unix_millis(hour_key(F.col(ts), zone).cast("timestamp")).alias("hour"),
        (F.coalesce(F.col(success), F.lit(False)) if success else F.lit(True)).alias("done"),
    )

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = pd.concat(list(frames)).sort_values(["ms", "request"], kind="stable")
        hour, count, start, minute = state.get if state.exists else (None, 0, 0, 0)
        allowed, reasons = [], []
        for ms, at, done in zip(seen["ms"].tolist(), seen["hour"].tolist(), seen["done"].tolist(), strict=True):
            if hour != at:
                hour, count, start, minute = at, 0, ms, 0
            reason = None
            if key[0] not in LOCAL:
                if ms - start > MINUTE_MS:
                    start, minute = ms, 0
                reason = "PER_MINUTE_LIMIT" if minute >= MINUTE_LIMIT else "PER_HOUR_IP_CAP" if count >= cap else None
                if reason is None and done:
                    minute, count = minute + 1, count + 1
            allowed.append(reason is None)
            reasons.append(reason)
        state.update((hour, count, start, minute))
        state.setTimeoutTimestamp(max(int(seen["ms"].max()), state.getCurrentWatermarkMs()) + 2 * 3_600_000)
        yield pd.DataFrame({"client": key[0], "request": seen["request"].to_numpy(), "allowed": allowed, "reason": reasons})

    kind = dict(requests.dtypes)[order]
    return rows.groupBy("client").applyInPandasWithState(step, f"client string, request {kind}, allowed boolean, reason string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def hourly_stream(requests: DataFrame, model: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Requests per model and hour, as a windowed aggregate with a watermark."""
    return requests.withWatermark(ts, late).groupBy(model, F.window(ts, "1 hour")).agg(F.count("*").alias("used")).select(model, F.col("window.start").alias("hour"), "used")
