"""Budgets and request limits over a log of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ZONE = "America/Los_Angeles"
SAFETY, DAY_SHARE, CLIENT_SHARE = 0.8, 24, 0.2
MINUTE_LIMIT, MINUTE_MS, LEAST_CAP = 10, 60_000, 2
LOCAL = ["127.0.0.1", "::1", "::ffff:127.0.0.1"]


def hourly_budget(per_day: int) -> int:
    return int(per_day * SAFETY // DAY_SHARE)


def hour_key(ts: Column, zone: str = ZONE) -> Column:
    """The hour that a request counts to, in the provider's zone."""
    return F.date_trunc("hour", F.from_utc_timestamp(ts, zone))


def hourly_usage(log: DataFrame, model: str, ts: str, budget: Column, cold: bool = False) -> DataFrame:
    """Requests per model and hour against the budget; with a cold start a model's first hour has half."""
    used = log.groupBy(model, hour_key(F.col(ts)).alias("hour")).agg(F.count("*").alias("used"))
    out = used.withColumn("budget", budget)
    if cold:
        firsts = used.groupBy(model).agg(F.min("hour").alias("first"))
        out = out.join(firsts, model).withColumn("budget", F.when(F.col("hour") == F.col("first"), F.floor(F.col("budget") * 0.5)).otherwise(F.col("budget"))).drop("first")
    return out.withColumn("remaining", F.greatest(F.lit(0), F.col("budget") - F.col("used")))


def client_cap(budgets: dict[str, int]) -> int:
    return max(LEAST_CAP, int(CLIENT_SHARE * sum(budgets.values())))


def limited_requests(log: DataFrame, client: str, ts: str, order: str, cap: int, zone: str = ZONE, success: str | None = None) -> DataFrame:
    """Adds allowed and reason to a log of requests, client by client in order of time.

    The minute window restarts at the first request over 60 s after its start;
    ten are allowed in it, and ``cap`` in an hour; only allowed requests count,
    and of them only successful ones if ``success`` names a boolean column.
    Local clients are always allowed.  A client's requests stream through one
    state, so that a busy client needs little memory.
    """
    rows = log.withColumn("_ms", F.unix_millis(F.col(ts).cast("timestamp"))).withColumn("_hour", F.unix_millis(hour_key(F.col(ts), zone).cast("timestamp")))
    rows = rows.withColumn("_done", F.coalesce(F.col(success), F.lit(False)) if success else F.lit(True))
    local = F.col(client).cast("string").isin(LOCAL)
    ordered = rows.withColumn("_local", F.coalesce(local, F.lit(False))).repartition(client).sortWithinPartitions(client, ts, order)
    names = [*log.columns, "allowed", "reason"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema), "allowed boolean", "reason string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {"client": None}
        for batch in batches:
            allowed, reasons = [], []
            for who, ms, hour, here, done in zip(batch[client], batch["_ms"], batch["_hour"], batch["_local"], batch["_done"], strict=True):
                if state["client"] != who or "hour" not in state or state["hour"] != hour:
                    state = {"client": who, "hour": hour, "count": 0, "start": ms, "minute": 0}
                reason = None
                if not here:
                    if ms - state["start"] > MINUTE_MS:
                        state["start"], state["minute"] = ms, 0
                    reason = "PER_MINUTE_LIMIT" if state["minute"] >= MINUTE_LIMIT else "PER_HOUR_IP_CAP" if state["count"] >= cap else None
                    if reason is None and done:
                        state["minute"] += 1
                        state["count"] += 1
                allowed.append(reason is None)
                reasons.append(reason)
            yield batch.assign(allowed=allowed, reason=reasons)[names]

    return ordered.mapInPandas(run, schema)


def acquire_models(log: DataFrame, ts: str, order: str, chain: dict[str, int], zone: str = ZONE) -> DataFrame:
    """Adds the model that serves each request: the first of the chain with budget left in its hour.

    As every request takes one, the n-th of an hour goes to the model whose
    share of the cumulated budgets n falls into.
    """
    hour = hour_key(F.col(ts), zone)
    n = F.row_number().over(Window.partitionBy(hour).orderBy(ts, order))
    model, ends = F.lit(None).cast("string"), 0
    shares = []
    for name, budget in chain.items():
        ends += budget
        shares.append((name, ends))
    for name, end in reversed(shares):
        model = F.when(F.col("_n") <= end, F.lit(name)).otherwise(model)
    return log.withColumn("_n", n).withColumn("model", model).drop("_n")


def acquire_available(log: DataFrame, marks: DataFrame, ts: str, order: str, chain: dict[str, int], zone: str = ZONE) -> DataFrame:
    """``acquire_models`` with marks (model, ts) of models that are unavailable until the next hour.

    A mark counts after the requests of its instant.  An hour's requests stream
    through one state.
    """
    asked = log.withColumn("_mark", F.lit(None).cast("string"))
    rows = asked.unionByName(marks.select(F.col("ts").alias(ts), F.col("model").alias("_mark")), allowMissingColumns=True)
    rows = rows.withColumn("_hour", F.unix_millis(hour_key(F.col(ts), zone).cast("timestamp")))
    ordered = rows.repartition("_hour").sortWithinPartitions("_hour", ts, F.asc_nulls_first("_mark"), order)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema), "model string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, left = None, {}
        for batch in batches:
            models = []
            for hour, mark in zip(batch["_hour"], batch["_mark"], strict=True):
                if hour != now:
                    now, left = hour, dict(chain)
                model = None
                if isinstance(mark, str):
                    left[mark] = 0
                else:
                    model = next((m for m in chain if left[m] > 0), None)
                    if model:
                        left[model] -= 1
                models.append(model)
            yield batch.assign(model=models)[batch["_mark"].isna()][[*log_names, "model"]]

    log_names = log.columns
    return ordered.mapInPandas(run, schema)


def skips_first_call(remaining: Column, budget: Column) -> Column:
    """Whether less than half of the primary model's budget is left."""
    return remaining < F.floor(budget * 0.5)
