"""Budgets, streaks and token buckets over ordered events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelens.operators.ordering import running_total
from nichelens.operators.skew import attach_groups
from nichelens.session import materialize


def group_running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Running total within each group, in an order that is total, by ranges of (keys, order): no group is held in one task. NULL keys are left out."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    whole = materialize(running_total(df.withColumn("_w", value), [*keys, *order], "_w", out), "running")
    base = materialize(whole.groupBy(*keys).agg(F.min(F.col(out) - F.col("_w")).alias("_base"), F.count("*").alias("_n")), "bases")
    return attach_groups(whole, base, list(keys), "_n").withColumn(out, F.col(out) - F.col("_base")).drop("_base", "_n", "_w")


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], cost: Column, cap: str) -> DataFrame:
    """Rows with ``spent`` (the cost of the group's rows before) and ``allowed`` (spent below the cap column). Costs are 0 or more."""
    d = group_running_total(df.withColumn("_cost", cost), keys, order, F.col("_cost"), "spent")
    return d.withColumn("spent", F.col("spent") - F.col("_cost")).withColumn("allowed", F.col("spent") < F.col(cap)).drop("_cost")


def streaks(df: DataFrame, order: Sequence[str], failed: Column, out: str = "streak") -> DataFrame:
    """Rows with the length of the run of failures that ends at them (0 on success), over one global total order."""
    d = df.withColumn("_f", F.coalesce(failed, F.lit(False)).cast("int"))
    d = running_total(d, order, F.lit(1) - F.col("_f"), "_island")
    d = group_running_total(d, ["_island"], order, F.col("_f"), out)
    return d.drop("_f", "_island")


def bucket_step(state: tuple[float, float, float | None, float], t: float, status: int, retry_after: float | None, rate: float, capacity: float, base: float = 30.0, most: float = 900.0) -> tuple[tuple, str]:
    """One request against a token bucket with backoff: (tokens, last time, blocked until, next wait) and the decision.

    A 429 blocks for the stated or the current wait, which doubles; a 2xx resets it.
    """
    level, last, until, wait = state
    if until is not None and t < until:
        return state, "backing_off"
    level = min(capacity, level + max(t - last, 0.0) * rate)
    if level < 1.0:
        return (level, t, None, wait), "rate_limited"
    level -= 1.0
    if status == 429:
        blocked = min(max(wait if retry_after is None else retry_after, 0.0), most)
        return (level, t, t + blocked, min(wait * 2, most)), "ok"
    return (level, t, None, base if 200 <= status < 300 else wait), "ok"


def token_bucket(requests: DataFrame, key: str, ts: str, rate: str, capacity: float = 1.0) -> DataFrame:
    """(key, ts, decision) of each request, by its key's bucket. ``requests`` may have status (default 200) and retry_after.

    A bucket is a fold over time, so one key is read by one task, in order and with constant memory: rows are sorted by Spark and
    streamed through, never collected.
    """
    cols = dict(requests.dtypes)
    rows = requests.select(
        F.col(key).alias("key"), F.unix_micros(F.col(ts)).alias("t"), F.col(rate).cast("double").alias("rate"),
        F.col("status").cast("int").alias("status") if "status" in cols else F.lit(200).alias("status"),
        F.col("retry_after").cast("double").alias("retry") if "retry_after" in cols else F.lit(None).cast("double").alias("retry"),
    ).where("key is not null and t is not null and rate > 0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            for k, t, r, s, ra in zip(pdf["key"], pdf["t"], pdf["rate"], pdf["status"], pdf["retry"], strict=True):
                if k != current:
                    current, state = k, (capacity, t / 1e6, None, 30.0)
                state, decision = bucket_step(state, t / 1e6, s, None if ra != ra else ra, r, capacity)
                out.append(decision)
            yield pd.DataFrame({"key": pdf["key"], "t": pdf["t"], "decision": out})

    done = rows.repartition("key").sortWithinPartitions("key", "t").mapInPandas(run, "key string, t bigint, decision string")
    return done.select(F.col("key").alias(key), F.timestamp_micros("t").alias(ts), "decision")
