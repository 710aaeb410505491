"""Writes without an update API: append what is new, merge, and compare, as DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelens.functions.text import canonical_phrase
from nichelens.operators.ordering import first_per


def append_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not there yet, the first of each key by ``order``. NULL keys are equal to each other, as a unique key without NULLs would never see them."""
    first = first_per(incoming, keys, order)
    old = existing.select(*[F.col(k).alias(f"_o_{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_o_{k}"))
        on = c if on is None else on & c
    return first.join(old, on, "left_anti")


def write_append(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Append-only sink: new files beside the old ones; there is no update and no delete."""
    w = df.write.mode("append").option("compression", "zstd")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def upsert_candidates(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Candidates (phrase, category, mentions, first_seen, last_seen) merged: mentions of the incoming side where it has the key, earliest first_seen, latest last_seen.

    Phrases are made canonical; incoming rows of one key are combined first (sum, min, max).
    """
    key = ["phrase", "category"]
    new = incoming.withColumn("phrase", canonical_phrase(F.col("phrase"))).groupBy(*key).agg(F.sum("mentions").alias("n_m"), F.min("first_seen").alias("n_f"), F.max("last_seen").alias("n_l"))
    old = existing.withColumn("phrase", canonical_phrase(F.col("phrase"))).groupBy(*key).agg(F.sum("mentions").alias("o_m"), F.min("first_seen").alias("o_f"), F.max("last_seen").alias("o_l"))
    m = old.join(new, key, "full_outer")
    return m.select(*key, F.coalesce("n_m", "o_m").alias("mentions"), F.least("o_f", "n_f").alias("first_seen"), F.greatest("o_l", "n_l").alias("last_seen"))


def sync_diff(registry: DataFrame, stored: DataFrame, owned: Sequence[str], key: str = "id") -> DataFrame:
    """(id, action, changed): insert, update with the changed columns, unchanged, disable (enabled but gone) or already-disabled."""
    r = registry.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in owned], F.lit(True).alias("_r"))
    s = stored.select(F.col(key), *[F.col(c).alias(f"s_{c}") for c in owned], F.lit(True).alias("_s"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"r_{c}").eqNullSafe(F.col(f"s_{c}")), F.lit(c)) for c in owned]))
    j = r.join(s, key, "full_outer").withColumn("_c", F.when(F.col("_r") & F.col("_s"), changed).otherwise(F.array().cast("array<string>")))
    action = F.when(F.col("_s").isNull(), "insert").when(F.col("_r").isNull(), F.when(F.col("s_enabled"), "disable").otherwise("already-disabled")).when(F.size("_c") > 0, "update").otherwise("unchanged")
    return j.select(key, action.alias("action"), F.array_join("_c", ",").alias("changed"))


def forward_cursor(current: Column, new: Column) -> Column:
    """The cursor after a write: NULL never clears it."""
    return F.coalesce(new, current)


def expired(ts: Column, as_of: Column, days: int) -> Column:
    return F.coalesce(ts < as_of - F.make_dt_interval(F.lit(days)), F.lit(False))
