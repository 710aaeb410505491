"""Score history: newest, deltas and moves per candidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichelens.operators.ordering import first_per, latest_per
from nichelens.operators.skew import attach_groups
from nichelens.session import materialize


def deltas(scores: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """(key, n, first_value, last_value, delta): first against last snapshot; delta is NULL for a single one. Aggregations only, so a key's size does not matter."""
    last = latest_per(scores.select(key, *order, value), [key], order).select(key, F.col(value).alias("last_value"))
    first = first_per(scores.select(key, *order, value), [key], order).select(key, F.col(value).alias("first_value"))
    n = scores.groupBy(key).agg(F.count("*").alias("n"))
    d = n.join(first, key).join(last, key)
    return d.withColumn("delta", F.when(F.col("n") > 1, F.col("last_value") - F.col("first_value")))


def moves(scores: DataFrame, key: str, order: Sequence[str], value: str, version: str) -> DataFrame:
    """(key, value, previous, delta) of each key's newest snapshot against the one before; NULL previous for a new key, NULL delta across versions."""
    rows = scores.select(key, *order, value, version)
    last = latest_per(rows, [key], order).withColumnRenamed(value, "_v").withColumnRenamed(version, "_ver")
    for c in order:
        last = last.withColumnRenamed(c, f"_l_{c}")
    last = materialize(last.join(rows.groupBy(key).agg(F.count("*").alias("_n")), key), "newest")
    older = attach_groups(rows, last, [key], "_n").where(F.struct(*order) < F.struct(*[F.col(f"_l_{c}").alias(c) for c in order]))
    before = latest_per(older.select(key, *order, value, version), [key], order).select(key, F.col(value).alias("previous"), F.col(version).alias("_pv"))
    m = last.join(before, key, "left")
    return m.select(key, F.col("_v").alias(value), "previous", F.when(F.col("_ver") == F.col("_pv"), F.col("_v") - F.col("previous")).alias("delta"))


def tree_hash(rows: DataFrame, keys: Sequence[str], position: str, line: str, width: int = 4096) -> DataFrame:
    """(keys, n, digest): SHA-256 over a group's lines in the order of their positions (from 0), as a tree of ``width`` lines a node.

    No node holds more than ``width`` digests, so a group of any size is hashed in parallel.
    """
    keys = list(keys)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    level = rows.select(*keys, F.col(position).alias("_p"), F.sha2(F.col(line), 256).alias("_h"))
    size = counts.agg(F.max("n")).first()[0] or 0
    while True:
        level = level.groupBy(*keys, F.floor(F.col("_p") / width).alias("_q")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda x: x["_h"]), ""), 256).alias("_h")).withColumnRenamed("_q", "_p")
        size = -(-size // width)
        if size <= 1:
            return level.join(counts, keys).select(*keys, "n", F.col("_h").alias("digest"))
