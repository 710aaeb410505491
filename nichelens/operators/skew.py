"""Joins of members with their group that hold up when one group has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest number of hot groups that is broadcast.
MAX_HOT = 500
#: Groups below this many members are never hot.
MIN_HOT = 20_000
#: Largest weight, as in characters, of the hot groups that are broadcast, and copies of each of them beyond it.
MAX_WEIGHT, SALTS = 64 << 20, 32


def attach_groups(members: DataFrame, groups: DataFrame, keys: list[str], size: str, max_hot: int = MAX_HOT, min_hot: int = MIN_HOT, weight: Column | None = None, max_weight: int = MAX_WEIGHT) -> DataFrame:
    """Inner join of ``members`` with ``groups`` (one row per key) on ``keys``.

    ``size`` is the exact number of members of a group. A group is hot from
    max(min_hot, total / max_hot) members on, so there are at most ``max_hot``
    of them whatever the data are; these are broadcast and their members stay
    where they are. All other groups are below that size and go through a
    shuffled join. ``groups`` should be a written table: it is read three times.
    Groups with a NULL key take no part. Where rows of ``groups`` can be long, ``weight`` is
    the length of one: hot groups of more than ``max_weight`` in all are not broadcast
    but joined by a shuffle with their members spread over SALTS copies of each.
    """
    total, largest = groups.agg(F.sum(size), F.max(size)).first()
    limit = max(min_hot, (total or 0) / max_hot)
    if (largest or 0) < limit:
        return members.join(groups, keys)
    hot, cold = groups.where(F.col(size) >= limit), groups.where(F.col(size) < limit)
    some = members.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    if weight is not None and (hot.agg(F.sum(weight)).first()[0] or 0) > max_weight:
        spread = members.withColumn("_salt", (F.rand(7) * SALTS).cast("int")).join(hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"]).drop("_salt")
        return spread.unionByName(some)
    return members.join(F.broadcast(hot), keys).unionByName(some)


def broadcast_if_small(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """``rows`` marked for a broadcast if there are at most ``most`` of them, else as they are, for a shuffled join."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
