"""Running totals, positions and percentiles over a global or per-group order, without one task holding it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichelens.operators.skew import attach_groups
from nichelens.session import materialize


def running_total(df: DataFrame, order: Sequence[Column | str], value: Column | str, out: str) -> DataFrame:
    """``df`` with the total of ``value`` up to and with each row in ``order``, which must be total.

    Rows are partitioned by range of the order; the totals of the partitions, as few as there are partitions, are summed up and broadcast.
    """
    value = F.col(value) if isinstance(value, str) else value
    parts = materialize(df.withColumn("_v", value).repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("_pid").agg(F.sum("_v").alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = F.sum("_v").over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(before), "_pid").withColumn(out, F.col("_before") + inside).drop("_pid", "_v", "_before")


def global_row_number(df: DataFrame, order: Sequence[Column | str], out: str = "row_no") -> DataFrame:
    """Positions from 1 in a total order of all rows."""
    return running_total(df, order, F.lit(1).cast("bigint"), out)


def percentile_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str, digits: int = 9, big: int = 2_000_000, largest: int | None = None) -> DataFrame:
    """Percentile ranks 0 to 100 of ``value`` within each group of ``keys`` (none: over all rows), ties averaged, a single row 50.

    Values are compared after rounding to ``digits`` places. Rows with a NULL or NaN value get NULL and don't count. NULL keys form one group.
    Groups up to ``big`` rows rank in a window. If a group is larger, the distinct values with their counts are
    summed up in the order (keys, value) by ranges, and ranks come back by a join, so no group is held in one task.
    ``largest`` is the size of the largest group, if known.
    """
    keys = list(keys)
    v = F.round(F.when(F.isnan(F.col(value).cast("double")), None).otherwise(F.col(value)), digits)
    rows = df.withColumn("_val", v)
    some = rows.where("_val is not null")
    counts = some.groupBy(*keys, "_val").agg(F.count("*").alias("_c"))
    if largest is None:
        largest = counts.groupBy(*keys).agg(F.sum("_c").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if keys and largest <= big:
        part, n = Window.partitionBy(*keys), F.count("_val").over(Window.partitionBy(*keys))
        ties = F.count("_val").over(Window.partitionBy(*keys, "_val"))
        below = F.rank().over(part.orderBy(F.col("_val").asc_nulls_last())) - 1
        pct = F.when(n == 1, F.lit(50.0)).otherwise(F.lit(100.0) * (below + (ties - 1) / 2) / (n - 1))
        return rows.withColumn(out, F.when(F.col("_val").isNotNull(), pct)).drop("_val")
    summed = materialize(running_total(counts, [*keys, "_val"], "_c", "_upto"), "ranks")
    groups = summed.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(f"_k{i}") for i, k in enumerate(keys)], *([] if keys else [F.lit(0).alias("_k0")]))
    groups = materialize(groups.agg(F.min(F.col("_upto") - F.col("_c")).alias("_base"), F.sum("_c").alias("_n"), F.count("*").alias("_distinct")), "rank-groups")
    names = [c for c in groups.columns if c.startswith("_k")]
    tagged = lambda d: d.select("*", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(f"_k{i}") for i, k in enumerate(keys)], *([] if keys else [F.lit(0).alias("_k0")]))
    ranked = attach_groups(tagged(summed), groups, names, "_distinct")
    pct = F.when(F.col("_n") == 1, F.lit(50.0)).otherwise(F.lit(100.0) * (F.col("_upto") - F.col("_c") - F.col("_base") + (F.col("_c") - 1) / 2) / (F.col("_n") - 1))
    ranked = materialize(ranked.select(*names, "_val", "_c", pct.alias(out)), "ranked-values")
    back = attach_groups(tagged(some), ranked, [*names, "_val"], "_c").drop("_c", *names, "_val")
    rest = rows.where("_val is null").drop("_val").withColumn(out, F.lit(None).cast("double"))
    return back.select(*rest.columns).unionByName(rest)


def group_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median of each group, the mean of the two middle values. Distinct values with counts are summed up by ranges; no group is held in one task."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_val")).agg(F.count("*").alias("_c"))
    summed = materialize(running_total(counts, [*keys, "_val"], "_c", "_upto"), "medians")
    groups = materialize(summed.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_c")).alias("_base"), F.sum("_c").alias("_n"), F.count("*").alias("_distinct")), "median-groups")
    rows = attach_groups(summed, groups, keys, "_distinct")
    first, last = F.col("_upto") - F.col("_c") - F.col("_base"), F.col("_upto") - F.col("_base")
    at = lambda p: F.max(F.when((first < p) & (p <= last), F.col("_val")))
    return rows.groupBy(*keys).agg(((at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor(F.col("_n") / 2) + 1)) / 2).alias(out))


def group_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, sum, mean, median, standard deviations (sample and population, 0 below two rows), min and max of each group without NULL keys."""
    x, keys, zero = F.col(value), list(keys), F.lit(0.0)
    stats = df.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.coalesce(F.sum(x), zero).alias("total"),
        F.coalesce(F.avg(x), zero).alias("mean"),
        F.when(F.count(x) < 2, zero).otherwise(F.coalesce(F.stddev_samp(x), zero)).alias("sd_sample"),
        F.coalesce(F.stddev_pop(x), zero).alias("sd_population"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
    )
    return stats.join(group_median(df, keys, value), keys, "left").withColumn("median", F.coalesce("median", zero))


def zscores(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Distance from the group's mean in sample standard deviations; 0 in a group of one value or one row. Group sums combine before the shuffle."""
    x = F.col(value)
    stats = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count("*").alias("_n"))
    stats = materialize(stats, "zstats")
    z = F.when((F.col("_lo") == F.col("_hi")) | F.col("_s").isNull(), F.lit(0.0)).otherwise((x - F.col("_m")) / F.col("_s"))
    return attach_groups(df, stats, list(keys), "_n").withColumn(out, z).drop("_m", "_s", "_lo", "_hi", "_n")


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: bool = False) -> DataFrame:
    """The last (or ``first``) row of each key by ``order``: an aggregation that combines before the shuffle, whatever a key's size is.

    Ties go by the other columns as far as these can be ordered.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    fine = [c for c, t in df.dtypes if c in rest and "map<" not in t and "variant" not in t]
    loose = [c for c in rest if c not in fine]
    by = F.struct(*[F.col(f"`{c}`") for c in [*order, *fine]])
    if loose:
        pick = F.min_by if first else F.max_by
        top = df.groupBy(*keys).agg((F.min if first else F.max)(by).alias("_t"), pick(F.struct(*[F.col(f"`{c}`") for c in loose]), by).alias("_u"))
    else:
        top = df.groupBy(*keys).agg((F.min if first else F.max)(by).alias("_t"))
    return top.select(*keys, *[F.col(f"_t.`{c}`").alias(c) for c in [*order, *fine]], *[F.col(f"_u.`{c}`").alias(c) for c in loose])


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return latest_per(df, keys, order, first=True)
