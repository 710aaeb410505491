"""Dense daily series and the features drawn from them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelens.functions.constants import ALPHA, INTENT_MARKERS, PAIN_MARKERS
from nichelens.functions.numbers import clamp, growth_ratio, safe_ratio
from nichelens.functions.text import has_marker
from nichelens.session import utc_day


def dense(by_day: Column, as_of: date, days: int) -> Column:
    """The last ``days`` days up to ``as_of``, oldest first, from a map of day to value; missing days are 0."""
    all_days = F.sequence(F.date_sub(F.lit(as_of), days - 1), F.lit(as_of))
    return F.transform(all_days, lambda d: F.coalesce(F.try_element_at(by_day, d), F.lit(0.0)))


def daily_maps(points: DataFrame, keys: Sequence[str], as_of: date, days: int, value: Column | None = None, ts: str = "ts") -> DataFrame:
    """One row per key with ``by_day``, a map of at most ``days`` days to their sums. Sums combine before the shuffle, so a hot key sends one row a day and task."""
    day = utc_day(points, ts)
    daily = points.withColumn("_day", day).where((F.col("_day") <= F.lit(as_of)) & (F.col("_day") > F.date_sub(F.lit(as_of), days)))
    daily = daily.groupBy(*keys, "_day").agg(F.sum(F.lit(1.0) if value is None else value).alias("_x"))
    return daily.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_day", "_x"))).alias("by_day"))


def seasonality(by_day: Column, as_of: date, days: int = 90) -> Column:
    """|weekday mean - weekend mean| over the mean of both, between 0 and 5; 0 below two weeks."""
    if days < 14:
        return F.lit(0.0)
    all_days = F.sequence(F.date_sub(F.lit(as_of), days - 1), F.lit(as_of))
    mean = lambda keep: (lambda part: F.aggregate(part, F.lit(0.0), lambda a, d: a + F.coalesce(F.try_element_at(by_day, d), F.lit(0.0))) / F.size(part))(F.filter(all_days, keep))
    week, end = mean(lambda d: F.weekday(d) < 5), mean(lambda d: F.weekday(d) >= 5)
    both = (week + end) / 2
    return F.when(both == 0, F.lit(0.0)).otherwise(clamp(F.abs(week - end) / both, 0.0, 5.0))


def ewma_weight(age: Column, alpha: float, days: int) -> Column:
    """Weight of a day in the exponential average over ``days`` days seeded with the oldest: the fold in closed form."""
    return F.when(age == days - 1, F.pow(F.lit(1 - alpha), F.lit(days - 1))).otherwise(F.lit(alpha) * F.pow(F.lit(1 - alpha), age))


def _slope(age: Column, x: Column, days: int) -> Column:
    """normalized_slope of a dense window from its active days alone, as an aggregate."""
    inside = F.when(age < days, x).otherwise(F.lit(0.0))
    mean = F.sum(inside) / days
    xy = F.sum((F.lit((days - 1) / 2) - age) * inside)
    return F.when(mean == 0, F.lit(0.0)).otherwise(xy / (days * (days * days - 1) / 12) / F.abs(mean))


def entity_features(points: DataFrame, keys: Sequence[str], as_of: date, alpha: float = ALPHA) -> DataFrame:
    """Feature vector of each key from its points (ts, value, text, source_id).

    Future points count for texts, sources and recency but not for the series. Silent days are 0 and never built: the
    dense series' average, slopes and ratios are sums over active days. Both aggregations are partial before the shuffle, so a hot
    key sends a row a day and task; no more than its 365 daily sums are ever held together.
    """
    keys = list(keys)
    day = utc_day(points, "ts")
    text = F.col("text")
    facts = points.groupBy(*keys).agg(
        F.count("*").alias("n_points"),
        F.min(F.datediff(F.lit(as_of), day)).alias("days_since_last"),
        F.count_if(has_marker(text, PAIN_MARKERS)).alias("pain_signals"),
        F.count_if(has_marker(text, INTENT_MARKERS)).alias("intent_signals"),
        F.sort_array(F.collect_set(F.when(F.col("source_id") != "", F.col("source_id")))).alias("source_ids"),
        F.max("value").alias("engagement"),
    )
    age, x = F.col("_age"), F.col("_x")
    daily = points.select(*keys, F.datediff(F.lit(as_of), day).alias("_age"), "value").where((age >= 0) & (age < 365)).groupBy(*keys, "_age").agg(F.sum("value").alias("_x"))
    within = lambda n: F.sum(F.when(age < n, x).otherwise(F.lit(0.0)))
    workday = F.weekday(F.date_sub(F.lit(as_of), age)) < 5
    n_week = sum((as_of - timedelta(days=i)).weekday() < 5 for i in range(90))
    part = lambda keep: F.sum(F.when((age < 90) & keep, x).otherwise(F.lit(0.0)))
    series = daily.groupBy(*keys).agg(
        within(30).alias("volume_30d"),
        within(90).alias("volume_90d"),
        F.sum("_x").alias("volume_365d"),
        F.sum(F.when(age < 30, x * ewma_weight(age, alpha, 30)).otherwise(F.lit(0.0))).alias("ewma_30d"),
        _slope(age, x, 30).alias("slope_30d"),
        _slope(age, x, 90).alias("slope_90d"),
        _slope(age, x, 365).alias("slope_365d"),
        F.count_if((x > 0) & (age < 30)).cast("int").alias("active_days_30d"),
        F.count_if(x > 0).cast("int").alias("active_days_365d"),
        (F.max("_x") / F.median(F.when(x > 0, x))).alias("_spike"),
        (part(workday) / n_week).alias("_week"),
        (part(~workday) / (90 - n_week)).alias("_end"),
    )
    numbers = [c for c in series.columns if c not in keys]
    d = facts.join(series, keys, "left").fillna(0.0, [c for c in numbers if not c.startswith("active")]).fillna(0, ["active_days_30d", "active_days_365d"])
    both = (F.col("_week") + F.col("_end")) / 2
    prior = F.greatest(F.col("volume_90d") - F.col("volume_30d"), F.lit(0.0))
    return d.select(
        *keys,
        "n_points",
        "volume_30d",
        "volume_90d",
        "volume_365d",
        prior.alias("volume_prior_60d"),
        growth_ratio(F.col("volume_30d"), prior).alias("growth"),
        "ewma_30d",
        "slope_30d",
        "slope_90d",
        "slope_365d",
        "active_days_30d",
        "active_days_365d",
        "days_since_last",
        clamp(F.col("_spike"), 0.0, 100.0).alias("spike_ratio"),
        F.when(both == 0, F.lit(0.0)).otherwise(clamp(F.abs(F.col("_week") - F.col("_end")) / both, 0.0, 5.0)).alias("seasonality"),
        (F.col("active_days_365d") / F.lit(365.0)).alias("evergreen_ratio"),
        "pain_signals",
        safe_ratio(F.col("pain_signals"), F.col("n_points")).alias("pain_ratio"),
        "intent_signals",
        safe_ratio(F.col("intent_signals"), F.col("n_points")).alias("intent_ratio"),
        F.size("source_ids").alias("source_count"),
        "source_ids",
        "engagement",
    )
