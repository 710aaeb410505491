"""Rolling totals over trailing periods, silent days included (problem 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichelens.session import quoted, utc_day


def daily_totals(df: DataFrame, keys: dict[str, str], ts: str, value: str | None = None) -> DataFrame:
    """(entity_kind, entity_key, day, total) of each entity and UTC day.

    ``keys`` maps a kind to the column with its key. A row counts ``value``
    (NULL as 0), or 1 without ``value``. Rows with NULL ts or NULL key do not
    count. All kinds come from one scan; the sums combine before the shuffle, so
    an entity with a third of all rows sends one row a day and task.
    """
    amount = F.lit(1).cast("bigint") if value is None else F.coalesce(F.col(quoted(value)).cast("bigint"), F.lit(0).cast("bigint"))
    entity = F.explode(F.array(*[F.struct(F.lit(kind).alias("entity_kind"), F.col(quoted(c)).cast("string").alias("entity_key")) for kind, c in keys.items()]))
    return (
        df.select(utc_day(df, ts).alias("day"), amount.alias("_amount"), entity.alias("_e"))
        .where("day is not null and _e.entity_key is not null")
        .groupBy(F.col("_e.entity_kind").alias("entity_kind"), F.col("_e.entity_key").alias("entity_key"), "day")
        .agg(F.sum("_amount").alias("total"))
    )


def rolling_totals(daily: DataFrame, entity: Sequence[str] = ("entity_kind", "entity_key"), periods: Sequence[int] = (7, 30), active_bounds: bool = False) -> DataFrame:
    """Totals and averages of every calendar day over trailing periods.

    ``daily`` has one row per entity and active day: the ``entity`` columns,
    ``day`` and ``total``. The result has a row for each day from the entity's
    first to its last day (with ``active_bounds``: first and last day with a
    total above 0), silent days included: ``total``, and for each period n
    ``total_n`` (this day and the n-1 before it) and ``avg_n`` = total_n / n,
    days before the first counting as silent. No input rows: no rows.

    Range join by coarse buckets: time is cut into buckets as wide as the
    longest period, so a day's window touches its own bucket and the one before.
    Daily rows go to those two buckets, and the calendar is shuffled as one row
    per entity and bucket and unfolded to days behind the shuffle. Join and
    aggregation share the partitioning by (entity, bucket); an entity's history
    is never held in one task.
    """
    entity, width = list(entity), max(periods)
    bucket = lambda c: F.floor(F.unix_date(c) / F.lit(width)).cast("int")
    bounded = daily.where("total > 0") if active_bounds else daily
    calendar = (
        bounded.groupBy(*entity)
        .agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
        .withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_first")), bucket(F.col("_last")))))
        .repartition(*entity, "_bucket")
        .select(
            *entity,
            "_bucket",
            F.explode(
                F.sequence(
                    F.greatest("_first", F.date_from_unix_date(F.col("_bucket") * width)),
                    F.least("_last", F.date_from_unix_date(F.col("_bucket") * width + F.lit(width - 1))),
                    F.expr("interval 1 day"),
                )
            ).alias("day"),
        )
    )
    amounts = daily.select(*[F.col(c).alias(f"_e_{c}") for c in entity], F.col("day").alias("_day"), F.col("total").alias("_total"), F.explode(F.array(bucket(F.col("day")), bucket(F.col("day")) + 1)).alias("_b"))
    on = (F.col("_bucket") == F.col("_b")) & (F.col("_day") <= F.col("day")) & (F.col("_day") > F.date_sub("day", width))
    for c in entity:
        on = on & (F.col(c) == F.col(f"_e_{c}"))
    zero = F.lit(0).cast(dict(daily.dtypes)["total"])
    within = lambda n: F.coalesce(F.sum(F.when(F.col("_day") > F.date_sub("day", n), F.col("_total"))), zero)
    totals = [F.coalesce(F.sum(F.when(F.col("_day") == F.col("day"), F.col("_total"))), zero).alias("total")]
    for n in periods:
        totals += [within(n).alias(f"total_{n}"), (within(n) / F.lit(float(n))).alias(f"avg_{n}")]
    return calendar.join(amounts, on, "left").groupBy(*entity, "_bucket", "day").agg(*totals).drop("_bucket")


def activity(chunk_texts: DataFrame, ranked_scores: DataFrame) -> DataFrame:
    """Daily totals of sources (texts), categories and candidates (mentions).

    Rows delivered twice count once: texts by (id, source_id, ts), scores by the
    whole row, columns that can't be compared (maps) left aside.
    """
    texts = chunk_texts.select("id", "source_id", "ts").distinct()
    comparable = [quoted(c) for c, kind in ranked_scores.dtypes if "map<" not in kind and "variant" not in kind]
    ranked_scores = ranked_scores.select(*comparable)
    return daily_totals(texts, {"source": "source_id"}, "ts").unionByName(daily_totals(ranked_scores.distinct(), {"category": "category", "candidate": "candidate_id"}, "scored_at", "mentions"))
