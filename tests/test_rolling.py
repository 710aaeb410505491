from datetime import date, datetime, timedelta, timezone

from pyspark.sql import functions as F

from nichelens.operators.rolling import activity, daily_totals, rolling_totals

UTC = timezone.utc


def brute(events, periods=(7, 30)):
    out = {}
    for k in {k for k, _, _ in events}:
        mine = {}
        for e, d, n in events:
            if e == k:
                mine[d] = mine.get(d, 0) + n
        day = min(mine)
        while day <= max(mine):
            out[(k, day)] = tuple(sum(n for d, n in mine.items() if day - timedelta(days=p) < d <= day) for p in periods)
            day += timedelta(days=1)
    return out


def test_against_brute_force(spark):
    import random

    rng = random.Random(4)
    events = [(f"e{rng.randrange(3)}", date(2026, 1, 1) + timedelta(days=rng.randrange(140)), rng.randrange(3)) for _ in range(60)]
    events += [("hot", date(2026, 2, 1) + timedelta(days=i % 40), 1) for i in range(400)]
    df = spark.createDataFrame([(e, datetime(d.year, d.month, d.day, 23, 59, tzinfo=UTC), n) for e, d, n in events], "key string, ts timestamp, n int")
    got = rolling_totals(daily_totals(df, {"x": "key"}, "ts", "n")).collect()
    assert {(r.entity_key, r.day): (r.total_7, r.total_30) for r in got} == brute(events)
    assert all(abs(r.avg_7 * 7 - r.total_7) < 1e-9 and abs(r.avg_30 * 30 - r.total_30) < 1e-9 for r in got)


def test_days_are_utc_in_any_session_time_zone(spark):
    df = spark.createDataFrame([("a", 1767225599)], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))  # 2025-12-31 23:59:59
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert [r.day for r in daily_totals(df, {"x": "key"}, "ts").collect()] == [date(2025, 12, 31)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_nulls_empty_and_clashing_columns(spark):
    t = spark.createDataFrame([(1, "s", None, "d"), (2, None, datetime(2026, 1, 1, tzinfo=UTC), "d"), (3, "s", datetime(2026, 1, 1, tzinfo=UTC), "d"), (3, "s", datetime(2026, 1, 1, tzinfo=UTC), "d")], "id long, source_id string, ts timestamp, day string")
    r = spark.createDataFrame([(None, "c", datetime(2026, 1, 1, tzinfo=UTC), None), (5, None, datetime(2026, 1, 2, tzinfo=UTC), 4), (5, None, datetime(2026, 1, 2, tzinfo=UTC), 4)], "candidate_id long, category string, scored_at timestamp, mentions int")
    got = {(x.entity_kind, x.entity_key, x.total) for x in activity(t, r).collect()}
    assert got == {("source", "s", 1), ("category", "c", 0), ("candidate", "5", 4)}
    assert rolling_totals(activity(t.limit(0), r.limit(0))).count() == 0


def test_active_bounds(spark):
    d = spark.createDataFrame([("k", "a", date(2026, 1, 1), 0), ("k", "a", date(2026, 1, 3), 2), ("k", "a", date(2026, 1, 5), 0)], "entity_kind string, entity_key string, day date, total long")
    assert [r.day for r in rolling_totals(d, active_bounds=True).collect()] == [date(2026, 1, 3)]
    assert rolling_totals(d).count() == 5
