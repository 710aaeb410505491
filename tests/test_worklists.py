from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from nichelens.operators import skew
from nichelens.operators import worklists as w
from nichelens.session import table_exists

T0 = datetime(2026, 3, 1, tzinfo=timezone.utc)


def test_open_work_and_decisions(spark):
    items = spark.createDataFrame([(1, 5.0, "x"), (2, None, "x"), (3, 9.0, "x"), (None, 1.0, "x")], "cid int, mgs double, place_of string")
    done = spark.createDataFrame([(3, "keep", 1), (3, "drop", 2), (1, "keep", 1)], "cid int, decision string, at int")
    got = [(r.cid, r.place) for r in w.open_work(items, done, "cid", [F.desc_nulls_last("mgs"), F.asc_nulls_last("cid")]).orderBy("place").collect()]
    assert got == [(None, 1), (2, 2)]
    got = {r.cid: (r.status, r.label) for r in w.with_decisions(items, done, "cid", ["at"]).collect()}
    assert got == {1: ("kept", "judge: keep"), 2: ("active", "unjudged"), 3: ("dropped", "judge: drop"), None: ("active", "unjudged")}
    assert w.open_work(items.limit(0), done, "cid", ["mgs"]).count() == 0 and w.open_work(items, done.limit(0), "cid", ["mgs", "cid"]).count() == 4


def test_caps_keep_the_first_distinct_values(spark):
    rows = spark.createDataFrame([("a", "q1", 3), ("a", "q1", 1), ("a", "q2", 2), ("a", None, 0), ("b", "q3", 1), (None, "q4", 1), ("c", None, 1)], "k string, v string, t int")
    got = {r.k: (r.top, r.n_top) for r in w.first_distinct(rows, ["k"], "v", [F.min("t")], 1, "top").collect()}
    assert got["a"] == (["q1"], 2) and got["b"] == (["q3"], 1) and "c" not in got
    assert w.first_distinct(rows.limit(0), ["k"], "v", [F.min("t")], 1, "top").count() == 0


def test_cache_and_retention(spark):
    c = spark.createDataFrame([("a  b", "x", 1, T0), (" a b", "x", 2, T0), (None, "x", 3, T0), (None, None, 4, T0)], "phrase string, cat string, no int, at timestamp")
    c = c.withColumn("key", w.cache_key(F.lit("g"), F.lit("m"), phrase=F.col("phrase"), cat=F.col("cat")))
    keys = [r.key for r in c.orderBy("no").collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3
    new = w.first_writes(c, c.where("no = 3"), "key", ["no"], "at").orderBy("no").collect()
    assert [r.no for r in new] == [1, 4] and new[0].expires_at.replace(tzinfo=timezone.utc) == T0 + timedelta(days=30)
    t = spark.createDataFrame([(1, T0), (2, T0 - timedelta(days=31)), (3, None)], "id int, ts timestamp")
    assert sorted(r.id for r in w.retained(t, "ts", F.lit(T0), 30).collect()) == [1, 3] and w.retained(t, "ts", F.lit(T0), 30, protected=True).count() == 3


def test_outcomes_and_reports(spark):
    i = spark.createDataFrame([(1, "r", "s", "h", True), (2, "r2", "s", "h", True), (3, "r3", "s", "x", False), (4, "r4", "s", "y", True), (5, "r4", "s", "z", False), (6, None, "s", None, True)], "id int, run_id string, source_id string, own_hash string, parsed boolean")
    s = spark.createDataFrame([("s", True), ("off", False), ("idle", True)], "id string, enabled boolean")
    got = {(r.run_id, r.source_id): r.status for r in w.outcomes(i, s).collect()}
    assert got == {("r", "s"): "ok", ("r2", "s"): "identical", ("r3", "s"): "failed", ("r4", "s"): "degraded", (None, "s"): "ok", (None, "off"): "skipped", (None, "idle"): "silent"}
    d = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", ""), ("a", None), ("b", None)], "k string, v string")
    assert [(r.k, r.top, r.n) for r in w.commonest(d, ["k"], "v").collect()] == [("a", "y", 1)]
    m = {r.k: r.state for r in w.membership(d.select("k"), spark.createDataFrame([("b",), ("c",), (None,)], "k string"), "k", ("only a", "only b", "both")).collect()}
    assert m == {"a": "only a", "b": "both", "c": "only b"}
    moved = spark.createDataFrame([(1, 5.0, 1.0, 4.0), (2, 5.0, -1.0, 6.0), (3, 9.0, None, None), (4, 5.0, 1.0, 4.0)], "cid int, mgs double, delta double, previous double")
    assert [(r.list, r.place, r.cid) for r in w.mover_lists(moved, "cid", "mgs").orderBy("list", "place").collect()] == [("fallers", 1, 2), ("new", 1, 3), ("risers", 1, 1), ("risers", 2, 4)]


def test_predicates(spark):
    d = spark.createDataFrame([("HTTP 503", "q", "u", 51.0), ("fine", " ", "u", 21.0), (None, None, None, None), ("Timed out", "q", "", 3.0)], "m string, q string, u string, v double")
    r = d.select(w.transient(F.col("m")).alias("t"), w.grounded(F.col("q"), F.col("u")).alias("g"), w.band(F.col("v"), ((51, "high"), (21, "mid")), "low").alias("b")).collect()
    assert [tuple(x) for x in r] == [(True, True, "high"), (False, False, "mid"), (False, False, "na"), (True, False, "low")]
    assert spark.range(1).select(w.clean_list(F.array(F.lit(" abc "), F.lit("  "), F.lit(None), F.lit("de")), 2, 2).alias("x")).first().x == ["ab", "de"]


def test_long_hot_rows_are_salted(spark):
    members = spark.range(400).select((F.col("id") % 3 % 2).alias("k"), "id")
    groups = members.groupBy("k").agg(F.count("*").alias("n")).withColumn("text", F.repeat(F.lit("x"), 50))
    got = skew.attach_groups(members, groups, ["k"], "n", max_hot=2, min_hot=10, weight=F.length("text"), max_weight=60)
    assert got.count() == 400 and got.select("id").distinct().count() == 400


def test_missing_tables_are_told_from_unreadable_ones(spark, tmp_path):
    assert not table_exists(spark, str(tmp_path / "none")) and not table_exists(spark, str(tmp_path))
    spark.range(1).write.parquet(str(tmp_path / "t"))
    assert table_exists(spark, str(tmp_path / "t"))
