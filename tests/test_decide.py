from datetime import datetime, timedelta, timezone

import pytest

from nichelens.plans.decide import check_cases, chosen_run, decide, niche_ranks, write_snapshot

T0 = datetime(2026, 9, 20, 12, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def lake(spark):
    texts = spark.createDataFrame([(i, f"s{i % 3}", T0 - timedelta(days=i % 50), f"i wish a sun hat {i} existed") for i in range(60)], "id long, source_id string, ts timestamp, text string")
    products = spark.createDataFrame([(1, "Sun Hats", "pets", list(range(10))), (2, "mat", "pets", [11, 999]), (3, "sun hat", "toys", [12, 13]), (4, "x", "nope", [1])], "product_id long, phrase string, category string, doc_ids array<long>")
    cats = spark.createDataFrame([("pets", 15.0, 140.0, 80.0), ("toys", 10.0, 100.0, 72.0)], "id string, price_low double, price_high double, feasibility_prior double")
    signals = spark.createDataFrame([(1, "sun hat", "nice", "score", 5.0, T0, {"comments": "3"}), (2, "mat", None, "views", 5.0, T0, None)], "id long, entity string, quote string, metric string, value double, ts timestamp, metadata map<string,string>")
    return texts, products, cats, signals


def test_two_runs_agree_and_append_once(spark, lake, tmp_path):
    one, two = (sorted(tuple(r) for r in decide(*lake, T0).collect()) for _ in range(2))
    assert one and one == two and {(r[0], r[1]) for r in one} == {("pets", "sun hat"), ("pets", "mat"), ("toys", "sun hat")}
    scored = decide(*lake, T0, "v1")
    assert all(r.ci is None and r.p10 <= r.p50 <= r.p90 and 0 <= r.mgs <= 100 for r in scored.collect())
    path = str(tmp_path / "scores")
    for _ in range(2):
        write_snapshot(scored, path, "r1")
    write_snapshot(scored, path, "r2")
    assert {r.run_id: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {"r1": 3, "r2": 3}


def test_niches_cases_and_runs(spark):
    m = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "category string, momentum double")
    p = spark.createDataFrame([("a", 100.0), ("c", 50.0)], "category string, passion double")
    q = spark.createDataFrame([("a", 50.0)], "category string, pain double")
    got = {r.category: r.score for r in niche_ranks(m, p, q).collect()}
    assert got == {"a": pytest.approx(53), "b": pytest.approx(10), "c": pytest.approx(25)}
    cases = spark.createDataFrame([(i, i, 40.0, 60.0, "fad") for i in range(4)], "case_id int, candidate_id int, low double, high double, label string")
    newest = spark.createDataFrame([(0, 50.0, "fad"), (1, 50.0, "trend"), (2, 70.0, "trend")], "candidate_id int, mgs double, fad_label string")
    assert [r.state for r in check_cases(cases, newest).orderBy("case_id").collect()] == ["verified", "partial", "failed", "unchecked"]
    runs = spark.createDataFrame([("1", "nightly", "ok", '{"L1": "ok"}', T0), ("2", "manual", "ok", '{"L1": "ok"}', T0 + timedelta(1)), ("3", "nightly", "failed", "{}", None)], "id string, trigger_kind string, status string, layer_status string, started_at timestamp")
    assert chosen_run(runs).first().id == "1" and chosen_run(runs.where("id > '1'")).first().id == "2" and chosen_run(runs.limit(0)).count() == 0
