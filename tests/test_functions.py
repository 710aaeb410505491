import hashlib

import pytest
from pyspark.sql import functions as F

from nichelens.functions import numbers as n
from nichelens.functions import text as t
from nichelens.functions.constants import PAIN_MARKERS, INTENT_MARKERS, COMPLEXITY_MARKERS


def one(spark, expr, **cols):
    names = ", ".join(cols)
    row = spark.createDataFrame([tuple(cols.values())], names.split(", ")) if cols else spark.range(1)
    return row.select(expr.alias("x")).first().x


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_series_functions_by_hand(spark):
    assert one(spark, n.ewma(arr(0, 0, 0, 10), 0.5)) == 5
    assert one(spark, n.ewma(arr(0, 0, 0, 10), 1.0)) == 10
    assert one(spark, n.ewma(arr(0, 0, 0, 10), 0.1)) == pytest.approx(1)
    assert one(spark, n.ewma(F.array().cast("array<double>"), 0.3)) is None
    assert one(spark, n.ewma_series(arr(1, 3), 0.5)) == [1, 2]
    assert one(spark, n.normalized_slope(arr(1, 2, 3))) == pytest.approx(0.5)
    assert one(spark, n.normalized_slope(arr(4))) == 0
    with pytest.raises(ValueError):
        n.ewma(arr(1), 0)


def test_scalars(spark):
    lit = lambda x: F.lit(float(x))
    assert [one(spark, n.growth_ratio(lit(a), lit(b))) for a, b in ((5, 0), (0, 10), (1000, 1))] == [5, -1, 9]
    assert one(spark, n.price_score(lit(60))) == pytest.approx(48.57, abs=0.01)
    assert one(spark, n.price_score(lit(5))) == 0 and one(spark, n.price_score(lit(500))) == 100
    assert one(spark, n.log_compress(lit(20), 10)) == 1 and one(spark, n.log_compress(lit(-1), 10)) == 0
    assert one(spark, n.clamp(lit("nan"), 1, 2)) == 1
    assert one(spark, n.safe_ratio(lit(1), lit(0))) == 0
    assert one(spark, n.sigmoid(lit(0))) == 0.5
    assert one(spark, n.backoff(1, 2, 10, F.lit(5))) == 10


def test_phrases(spark):
    assert one(spark, t.normalize_phrase(F.lit("Kid's  LED-Strips!"))) == "kids led strips"
    assert one(spark, t.canonical_phrase(F.lit("LED Strips, batteries, boxes, glass, news, virus, mats"))) == "led strip battery box glass news virus mat"
    assert one(spark, t.tokens_of(F.lit(" -- "))) == []
    assert one(spark, t.penalty_terms(F.lit("FDA-cleared medical device patents"))) == ["fda", "medical device"]
    assert one(spark, t.contains_word(F.lit("outstanding desk"), "standing desk")) is False
    assert one(spark, t.has_marker(F.lit("It BROKE"), PAIN_MARKERS)) is True
    assert one(spark, t.has_marker(F.lit(None).cast("string"), PAIN_MARKERS)) is False
    assert one(spark, t.has_marker(F.lit("bestow"), INTENT_MARKERS)) is True  # substrings count
    assert one(spark, t.markers_in(F.lit("Solar app, solar pump"), COMPLEXITY_MARKERS)) == 3
    assert one(spark, t.collapse(F.lit(" a \n b c "))) == "a b c"


def test_content_hash_and_seed(spark):
    parts = F.array(F.lit("a\r\nb "), F.lit("c"))
    assert one(spark, t.content_hash(parts)) == hashlib.sha256(b"a\nb\0c\0").hexdigest()
    assert one(spark, t.content_hash(F.array().cast("array<string>"))) == hashlib.sha256(b"").hexdigest()
    assert one(spark, t.revenue_seed(F.lit("circ saw"), F.lit("tools_diy"), "rev1")) == 2662193188


def test_engagement_and_hosts(spark):
    m = F.create_map(F.lit("Comments"), F.lit("3"), F.lit("likes"), F.lit("x"), F.lit("rank"), F.lit("9"), F.lit("replies"), F.lit("-2"))
    assert one(spark, t.engagement(F.lit("SCORE"), F.lit(2.0), m)) == 5
    assert one(spark, t.engagement(F.lit("price"), F.lit(2.0), F.lit(None).cast("map<string,string>"))) == 0
    hosts = F.array(F.lit("a.example"), F.lit("*.b.example"))
    assert [one(spark, t.host_allowed(F.lit(u), hosts)) for u in ("https://a.example/x", "https://x.a.example/", "https://x.b.example/", "https://b.example/", "no url")] == [True, False, True, False, False]
