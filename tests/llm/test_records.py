import random

import pytest
from pyspark.sql import functions as F

from nichelens.llm.format_dups import canonical, collapse_formats, record_field, repeated_records
from nichelens.llm.top_n import top_n

SCHEMA = "product_id long, phrase string, category string, record string, id string"


def products(spark, rows):
    return spark.createDataFrame([(i, p, c, r, "clash") for i, p, c, r in rows], SCHEMA)


def test_canonical(spark):
    c = lambda s: spark.range(1).select(canonical(F.lit(s)).alias("x")).first().x
    assert c(" Kid’s_Yoga—MAT (2)\n") == "kidsyogamat2"
    assert c("Décor") == c("décor") == "décor" != c("decor")
    assert c("?!") == "" and c("") == ""


def test_record_notations(spark):
    f = lambda s, n="phrase": spark.range(1).select(record_field(F.lit(s), n).alias("x")).first().x
    assert f('{"reason": "r", "phrase": "a \\u00e9\\tb"}') == "a é\tb"
    assert f("category: c | phrase: a b  | reason: ") == "a b" and f("phrase: a b | category: c", "category") == "c"
    assert f("nothing here") is None and f("{broken") is None and f(None) is None


def test_copies_and_members(spark):
    df = products(
        spark,
        [
            (5, "LED-Strip", "Pets", None), (3, "led strip", "pets ", None), (3, "led strip", "pets ", None), (9, None, None, '{"category":"PETS","phrase":"Led Strip!"}'),
            (7, "led strip", None, "phrase: led strip | category: home"), (8, None, None, None), (2, None, None, None), (4, "", "", None), (6, "?", "!", ""),
        ],
    )
    got = sorted((r.keep_id, r.product_id) for r in repeated_records(df, "product_id", ["phrase", "category"], "record").withColumnRenamed("id", "product_id").collect())
    assert got == [(2, 8), (3, 5), (3, 9), (4, 6)]
    kinds = {r.keep_id: (r.n_rows, r.n_copies, r.collisions) for r in collapse_formats(df, "product_id", ["phrase", "category"], "record").collect()}
    assert kinds == {3: (4, 3, 0), 7: (1, 1, 0), 2: (2, 2, 0), 4: (2, 2, 0)}
    assert repeated_records(df.limit(0), "product_id", ["phrase", "category"], "record").count() == 0


def test_one_kind_holds_a_third(spark):
    rng = random.Random(1)
    rows = [(i, "Hot Kind" if i % 3 == 0 else f"p{rng.randrange(400)}", "c", None) for i in range(3000)]
    first = {}
    for i, p, _, _ in rows:
        first.setdefault(p.lower().replace(" ", ""), i)
    want = {(first[p.lower().replace(" ", "")], i) for i, p, _, _ in rows if first[p.lower().replace(" ", "")] != i}
    import nichelens.operators.skew as skew

    old = skew.attach_groups.__defaults__
    try:
        skew.attach_groups.__defaults__ = (500, 100)
        got = {(r.keep_id, r.id) for r in repeated_records(products(spark, rows), "product_id", ["phrase", "category"]).collect()}
    finally:
        skew.attach_groups.__defaults__ = old
    assert got == want


@pytest.mark.parametrize("heavy", [10, 10**9])
def test_top_n(spark, heavy):
    rng = random.Random(2)
    rows = [("r1", "hot", rng.randrange(600), float(rng.randrange(4)), 1) for _ in range(1500)] + [("r1", f"c{rng.randrange(5)}", rng.randrange(40), rng.random(), 1) for _ in range(100)]
    rows += [(None, "c", 1, 1.0, 1), ("r", None, 1, 1.0, 1), ("r", "c", None, 1.0, 1), ("r", "c", 1, None, 1), ("r", "c", 1, float("nan"), 1)]
    df = spark.createDataFrame(rows, "run_id string, category string, candidate_id long, mgs double, rank_no int")
    best = {}
    for r, c, i, m, _ in rows:
        if r and c and i is not None and m is not None and m == m:
            best[(r, c, i)] = max(m, best.get((r, c, i), m))
    want = set()
    for g in {(r, c) for r, c, _ in best}:
        mine = sorted((-m, i) for (r, c, i), m in best.items() if (r, c) == g)[:10]
        want |= {(*g, i, k + 1) for k, (_, i) in enumerate(mine)}
    got = top_n(df, ["run_id", "category"], "candidate_id", "mgs", heavy_rows=heavy)
    assert {(r.run_id, r.category, r.candidate_id, r.rank_no) for r in got.collect()} == want
    assert top_n(df.limit(0), ["run_id", "category"], "candidate_id", "mgs").count() == 0
