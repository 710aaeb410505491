"""Top N items within every group (problem 3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichelens.session import materialize, quoted

#: At most this many groups are taken for heavy, so their keys may be broadcast.
MAX_HEAVY = 1000


def best_scores(df: DataFrame, group: Sequence[str], item: str, score: str) -> DataFrame:
    """Each item once per group, with its highest score.

    Rows with a NULL group key, NULL item, NULL or NaN score do not compete.
    Repeated rows combine before the shuffle.
    """
    s = F.col(quoted(score)).cast("double")
    keys = [F.col(quoted(g)).alias(f"_g{i}") for i, g in enumerate(group)]
    rows = df.select(*keys, F.col(quoted(item)).alias("_item"), s.alias("_score"))
    for c in rows.columns:
        rows = rows.where(F.col(c).isNotNull())
    return rows.where(~F.isnan("_score")).groupBy(*rows.columns[:-1]).agg(F.max("_score").alias("_score"))


def top_n(df: DataFrame, group: Sequence[str], item: str, score: str, n: int = 10, heavy_rows: int = 50_000, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """Ranks 1 to ``n`` of every group by ``score`` descending, then ``item`` ascending.

    Columns: the group's, ``item``, ``score`` and ``rank_no``. A group with
    fewer items gives fewer rows. See best_scores for ties, repeats and NULLs.

    Hot-cold split by exact group counts. A group is heavy from
    max(heavy_rows, items / max_heavy) items on, hence at most ``max_heavy`` keys
    are broadcast. Heavy groups are sorted by range of (group, score, item), which
    spreads one group over many tasks even if all its scores are equal; each
    slice (the salt) keeps its own best n, and those compete at the end. Light
    groups go through an ordinary window. Both results are united.
    """
    best = materialize(best_scores(df, group, item, score), "best")
    keys = [f"_g{i}" for i in range(len(group))]
    counts = materialize(best.groupBy(*keys).agg(F.count("*").alias("_n")), "counts")
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(heavy_rows, (total or 0) / max_heavy)
    order = [F.desc("_score"), F.asc("_item")]
    rank = lambda rows, *by: rows.withColumn("rank_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank_no") <= n)
    if (largest or 0) < limit:
        ranked = rank(best, *keys)
    else:
        heavy = F.broadcast(counts.where(F.col("_n") >= limit).select(*keys))
        slices = best.join(heavy, keys, "left_semi").repartitionByRange(*[F.asc(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id())
        local = rank(slices, *keys, "_slice").drop("rank_no", "_slice")
        ranked = rank(local, *keys).unionByName(rank(best.join(heavy, keys, "left_anti"), *keys))
    return ranked.select(*[F.col(k).alias(g) for k, g in zip(keys, group, strict=True)], F.col("_item").alias(item), F.col("_score").alias(score), "rank_no")
