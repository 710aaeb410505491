"""Queues of open work, decisions, caches, retention and reports about sources, as DataFrame operations on any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichelens.functions.constants import TRANSIENT_MARKERS
from nichelens.functions.text import collapse
from nichelens.operators.ordering import first_per, global_row_number, latest_per
from nichelens.operators.store import expired
from nichelens.session import materialize


def open_work(items: DataFrame, done: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """``items`` whose key is not in ``done``, with their ``place`` in a total order. NULL keys are open."""
    return global_row_number(items.join(done.select(key).distinct(), key, "left_anti"), order, "place")


def with_decisions(items: DataFrame, decisions: DataFrame, key: str, order: Sequence[str], status: str = "status") -> DataFrame:
    """``items`` with ``status`` and ``label`` after their newest decision: kept, dropped, or active without one. ``decisions`` has key, decision and the columns of ``order``."""
    last = latest_per(decisions.select(key, "decision", *order), [key], list(order)).select(key, "decision")
    d = items.join(last, key, "left")
    word = F.when(F.col("decision") == "keep", "kept").when(F.col("decision") == "drop", "dropped").otherwise("active")
    return d.withColumn(status, word).withColumn("label", F.coalesce(F.concat(F.lit("judge: "), "decision"), F.lit("unjudged")))


def first_distinct(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column], most: int, out: str) -> DataFrame:
    """One row a key: the first ``most`` distinct values in ``order`` as an array, and ``n_<out>``, how many there are.

    Values are made distinct before they are ranked, and the window keeps ``most`` of each key, so a key with a third of all rows is never gathered. ``order`` is
    a list of aggregates that say where a value stands. NULL values don't count; keys without any give no row.
    """
    names = [f"_o{i}" for i in range(len(order))]
    some = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[c.alias(n) for c, n in zip(order, names, strict=True)])
    some = materialize(some, "distinct")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*names, value))
    top = some.withColumn("_r", place).where(F.col("_r") <= most)
    top = top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v")))), lambda x: x["v"]).alias(out))
    return top.join(some.groupBy(*keys).agg(F.count("*").alias(f"n_{out}")), list(keys))


def grounded(quote: Column, url: Column) -> Column:
    """Whether a row says something and where."""
    return F.coalesce((F.trim(quote) != "") & (F.trim(url) != ""), F.lit(False))


def cache_key(gate: Column, model: Column, **fields: Column) -> Column:
    """SHA-256 of 'gate|model|' and the fields as JSON with sorted names; white space in texts counts as one space, missing fields as null."""
    body = F.to_json(F.struct(*[collapse(fields[k]).alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("", gate, F.lit("|"), model, F.lit("|"), body), 256)


def first_writes(entries: DataFrame, existing: DataFrame | None, key: str, order: Sequence[str], at: str, days: int = 30) -> DataFrame:
    """Entries that enter a cache: the first of each key by ``order`` that is not there yet, with ``expires_at``."""
    new = first_per(entries, [key], list(order))
    new = new if existing is None else new.join(existing.select(key), key, "left_anti")
    return new.withColumn("expires_at", F.col(at) + F.make_dt_interval(F.lit(days)))


def retained(table: DataFrame, ts: str, as_of: Column, days: int, protected: bool = False) -> DataFrame:
    """The rows that a sweep leaves: none is older than ``days``; rows without a time stay; a protected table stays whole."""
    return table if protected else table.where(~expired(F.col(ts), as_of, days))


def outcomes(items: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per run and source: items, unparsed, repeated, status; and one per source without items.

    ``items`` has id, run_id, source_id, own_hash, parsed; ``sources`` has id, enabled. failed: nothing could be parsed; identical: every item
    came before from this source; degraded: some item could not be parsed; else ok. A source without items is skipped if it is not enabled and silent otherwise.
    """
    first = materialize(items.groupBy("source_id", "own_hash").agg(F.min("id").alias("first")), "firsts")
    d = items.join(first, ["source_id", "own_hash"], "left").groupBy("run_id", "source_id").agg(
        F.count("*").alias("items"), F.count_if(~F.col("parsed")).alias("unparsed"), F.count_if(F.col("id") > F.col("first")).alias("repeated")
    )
    word = F.when(F.col("unparsed") == F.col("items"), "failed").when(F.col("repeated") == F.col("items"), "identical").when(F.col("unparsed") > 0, "degraded").otherwise("ok")
    idle = sources.select(F.col("id").alias("source_id"), "enabled").join(items.select("source_id").distinct(), "source_id", "left_anti")
    zero = F.lit(0).cast("bigint")
    idle = idle.select(F.lit(None).cast("string").alias("run_id"), "source_id", zero.alias("items"), zero.alias("unparsed"), zero.alias("repeated"), F.when(F.col("enabled"), "silent").otherwise("skipped").alias("status"))
    return d.withColumn("status", word).unionByName(idle)


def commonest(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, top, n): the most frequent value of each key, of equal ones the greatest; NULL and empty values don't count."""
    counts = df.where(F.col(value) != "").groupBy(*keys, value).agg(F.count("*").alias("_c"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_c", value)).alias("top"), F.max("_c").alias("n"))


def transient(message: Column) -> Column:
    """Whether an error's message names a trouble that may pass."""
    low = F.lower(message)
    hit = F.lit(False)
    for m in TRANSIENT_MARKERS:
        hit = hit | low.contains(m)
    return F.coalesce(hit, F.lit(False))


def membership(a: DataFrame, b: DataFrame, key: str, states: tuple[str, str, str]) -> DataFrame:
    """(key, state) of all keys of both sides: in the first only, in the second only, or in both. NULL keys are left out."""
    x = a.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(True))
    y = b.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(True))
    return x.join(y, key, "full_outer").select(key, F.when(F.col("_b").isNull(), states[0]).when(F.col("_a").isNull(), states[1]).otherwise(states[2]).alias("state"))


def clean_list(values: Column, most: int, length: int) -> Column:
    """The first ``most`` values that are not blank, trimmed and cut to ``length`` characters."""
    return F.slice(F.filter(F.transform(values, lambda v: F.left(F.trim(v), F.lit(length))), lambda v: v != ""), 1, most)


def band(value: Column, edges: Sequence[tuple[float, str]], below: str, missing: str = "na") -> Column:
    """The name of the first edge that ``value`` reaches, from the highest down."""
    out = F.when(value.isNull(), missing)
    for edge, name in edges:
        out = out.when(value >= edge, name)
    return out.otherwise(below)


def mover_lists(moves: DataFrame, key: str, value: str, n_moved: int = 10, n_new: int = 30) -> DataFrame:
    """(list, place, key): the greatest rises and falls, and the best of those that were not there before. ``moves`` has delta and previous."""
    by = lambda rows, name, n, *order: global_row_number(rows.orderBy(*order).limit(n), order, "place").select(F.lit(name).alias("list"), F.col("place").cast("int").alias("place"), key)
    up = by(moves.where("delta > 0"), "risers", n_moved, F.desc("delta"), F.asc(key))
    down = by(moves.where("delta < 0"), "fallers", n_moved, F.asc("delta"), F.asc(key))
    return up.unionByName(down).unionByName(by(moves.where("previous is null"), "new", n_new, F.desc(value), F.asc(key)))
