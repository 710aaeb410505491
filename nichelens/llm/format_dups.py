"""Duplicates hidden by formatting differences (problem 2)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from nichelens.functions.text import record_field
from nichelens.operators.skew import attach_groups
from nichelens.session import materialize, quoted


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Letters with combining marks as one character each, where there is one (NFC)."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def canonical(text: Column) -> Column:
    """Letters and digits only, lower case; accented letters stay distinct.

    Texts that hold combining marks are composed first, in Arrow batches to which all other texts go as NULL; marks that belong to no composed letter stay as
    they are. NULL gives NULL; a text of punctuation alone gives ''.
    """
    marked = text.rlike(r"\p{M}")
    whole = F.when(marked, composed(F.when(marked, text))).otherwise(text)
    return F.lower(F.regexp_replace(whole, r"[^\p{L}\p{N}\p{M}]+", ""))


def format_keys(df: DataFrame, id_col: str, fields: list[str], record: str | None = None) -> DataFrame:
    """(id, _h1, _h2): each record once, with the two halves of the 128-bit hash of its canonical fields.

    A NULL field is taken from ``record``, whatever that record's notation and
    field order are; a field found nowhere counts as its own value, distinct from ''.
    ``_check`` (64 bits under another seed) serves the collision check.
    """
    parts = []
    for f in fields:
        own = F.col(quoted(f))
        raw = own if record is None else F.coalesce(own, record_field(F.col(quoted(record)), f))
        parts.append(F.coalesce(canonical(raw), F.lit("\x00")))
    whole = F.concat_ws("\x1f", *parts)
    return df.select(F.col(quoted(id_col)).alias("id"), whole.alias("_c")).select(
        "id",
        F.conv(F.substring(F.md5("_c"), 1, 16), 16, -10).cast("bigint").alias("_h1"),
        F.conv(F.substring(F.md5("_c"), 17, 16), 16, -10).cast("bigint").alias("_h2"),
        F.xxhash64("_c", F.lit(7)).alias("_check"),
    )


def format_groups(keys: DataFrame) -> DataFrame:
    """One row per kind of record: hash, check, ``keep_id`` (smallest id), ``n_rows`` (rows), ``n_copies`` (distinct ids).

    Rows delivered twice count once in ``n_copies``. Both counts combine before
    the shuffle. The check hash is part of the key: two kinds whose 128-bit
    hashes collided stay apart, and ``collided`` marks them.
    """
    once = keys.groupBy("_h1", "_h2", "_check", "id").agg(F.count("*").alias("_n"))
    kinds = once.groupBy("_h1", "_h2", "_check").agg(F.min("id").alias("keep_id"), F.sum("_n").alias("n_rows"), F.count("*").alias("n_copies"))
    return kinds


def collapse_formats(df: DataFrame, id_col: str, fields: list[str], record: str | None = None) -> DataFrame:
    """One row per kind: ``keep_id``, ``n_rows``, ``n_copies`` and ``collisions``.

    ``collisions`` is the number of other kinds that share the 128-bit hash (0
    unless it failed). Empty input: no rows. Rows with a NULL id count as one record.
    """
    kinds = format_groups(format_keys(df, id_col, fields, record))
    same = kinds.groupBy("_h1", "_h2").agg(F.count("*").alias("_kinds"), F.collect_list(F.struct("keep_id", "n_rows", "n_copies")).alias("_k"))
    return same.select(F.explode("_k").alias("k"), (F.col("_kinds") - 1).alias("collisions")).select("k.keep_id", "k.n_rows", "k.n_copies", "collisions")


def repeated_records(df: DataFrame, id_col: str, fields: list[str], record: str | None = None) -> DataFrame:
    """(keep_id, id) of each record that is not the first of its kind.

    Kinds with copies are written as a table; their members are then found by a
    join whose hot kinds are broadcast (see attach_groups), so a kind with a third
    of all records is never gathered in one task.
    """
    keys = format_keys(df, id_col, fields, record)
    kinds = materialize(format_groups(keys).where("n_copies > 1"), "kinds")
    members = attach_groups(keys, kinds, ["_h1", "_h2", "_check"], "n_rows")
    return members.where("id > keep_id").select("keep_id", "id").distinct()
