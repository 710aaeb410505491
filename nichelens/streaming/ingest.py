"""Ingest of signals as a stream: parse, deduplicate within a watermark, append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from nichelens.operators.store import append_new
from nichelens.session import table_exists

KEY = ("source_id", "entity", "metric", "ts")
#: Days of one batch that are named to the scan of the table; with more it reads all of them.
MAX_DAYS = 400


def read_files(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def deduplicated(stream: DataFrame, keys: Sequence[str] = KEY, late: str = "30 days") -> DataFrame:
    """Each key once; state is kept only as long as rows may be late."""
    return stream.where("ts is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = KEY) -> StreamingQuery:
    """Append what is new to a table, batch by batch, and end when all input is read. A batch that is run again after a failure adds nothing.

    The table is partitioned by the day of ts, which is part of the key: a batch is held against the days it has rows of, not against the whole table.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("day", F.coalesce(F.to_date("ts").cast("string"), F.lit("none")))
        if table_exists(spark, path):
            days = [r[0] for r in rows.select("day").distinct().limit(MAX_DAYS + 1).collect()]
            old = spark.read.schema(rows.schema).parquet(path)
            old = old.where(F.col("day").isin(days)) if len(days) <= MAX_DAYS else old
        else:
            old = rows.limit(0)
        append_new(old, rows, keys, ["id"]).select(rows.columns).write.mode("append").partitionBy("day").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Signals and their sum per source and hour, late rows within the watermark included."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "source_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("source_id", F.col("window.start").alias("hour"), "n", "total")
