"""Bars that land day by day, as a stream: each micro-batch is deduplicated and upserted, so files that are seen again change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import store

BARS = "symbol string, bar_date date, open double, high double, low double, close double, volume long"


def landed(spark: SparkSession, path: str) -> DataFrame:
    """A stream of bars from Parquet files as they appear in a folder."""
    return spark.readStream.schema(BARS).parquet(path)


def append_daily(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Upsert what has landed into the table by date and symbol, then stop; run again for what lands later."""

    def add(batch: DataFrame, _: int) -> None:
        store.Stored(batch.sparkSession, table, ("bar_date", "symbol"), "date_format(bar_date, 'yyyy-MM')").upsert(batch)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
