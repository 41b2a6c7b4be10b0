"""Structured Streaming over folders to which files are added.

The batch operators have no unbounded input; these are the parts of them that need no look-back over
the whole stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def interval_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def bin_counts(stream: DataFrame, width: int, time: str = "loaded_at", late: str = "7 days", per: str = "1 day") -> DataFrame:
    """Intervals that meet a bin, per chr, bin and window of arrival; every bin an interval meets counts it. Rows later than ``late`` behind the
    newest one are dropped by the watermark. Rows without a usable interval are not counted."""
    usable = stream.filter("chr is not null and start_pos < end_pos").withWatermark(time, late)
    met = usable.withColumn("bin", F.explode(F.expr(f"sequence(cast(floor(start_pos / {width}) as bigint), cast(floor((end_pos - 1) / {width}) as bigint))")))
    return met.groupBy(F.window(time, per), "chr", "bin").agg(F.count(F.lit(1)).alias("n"))


def distinct_deliveries(stream: DataFrame, keys: list[str], time: str = "loaded_at", late: str = "7 days") -> DataFrame:
    """First delivery of each row within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
