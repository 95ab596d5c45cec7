"""Groups that arrive in pieces, as streams (an extension: batch plans need none of this)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_ids(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each id within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_scores(stream: DataFrame, time: str, group: str, value: str, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Tumbling counts and means of a score for each group; late rows beyond ``delay`` are out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size).alias("w"), group).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), group, "n", "mean")


def sessions(df: DataFrame, time: str, group: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a group's rows, split where the gap is exceeded; works on streams with a watermark and on tables."""
    return df.groupBy(F.session_window(time, gap).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n")
