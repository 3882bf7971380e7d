"""Streaming forms (an extension; recorded data need none of it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_use(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_spread(stream: DataFrame, at: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Spread of repeated measurements in event-time windows."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(value).alias("n"), (F.max(value) - F.min(value)).alias("spread"))


def nearest(left: DataFrame, right: DataFrame, by: str, key: str, at: str, right_key: str, right_at: str, tolerance_s: float, late: str, width: str = "1 second") -> DataFrame:
    """Candidates of a stream-stream join within the tolerance, then the nearest one per left row once the watermark has passed its window.

    Both sides have timestamps; ties go to the earlier right row, then the smaller key.
    """
    span = F.expr(f"INTERVAL {tolerance_s} SECONDS")
    a = left.withWatermark(at, late).select(F.col(by).alias("_by"), key, at)
    b = right.withWatermark(right_at, late).select(F.col(by).alias("_rby"), right_key, right_at)
    near = a.join(b, (F.col("_by") == F.col("_rby")) & (F.col(right_at) >= F.col(at) - span) & (F.col(right_at) <= F.col(at) + span))
    seconds = F.col(right_at).cast("double")
    scored = near.select(key, at, F.struct(F.abs(seconds - F.col(at).cast("double")).alias("offset"), seconds.alias("at"), F.col(right_key).alias("other")).alias("_m"))
    # A left row lies in one window, which closes when no candidate of it can come any more.
    best = scored.groupBy(F.window(at, width), key).agg(F.min("_m").alias("_m"))
    return best.select(key, F.col("_m.other").alias(right_key), F.col("_m.offset").alias("offset"))
