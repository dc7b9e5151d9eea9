"""Time buckets of top-level messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.instants import BUCKETS, bucket_end, bucket_start
from ..functions.text import blank_to_null


def time_buckets(messages: DataFrame, bucket: str = "hour") -> DataFrame:
    """Messages per bucket and channel, with the bucket's own total and channel count.

    Rows without a readable time are left out of hour and day buckets. ``none`` gives
    one bucket from the first to the last row and keeps them.
    """
    if bucket not in BUCKETS:
        raise ValueError(f"Invalid bucket_type: {bucket}")
    rows = messages.withColumn("channel", F.coalesce(blank_to_null(F.col("channel")), F.lit("unknown")))
    if bucket == "none":
        per_channel = rows.groupBy("channel").agg(
            F.count("*").alias("messages"),
            F.min("event_ts").alias("first"),
            F.max("event_ts").alias("last"),
        )
        sums = per_channel.agg(
            F.min("first"), F.max("last"), F.sum("messages"), F.count("*")
        ).toDF("first", "last", "messages", "channels")
        start, end, total, channels = (sums.select(c).scalar() for c in sums.columns)
        return per_channel.select(
            start.alias("bucket_start"),
            end.alias("bucket_end"),
            "channel",
            "messages",
            total.alias("bucket_messages"),
            channels.alias("bucket_channels"),
        )
    else:
        per_channel = (
            rows.filter(F.col("event_ts").isNotNull())
            .groupBy(
                bucket_start(F.col("event_ts"), bucket).alias("bucket_start"), F.col("channel")
            )
            .agg(F.count("*").alias("messages"))
            .select(
                "bucket_start",
                bucket_end(F.col("bucket_start"), bucket).alias("bucket_end"),
                "channel",
                "messages",
            )
        )
    # One row per bucket and channel is left here, so the windows are small.
    one = W.partitionBy("bucket_start")
    return per_channel.select(
        "bucket_start",
        "bucket_end",
        "channel",
        "messages",
        F.sum("messages").over(one).alias("bucket_messages"),
        F.count("*").over(one).alias("bucket_channels"),
    )
