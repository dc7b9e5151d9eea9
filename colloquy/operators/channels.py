"""Channel configuration lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty, signal_mark, signal_weight, without_prefix


def split_by_id(channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Channels with a valid id (starts with C), and the others."""
    valid = or_empty(F.col("id")).startswith("C")
    return channels.filter(valid), channels.filter(~valid)


def _described(channels: DataFrame, prefix: str) -> DataFrame:
    return channels.select(
        F.col("name").alias(f"{prefix}_name"),
        F.col("id").alias(f"{prefix}_id"),
        F.col("description").alias(f"{prefix}_description"),
        F.col("signal_type").alias(f"{prefix}_signal"),
    )


def channel_context(requested: DataFrame, channels: DataFrame) -> DataFrame:
    """Each requested channel name with its configuration.

    The exact name wins, then the name with ``channel_`` put in front, then the name
    with ``channel_`` taken away; unknown channels keep null fields.
    """
    exact, added, stripped = (_described(channels, p) for p in ("a", "b", "c"))
    joined = (
        requested.join(exact, F.col("channel") == F.col("a_name"), "left")
        .join(added, F.concat(F.lit("channel_"), "channel") == F.col("b_name"), "left")
        .join(stripped, without_prefix(F.col("channel")) == F.col("c_name"), "left")
    )

    def first(field: str):
        return F.coalesce(*[F.col(f"{p}_{field}") for p in ("a", "b", "c")])

    signal = F.coalesce(first("signal"), F.lit("medium"))
    found = first("name").isNotNull()
    return joined.select(
        "channel",
        first("name").alias("config_name"),
        first("id").alias("channel_id"),
        first("description").alias("description"),
        F.when(found, signal_weight(signal)).alias("signal_weight"),
        F.when(found, signal_mark(signal)).alias("signal_mark"),
    )


def resolve_channels(requested: DataFrame, messages: DataFrame) -> DataFrame:
    """Requested names to stored channels: the name itself if it has data in ``messages``,
    else ``channel_`` plus the name, else null.

    Only the partition values of the scan are read.
    """
    stored = messages.select("channel").distinct()
    exact = stored.select(F.col("channel").alias("exact"))
    prefixed = stored.select(F.col("channel").alias("prefixed"))
    return (
        requested.join(exact, F.col("channel") == F.col("exact"), "left")
        .join(prefixed, F.concat(F.lit("channel_"), "channel") == F.col("prefixed"), "left")
        .select("channel", F.coalesce("exact", "prefixed").alias("stored_channel"))
    )
