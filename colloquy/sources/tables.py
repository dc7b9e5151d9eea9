"""Scans over the stored tables.

Layout below a root folder: ``raw/messages/dt=…/channel=…``, ``raw/tickets/dt=…``
and ``users``. One scan covers all days and channels; day and channel predicates
become partition filters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date as Date
from datetime import timedelta
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.instants import from_iso
from ..operators.keys import latest_per_key

_EMPTY_LISTS = {
    "reactions": schemas.array(schemas.REACTION),
    "files": schemas.array(schemas.FILE),
    "jira_tickets": schemas.STRINGS,
}


def messages_path(root: str) -> str:
    return f"{root.rstrip('/')}/raw/messages"


def tickets_path(root: str) -> str:
    return f"{root.rstrip('/')}/raw/tickets"


def users_path(root: str) -> str:
    return f"{root.rstrip('/')}/users"


def read_typed(
    spark: SparkSession, path: str, schema: T.StructType, skip_corrupt: bool = False
) -> DataFrame:
    """Parquet under a declared schema: absent columns are null, an absent path gives no rows.

    An unreadable file fails the job. Only a reader that asks for it skips such files; what
    feeds an overwrite never does.
    """
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", str(skip_corrupt).lower())
    try:
        return reader.parquet(path).select(*schema.fieldNames())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _completed(stored: DataFrame) -> DataFrame:
    """Stored messages with what older files lack: lists, and ``event_ts`` as last column."""
    filled = {
        c: F.coalesce(F.col(c), F.array().cast(kind)) for c, kind in _EMPTY_LISTS.items()
    }
    at = F.coalesce("event_ts", from_iso(F.col("timestamp"))).alias("event_ts")
    return stored.withColumns(filled).select(*schemas.MESSAGES_STORED.fieldNames(), at)


def read_messages(spark: SparkSession, root: str, skip_corrupt: bool = False) -> DataFrame:
    """All messages plus ``event_ts``, the instant to order and compare by."""
    return _completed(read_typed(spark, messages_path(root), schemas.MESSAGES_FILE, skip_corrupt))


def read_instants(
    spark: SparkSession, root: str, start: Column, end: Column, skip_corrupt: bool = False
) -> DataFrame:
    """The messages of an inclusive range of instants.

    Days become a partition filter, and the stored instant is compared in the Parquet scan, which
    passes over row groups and pages outside the range. Files without it are read whole.
    """
    stored = read_typed(spark, messages_path(root), schemas.MESSAGES_FILE, skip_corrupt)
    skipped = F.col("event_ts").between(start, end) | F.col("event_ts").isNull()
    return in_instants(_completed(stored.filter(skipped)), start, end)


def equals_all(filters: Mapping[str, Any] | None) -> Column:
    """Conjunction of equality tests; ``None`` matches null."""
    wanted = F.lit(True)
    for name, value in (filters or {}).items():
        wanted = wanted & F.col(name).eqNullSafe(F.lit(value))
    return wanted


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy("event_ts", "channel", "message_id")


def pruned(
    messages: DataFrame, start: str, end: str, channels: Sequence[str] | None = None
) -> DataFrame:
    """Inclusive day range and optional channel list, as partition filters."""
    df = messages.filter(F.col("dt").between(start, end))
    return df.filter(F.col("channel").isin(*channels)) if channels else df


def scan_channel(
    messages: DataFrame, channel: str, day: str, filters: Mapping[str, Any] | None = None
) -> DataFrame:
    return in_order(pruned(messages, day, day, [channel]).filter(equals_all(filters)))


def scan_channel_range(
    messages: DataFrame,
    channel: str,
    start: str,
    end: str,
    filters: Mapping[str, Any] | None = None,
) -> DataFrame:
    return in_order(pruned(messages, start, end, [channel]).filter(equals_all(filters)))


def scan_all_channels(
    messages: DataFrame, day: str, filters: Mapping[str, Any] | None = None
) -> DataFrame:
    df = pruned(messages, day, day).filter(equals_all(filters))
    return in_order(df.withColumn("channel_name", F.col("channel")))


def trailing_days(end: str, days: int) -> tuple[str, str]:
    """Inclusive day range of ``days`` days that ends on ``end``."""
    last = Date.fromisoformat(end)
    return (last - timedelta(days=days - 1)).isoformat(), end


def in_instants(messages: DataFrame, start: Column, end: Column) -> DataFrame:
    """Inclusive range of instants; the days it touches become a partition filter."""
    exact = F.col("event_ts").between(start, end)
    days = F.col("dt").between(
        F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd")
    )
    return messages.filter(days & exact)


def in_window(messages: DataFrame, as_of: Column, days: int = 0, hours: int = 4) -> DataFrame:
    """Messages of the last ``days`` and ``hours`` before ``as_of``."""
    length = F.expr(f"INTERVAL '{int(days)} {int(hours)}' DAY TO HOUR")
    return in_instants(messages, as_of - length, as_of)


def read_tickets(spark: SparkSession, root: str) -> DataFrame:
    """All ticket snapshots of all days."""
    return read_typed(spark, tickets_path(root), schemas.TICKETS_STORED)


def latest_tickets(tickets: DataFrame) -> DataFrame:
    """The newest snapshot of each ticket."""
    return latest_per_key(tickets, ["ticket_id"], [F.col("cached_at"), F.col("dt")])


def read_users(spark: SparkSession, root: str, skip_corrupt: bool = False) -> DataFrame:
    """One profile per user, the last cached one; a missing bot flag means human."""
    users = read_typed(spark, users_path(root), schemas.USERS, skip_corrupt)
    users = users.withColumn("is_bot", F.coalesce("is_bot", F.lit(False)))
    return latest_per_key(users, ["user_id"], [F.col("cached_at")])


def get_user(users: DataFrame, user_id: str) -> DataFrame:
    return users.filter(F.col("user_id") == user_id)


def user_count(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("users"))
