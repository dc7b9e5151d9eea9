"""Free SQL over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.threads import thread_table
from ..sources.tables import read_messages, read_tickets, read_users

DEFAULT_ROWS = 100


def register_views(spark: SparkSession, root: str) -> None:
    """Temp views ``messages``, ``tickets`` (all snapshots), ``users`` and ``threads``."""
    messages = read_messages(spark, root)
    messages.createOrReplaceTempView("messages")
    read_tickets(spark, root).createOrReplaceTempView("tickets")
    read_users(spark, root).createOrReplaceTempView("users")
    thread_table(messages).createOrReplaceTempView("threads")


def run_sql(spark: SparkSession, root: str, query: str, limit: int | None = None) -> DataFrame:
    """The query's result over the views; ``limit`` caps a listing for display."""
    register_views(spark, root)
    result = spark.sql(query)
    return result if limit is None else result.limit(limit)
