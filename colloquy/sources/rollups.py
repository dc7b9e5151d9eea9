"""Roll-up tables that follow the stored messages, and the index from tickets to partitions.

Per (dt, channel) partition of the messages two tables hold partial sums below ``rollups``: of
users, and of tickets by user. After an upsert only the partitions that it touched are counted
anew; reports merge the partials of all partitions. The ticket partials also are the posting
lists of an index: they name the partitions whose messages mention a ticket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import analytics, tickets
from ..session import shared_folder
from .store import ROWS_PER_FILE, upsert_messages
from .tables import read_messages, read_typed

PARTITION = ["dt", "channel"]
_PLACE = schemas.struct(dt=schemas.STRING, channel=schemas.STRING).fields
USER_PARTS = T.StructType(
    schemas.struct(user_id=schemas.STRING, n=schemas.LONG, threads=schemas.LONG, counted=schemas.FLAG).fields
    + _PLACE
)
TICKET_PARTS = T.StructType(
    schemas.struct(
        ticket_id=schemas.STRING, user_id=schemas.STRING, n=schemas.LONG, first=schemas.INSTANT,
        counted=schemas.FLAG,
    ).fields
    + _PLACE
)


def users_path(root: str) -> str:
    return f"{root.rstrip('/')}/rollups/users"


def tickets_path(root: str) -> str:
    return f"{root.rstrip('/')}/rollups/tickets"


def _swap(rows: DataFrame, touched: DataFrame, path: str) -> None:
    """Replace the touched partitions of a table of partials.

    A partition without rows is replaced by a row that isn't counted, or what an edit has taken
    away would stay in it.
    """
    marks = touched.withColumn("counted", F.lit(False))
    marked = rows.withColumn("counted", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    (
        marked.hint("rebalance", *PARTITION)
        .sortWithinPartitions(*PARTITION, rows.columns[0])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy(*PARTITION)
        .parquet(path)
    )


def refresh(spark: SparkSession, root: str, touched: DataFrame | None = None) -> None:
    """Count the partials of the touched (dt, channel) partitions anew; without ``touched``
    those of all."""
    messages = read_messages(spark, root)
    if touched is None:
        touched = messages.select(*PARTITION).distinct()
    else:
        touched = touched.select(*PARTITION).distinct()
        first, last = touched.agg(F.min("dt"), F.max("dt")).first()
        messages = messages.filter(F.col("dt").between(first, last))
        messages = messages.join(touched, PARTITION, "left_semi")
    _swap(analytics.user_partials(messages), touched, users_path(root))
    _swap(tickets.ticket_partials(messages), touched, tickets_path(root))


def upsert_and_refresh(
    spark: SparkSession, batch: DataFrame, root: str, sequence: str | None = None
) -> None:
    """Merge a batch of messages and bring the roll-ups of its partitions up to date.

    A replay after a failure between the two steps repairs the roll-ups, as both may be repeated.
    """
    shared_folder(spark)
    touched = batch.select(*PARTITION).distinct().checkpoint()  # a batch may read what changes
    upsert_messages(spark, batch, root, sequence)
    refresh(spark, root, touched)


def user_parts(spark: SparkSession, root: str) -> DataFrame:
    return read_typed(spark, users_path(root), USER_PARTS).filter("counted").drop("counted")


def ticket_parts(spark: SparkSession, root: str) -> DataFrame:
    return read_typed(spark, tickets_path(root), TICKET_PARTS).filter("counted").drop("counted")


def user_rollup(spark: SparkSession, root: str) -> DataFrame:
    """The roll-up of users from partials, as :func:`analytics.user_rollup` counts it."""
    pairs = ticket_parts(spark, root).select("user_id", "ticket_id").distinct()
    return analytics.rolled_up_users(user_parts(spark, root), pairs)


def ticket_rollup(spark: SparkSession, root: str) -> DataFrame:
    """The roll-up of tickets from partials, as :func:`tickets.ticket_rollup` counts it."""
    return tickets.rolled_up_tickets(ticket_parts(spark, root))


def cross_channel(spark: SparkSession, root: str) -> DataFrame:
    """Tickets mentioned in more than one channel, from partials."""
    rows = ticket_rollup(spark, root).filter(F.col("channel_count") > 1)
    return rows.select("ticket_id", "mention_count", "channel_count", "channels")


def about_ticket(spark: SparkSession, root: str, ticket_id: str) -> DataFrame:
    """Messages of all days that mention a ticket; only partitions on its posting list are read."""
    postings = ticket_parts(spark, root).filter(F.col("ticket_id") == ticket_id)
    places = postings.select(*PARTITION).distinct()
    messages = read_messages(spark, root).join(F.broadcast(places), PARTITION, "left_semi")
    return messages.filter(F.array_contains("jira_tickets", ticket_id))
