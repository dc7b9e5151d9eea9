"""Joins of messages with issue-tracker tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.fields import ticket_details
from ..functions.text import annotate_tickets, list_size
from ..sources.tables import latest_tickets
from .keys import listed, lookup

MESSAGE_KEY = ["channel", "message_id"]
META_FIELDS = ["ticket_id", "summary", "status", "priority", "assignee"]


def mentioned(messages: DataFrame, *carry: str) -> DataFrame:
    """One row per (message, ticket), with the ticket's position in the message."""
    keep = [c for c in carry if c not in MESSAGE_KEY]
    return messages.select(
        *MESSAGE_KEY, *keep, F.posexplode(F.array_distinct("jira_tickets")).alias("pos", "ticket_id")
    )


def with_tickets(messages: DataFrame) -> DataFrame:
    return messages.filter(list_size(F.col("jira_tickets")) > 0)


def ticket_metadata(messages: DataFrame, tickets: DataFrame) -> DataFrame:
    """(channel, message_id, jira_metadata) of messages that mention tickets: one entry per
    ticket in mention order, unknown tickets with null fields."""
    newest = latest_tickets(tickets.select(*META_FIELDS, "cached_at", "dt")).select(*META_FIELDS)
    entries = lookup(mentioned(messages), newest, ["ticket_id"], spread=MESSAGE_KEY, large=True)
    entry = F.struct("pos", F.struct(*META_FIELDS).alias("meta"))
    lists = entries.groupBy(*MESSAGE_KEY).agg(F.sort_array(F.collect_list(entry)).alias("_meta"))
    metas = F.transform("_meta", lambda e: e["meta"]).cast(schemas.array(schemas.TICKET_META))
    return lists.select(*MESSAGE_KEY, metas.alias("jira_metadata"))


def enrich(messages: DataFrame, tickets: DataFrame) -> DataFrame:
    """Adds ``jira_metadata``; a message without tickets gets an empty list.

    Only messages that mention tickets are shuffled.
    """
    plain = messages.filter(list_size(F.col("jira_tickets")) == 0).withColumn(
        "jira_metadata", F.array().cast(schemas.array(schemas.TICKET_META))
    )
    rich = with_tickets(messages).join(ticket_metadata(messages, tickets), MESSAGE_KEY)
    return rich.select(*plain.columns).unionByName(plain)


def message_tickets(messages: DataFrame, tickets: DataFrame, how: str = "left") -> DataFrame:
    """One row per (message, ticket) with the newest snapshot's fields."""
    newest = latest_tickets(
        tickets.select(*META_FIELDS, "blocked_by", "cached_at", "dt")
    ).drop("cached_at", "dt")
    pairs = mentioned(messages, "user_id", "user_real_name", "text", "event_ts")
    return lookup(pairs, newest, ["ticket_id"], how, spread=MESSAGE_KEY, large=True)


def by_status(messages: DataFrame, tickets: DataFrame, status: str) -> DataFrame:
    """Messages about tickets whose newest status is ``status``."""
    return message_tickets(messages, tickets, "inner").filter(
        F.col("status") == status
    )


def about_blocked(messages: DataFrame, tickets: DataFrame) -> DataFrame:
    return message_tickets(messages, tickets, "inner").filter(list_size(F.col("blocked_by")) > 0)


def mentions_by_status(messages: DataFrame, tickets: DataFrame) -> DataFrame:
    """Distinct messages and tickets per status and priority; unknown tickets are null."""
    newest = latest_tickets(tickets.select("ticket_id", "status", "priority", "cached_at", "dt"))
    known = newest.select("ticket_id", "status", "priority", F.col("ticket_id").alias("known_id"))
    pairs = lookup(mentioned(messages), known, ["ticket_id"], spread=MESSAGE_KEY, large=True)
    by = ["status", "priority"]
    said = pairs.select(*by, *MESSAGE_KEY).distinct().groupBy(*by)
    named = pairs.select(*by, "known_id").distinct().groupBy(*by)
    said = said.agg(F.count("*").alias("messages_mentioning"))
    named = named.agg(F.count("known_id").alias("unique_tickets")).toDF("_s", "_p", "unique_tickets")
    same = F.col("status").eqNullSafe(F.col("_s")) & F.col("priority").eqNullSafe(F.col("_p"))
    return said.join(named, same).drop("_s", "_p")


def cross_channel(messages: DataFrame) -> DataFrame:
    """Tickets mentioned in more than one channel: mentions, channels and their names."""
    per_channel = mentioned(messages).groupBy("ticket_id", "channel").agg(F.count("*").alias("n"))
    totals = per_channel.groupBy("ticket_id").agg(F.sum("n").alias("mention_count"))
    lists = listed(
        per_channel.select("ticket_id", "channel"),
        ["ticket_id"],
        "channel",
        "channel_count",
        "channels",
    )
    return totals.join(lists.filter(F.col("channel_count") > 1), "ticket_id")


def ticket_partials(messages: DataFrame) -> DataFrame:
    """Per ticket, author, channel and day: mentions and the first one."""
    return (
        mentioned(messages, "event_ts", "user_id", "dt")
        .groupBy("ticket_id", "user_id", "channel", "dt")
        .agg(F.count("*").alias("n"), F.min("event_ts").alias("first"))
    )


def ticket_rollup(messages: DataFrame) -> DataFrame:
    """Per ticket: channels, messages, mentions and the first mention."""
    per_channel = (
        mentioned(messages, "event_ts")
        .groupBy("ticket_id", "channel")
        .agg(F.count("*").alias("n"), F.min("event_ts").alias("first"))
    )
    return _rolled_up(per_channel)


def rolled_up_tickets(parts: DataFrame) -> DataFrame:
    """The roll-up from :func:`ticket_partials`."""
    per_channel = parts.groupBy("ticket_id", "channel").agg(
        F.sum("n").alias("n"), F.min("first").alias("first")
    )
    return _rolled_up(per_channel)


def _rolled_up(per_channel: DataFrame) -> DataFrame:
    totals = per_channel.groupBy("ticket_id").agg(
        F.sum("n").alias("mention_count"), F.min("first").alias("first_mentioned")
    )
    lists = listed(
        per_channel.select("ticket_id", "channel"),
        ["ticket_id"],
        "channel",
        "channel_count",
        "channels",
    )
    return totals.join(lists, "ticket_id")


def ticket_notes(messages: DataFrame, tickets: DataFrame) -> DataFrame:
    """(channel, message_id, ticket_notes): known ticket ids of a message with their details.

    Rows that share a message id share their notes.
    """
    newest = latest_tickets(tickets)
    details = newest.select(
        "ticket_id", ticket_details(F.struct(*[F.col(c) for c in newest.columns])).alias("details")
    )
    found = lookup(
        mentioned(messages), details, ["ticket_id"], "inner", spread=MESSAGE_KEY, large=True
    )
    return found.groupBy(*MESSAGE_KEY).agg(
        F.map_from_entries(F.collect_set(F.struct("ticket_id", "details"))).alias("ticket_notes")
    )


def annotated(text: Column) -> Column:
    """The text with each known ticket id followed by its bracketed details."""
    notes = F.col("ticket_notes")
    return F.when(notes.isNull(), text).otherwise(annotate_tickets(text, notes))


def annotate(messages: DataFrame, tickets: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``annotated_text``. Only messages that mention tickets are shuffled."""
    rich = with_tickets(messages).join(ticket_notes(messages, tickets), MESSAGE_KEY, "left")
    rich = rich.withColumn("annotated_text", annotated(F.col(text))).drop("ticket_notes")
    plain = messages.filter(list_size(F.col("jira_tickets")) == 0).withColumn(
        "annotated_text", F.col(text)
    )
    return rich.select(*plain.columns).unionByName(plain)
