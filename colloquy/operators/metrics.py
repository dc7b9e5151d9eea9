"""Engagement metrics of views and per-channel analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import listed
from .people import author_name, leaders
from .tickets import mentioned

# Fixed value: replies from which a thread counts as highly engaged.
HIGH_ENGAGEMENT = 5


def view_metrics(
    rebuilt: DataFrame,
    view: list[str],
    stakeholders: DataFrame,
    threshold: int = HIGH_ENGAGEMENT,
) -> DataFrame:
    """Per view: messages, threads, replies, participants, depth, engagement, leadership.

    ``rebuilt`` has the columns of ``threads.rebuild``. Rows are first reduced to one per
    view and author name, so neither the distinct count nor the stakeholder join sees raw
    messages.
    """
    top = F.col("depth") == 0
    threaded = F.col("present_replies") > 0
    per_author = rebuilt.groupBy(*view, author_name().alias("author")).agg(
        F.count("*").alias("all_rows"),
        F.count_if(top).alias("tops"),
        F.count_if(threaded).alias("threads"),
        F.sum("present_replies").alias("replies"),
        F.count_if(F.col("present_replies") >= threshold).alias("engaged"),
    )
    lead = leaders(stakeholders).select("lower_name", F.lit(True).alias("leads"))
    weighed = per_author.join(lead, F.lower("author") == F.col("lower_name"), "left")
    zero = F.lit(0).cast("bigint")
    return weighed.groupBy(*view).agg(
        F.sum("tops").alias("total_messages"),
        F.sum("threads").alias("total_threads"),
        F.sum("replies").alias("total_replies"),
        F.count("author").alias("unique_participants"),
        F.coalesce(
            F.sum("replies") / F.nullif(F.sum("threads"), zero).cast("double"), F.lit(0.0)
        ).alias("avg_thread_depth"),
        F.sum("engaged").alias("high_engagement_threads"),
        F.coalesce(F.sum(F.when(F.col("leads"), F.col("all_rows"))), zero).alias(
            "leadership_messages"
        ),
    )


def view_footer(rebuilt: DataFrame, view: list[str]) -> DataFrame:
    """Per view: top-level messages, nested replies, threads with a reply."""
    return rebuilt.groupBy(*view).agg(
        F.count_if(F.col("depth") == 0).alias("messages"),
        F.sum("present_replies").alias("thread_replies"),
        F.count_if(F.col("present_replies") > 0).alias("active_threads"),
    )


def channel_analytics(messages: DataFrame) -> DataFrame:
    """Per channel: messages, active users and distinct tickets, with their lists."""
    per_name = messages.groupBy("channel", "user_id", "user_name").agg(F.count("*").alias("n"))
    totals = per_name.groupBy("channel").agg(F.sum("n").alias("messages_count"))
    per_user = (
        per_name.filter(F.col("user_id").isNotNull())
        .groupBy("channel", "user_id")
        .agg(F.coalesce(F.max("user_name"), F.lit("")).alias("u"))
    )
    users = listed(
        per_user.select("channel", "u"),
        ["channel"],
        "u",
        "active_users_count",
        "users",
    )
    pairs = mentioned(messages).select("channel", "ticket_id").distinct()
    tickets = listed(
        pairs, ["channel"], "ticket_id", "jira_tickets_count", "jira_items"
    )
    none = F.array().cast("array<string>")
    return (
        totals.join(users, "channel", "left")
        .join(tickets, "channel", "left")
        .select(
            F.col("channel").alias("channel_name"),
            "messages_count",
            F.coalesce("active_users_count", F.lit(0)).alias("active_users_count"),
            F.when(F.col("active_users_count").isNull(), none).otherwise(F.col("users")).alias("users"),
            F.coalesce("jira_tickets_count", F.lit(0)).alias("jira_tickets_count"),
            F.when(F.col("jira_tickets_count").isNull(), none)
            .otherwise(F.col("jira_items"))
            .alias("jira_items"),
        )
    )
