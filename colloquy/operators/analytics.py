"""Activity, engagement and ranking reports over messages.

Reports with distinct counts first reduce rows to one per combination of the counted
values, which shrinks the data before the second shuffle and keeps heavy keys even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import list_size, mention_ids
from .keys import listed
from .threads import THREAD_KEY
from .tickets import mentioned


def messages_per_user(messages: DataFrame) -> DataFrame:
    return messages.groupBy("user_real_name").agg(F.count("*").alias("messages"))


def user_activity(messages: DataFrame) -> DataFrame:
    """Messages and active days per user."""
    per_day = messages.groupBy("user_real_name", "dt").agg(F.count("*").alias("n"))
    return per_day.groupBy("user_real_name").agg(
        F.sum("n").alias("messages"), F.count("*").alias("active_days")
    )


def top_humans(messages: DataFrame, k: int = 10) -> DataFrame:
    humans = messages.filter(~F.col("user_is_bot"))
    return user_activity(humans).orderBy(F.desc("messages"), "user_real_name").limit(k)


def user_engagement(messages: DataFrame, k: int = 20) -> DataFrame:
    """The busiest users: messages, replies, channels, days, first and last day."""
    fine = messages.groupBy("user_real_name", "channel", "dt").agg(
        F.count("*").alias("n"), F.count_if("is_thread_reply").alias("replies")
    )
    return (
        fine.groupBy("user_real_name")
        .agg(
            F.sum("n").alias("total_messages"),
            F.sum("replies").alias("thread_replies"),
            F.count_distinct("channel").alias("channels_active"),
            F.count_distinct("dt").alias("active_days"),
            F.min(F.to_date("dt")).cast("string").alias("first_message"),
            F.max(F.to_date("dt")).cast("string").alias("last_message"),
        )
        .orderBy(F.desc("total_messages"), "user_real_name")
        .limit(k)
    )


def replies_per_thread(messages: DataFrame) -> DataFrame:
    return (
        messages.filter("is_thread_reply").groupBy(*THREAD_KEY).agg(F.count("*").alias("replies"))
    )


def thread_contributors(messages: DataFrame, more_than: int = 5) -> DataFrame:
    """Users with over ``more_than`` replies in one thread."""
    return (
        messages.filter("is_thread_reply")
        .groupBy(*THREAD_KEY, "user_real_name")
        .agg(F.count("*").alias("total_replies"))
        .filter(F.col("total_replies") > more_than)
    )


def daily_activity(messages: DataFrame, *also: str) -> DataFrame:
    """Messages per day and channel, and per further columns."""
    return messages.groupBy("dt", "channel", *also).agg(F.count("*").alias("message_count"))


def emoji_usage(messages: DataFrame) -> DataFrame:
    return (
        messages.filter("has_reactions")
        .select(F.explode("reactions").alias("r"))
        .groupBy(F.col("r.emoji").alias("emoji"))
        .agg(F.count("*").alias("usage_count"), F.sum("r.count").alias("reaction_total"))
    )


def hourly_heat_map(messages: DataFrame) -> DataFrame:
    return messages.groupBy("dt", F.hour("event_ts").cast("bigint").alias("hour")).agg(
        F.count("*").alias("message_count")
    )


def channel_comparison(messages: DataFrame) -> DataFrame:
    """Per channel: messages, users, replies and mean text length."""
    per_user = messages.groupBy("channel", "user_id").agg(
        F.count("*").alias("n"),
        F.count_if("is_thread_reply").alias("replies"),
        F.sum(F.char_length("text")).alias("characters"),
    )
    return per_user.groupBy("channel").agg(
        F.sum("n").alias("total_messages"),
        F.count("user_id").alias("unique_users"),
        F.sum("replies").alias("thread_replies"),
        (F.sum("characters") / F.sum("n").cast("double")).alias("avg_message_length"),
    )


def bots_and_humans(messages: DataFrame) -> DataFrame:
    """Messages and users by bot flag; users without a profile form the null group."""
    per_user = messages.groupBy("user_is_bot", "user_id").agg(F.count("*").alias("n"))
    return per_user.groupBy("user_is_bot").agg(
        F.sum("n").alias("message_count"), F.count("user_id").alias("unique_users")
    )


def trending(messages: DataFrame, k: int = 20) -> DataFrame:
    """Messages with the most reaction entries."""
    return (
        messages.filter("has_reactions")
        .select(
            "channel",
            "message_id",
            "text",
            list_size(F.col("reactions")).cast("bigint").alias("reaction_count"),
            "user_real_name",
            "timestamp",
        )
        .orderBy(F.desc("reaction_count"), "channel", "message_id")
        .limit(k)
    )


def long_threads(messages: DataFrame, more_than: int = 5) -> DataFrame:
    """Thread parents that announce more than ``more_than`` replies."""
    return messages.filter(F.col("is_thread_parent") & (F.col("reply_count") > more_than)).select(
        "channel",
        "message_id",
        F.col("user_real_name").alias("starter"),
        F.col("text").alias("topic"),
        "reply_count",
    )


def message_totals(messages: DataFrame) -> DataFrame:
    """Rows, users and days of the whole set, in one row."""
    fine = messages.groupBy("user_id", "dt").agg(F.count("*").alias("n"))
    return fine.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("messages"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("dt").alias("days"),
        F.min(F.to_date("dt")).cast("string").alias("first_day"),
        F.max(F.to_date("dt")).cast("string").alias("last_day"),
    )


def ticket_totals(tickets: DataFrame) -> DataFrame:
    """Snapshots, distinct tickets and distinct statuses, in one row."""
    fine = tickets.groupBy("ticket_id", "status").agg(F.count("*").alias("n"))
    return fine.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("snapshots"),
        F.count_distinct("ticket_id").alias("tickets"),
        F.count_distinct("status").alias("statuses"),
    )


def tickets_in_scope(messages: DataFrame) -> DataFrame:
    return mentioned(messages).select("ticket_id").distinct()


def mentions_in_scope(messages: DataFrame) -> DataFrame:
    return messages.select(F.explode(mention_ids(F.col("text"))).alias("user_id")).distinct()


def _with_user(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join by user, the group without a user included."""
    named = right.withColumnRenamed("user_id", "_user")
    return left.join(named, F.col("user_id").eqNullSafe(F.col("_user")), "left").drop("_user")


def user_partials(messages: DataFrame) -> DataFrame:
    """Per user, channel and day: messages and threads started."""
    return messages.groupBy("user_id", "channel", "dt").agg(
        F.count("*").alias("n"), F.count_if("is_thread_parent").alias("threads")
    )


def user_rollup(messages: DataFrame) -> DataFrame:
    """Per user: messages, threads started, daily mean, channels and tickets."""
    pairs = mentioned(messages, "user_id").select("user_id", "ticket_id").distinct()
    return rolled_up_users(user_partials(messages), pairs)


def rolled_up_users(fine: DataFrame, pairs: DataFrame) -> DataFrame:
    """The roll-up from :func:`user_partials` and distinct pairs of user and ticket."""
    per_channel = fine.groupBy("user_id", "channel").agg(
        F.sum("n").alias("n"), F.sum("threads").alias("threads")
    )
    days = fine.groupBy("user_id").agg(F.count_distinct("dt").alias("days"))
    totals = per_channel.groupBy("user_id").agg(
        F.sum("n").alias("message_count"),
        F.sum("threads").alias("thread_count"),
        F.min_by("channel", F.struct(-F.col("n"), "channel")).alias("most_active_channel"),
    )
    channels = listed(
        per_channel.select("user_id", "channel"),
        ["user_id"],
        "channel",
        "channel_count",
        "channels_active",
    )
    tickets = listed(
        pairs, ["user_id"], "ticket_id", "ticket_count", "jira_tickets_mentioned"
    )
    none = F.array().cast("array<string>")
    return (
        _with_user(_with_user(_with_user(totals, days), channels), tickets)
        .select(
            "user_id",
            "message_count",
            "thread_count",
            (F.col("message_count") / F.col("days").cast("double")).alias("avg_messages_per_day"),
            "most_active_channel",
            "channels_active",
            F.coalesce("ticket_count", F.lit(0)).alias("ticket_count"),
            F.when(F.col("ticket_count").isNull(), none)
            .otherwise(F.col("jira_tickets_mentioned"))
            .alias("jira_tickets_mentioned"),
        )
    )


def busy_threads(messages: DataFrame, channel: str, more_than: int = 3) -> DataFrame:
    """Threads of one channel with over ``more_than`` messages, and their first time."""
    return (
        messages.filter((F.col("channel") == channel) & F.col("thread_ts").isNotNull())
        .groupBy("thread_ts")
        .agg(F.min("event_ts").alias("thread_start"), F.count("*").alias("messages"))
        .filter(F.col("messages") > more_than)
    )


def thread_messages(messages: DataFrame, channel: str, thread_ts: str | Column) -> DataFrame:
    """All messages of one thread in time order."""
    wanted = F.lit(thread_ts) if isinstance(thread_ts, str) else thread_ts
    return (
        messages.filter(
            (F.col("channel") == channel)
            & ((F.col("thread_ts") == wanted) | (F.col("message_id") == wanted))
        )
        .select("message_id", "timestamp", "event_ts", "user_real_name", "text", "is_thread_reply")
        .orderBy("event_ts", "message_id")
    )


def written_by(messages: DataFrame, user_name: str, k: int) -> DataFrame:
    """The newest messages of one author."""
    return (
        messages.filter(F.col("user_name") == user_name)
        .select("channel", "message_id", "event_ts", "timestamp", "text")
        .orderBy(F.desc("event_ts"), F.desc("channel"), F.desc("message_id"))
        .limit(k)
    )
