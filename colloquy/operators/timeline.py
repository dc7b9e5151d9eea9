"""One user's activity across channels, with the whole threads they took part in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, mentions_user
from ..session import shared_folder
from .keys import lookup
from .threads import MESSAGE_KEY, THREAD_KEY
from .tickets import enrich


def by_user(user_name: str, mentioned_id: str | None = None) -> Column:
    wrote = F.coalesce(F.col("user_name") == user_name, F.lit(False))
    return wrote | mentions_user(F.col("text"), mentioned_id) if mentioned_id else wrote


def user_timeline(
    messages: DataFrame, user_name: str, mentioned_id: str | None = None
) -> DataFrame:
    """The user's unthreaded messages, and every message of each thread in which the user
    wrote (or, with ``mentioned_id``, was mentioned).

    ``messages`` is already limited to the days and channels of interest; the threads are
    found over all of it before rows are picked, so no thread is cut at a day's edge.
    """
    own = by_user(user_name, mentioned_id)
    threaded = blank_to_null(F.col("thread_ts")).isNotNull()
    seeds = messages.filter(own & threaded).select(*THREAD_KEY).distinct()
    context = lookup(
        messages.filter(threaded), seeds, THREAD_KEY, "left_semi", spread=MESSAGE_KEY
    )
    return messages.filter(own & ~threaded).unionByName(context)


def user_timeline_enriched(
    messages: DataFrame, tickets: DataFrame, user_name: str, mentioned_id: str | None = None
) -> DataFrame:
    """The timeline with ticket metadata.

    The timeline is made durable first: it is a small part of the messages, and enriching
    reads it several times.
    """
    shared_folder(messages.sparkSession)
    return enrich(user_timeline(messages, user_name, mentioned_id).checkpoint(), tickets)
