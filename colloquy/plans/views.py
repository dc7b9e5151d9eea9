"""Conversation views: one channel, several channels in time buckets, one user.

Each function gives a line table (see ``lines``). Labels, marks, indents and rules are
fixed values of the view format.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import bucket_label, stamp, stamp_short
from ..functions.text import (
    attention_mark,
    display_name,
    file_text,
    list_size,
    or_empty,
    reaction_text,
    shorten,
    without_prefix,
)
from ..operators.metrics import view_footer, view_metrics
from ..operators.people import first_stakeholders, mention_names, with_names
from ..operators.threads import MESSAGE_KEY, structure, with_columns_of
from ..operators.tickets import ticket_metadata
from ..session import shared_folder
from .lines import emit, emit_parts, some, stack

THICK, THIN, MEDIUM = "=" * 80, "-" * 60, "-" * 50
# Longest ticket summary shown whole, and what is left of a longer one.
SUMMARY_WIDTH, SUMMARY_CUT = 50, 47
TICKETS_LABEL, REACTIONS_LABEL, FILES_LABEL = "🎫 JIRA", "😊 Reactions: ", "📎 Files: "


@dataclass(frozen=True)
class Organisation:
    """What a view header may tell about the organisation."""

    name: str | None = None
    channels: DataFrame | None = None
    stakeholders: DataFrame | None = None


def who() -> Column:
    return display_name(
        F.col("user_real_name"), F.lit(None).cast("string"), F.lit("Unknown User")
    )


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def ticket_lines(tickets: Column, metadata: Column, indent: Column | str) -> Column:
    """The lines of a message's ticket block; no lines without tickets.

    With metadata each ticket takes three lines, or one when its entry is missing.
    Without any metadata the ids share one line.
    """
    indent = F.lit(indent) if isinstance(indent, str) else indent

    def block(ticket: Column) -> Column:
        # the first entry of a ticket: where a message id comes twice, so do its entries
        meta = F.get(F.filter(metadata, lambda m: m["ticket_id"] == ticket), F.lit(0))

        def field(name: str, default: str) -> Column:
            return display_name(meta[name], F.lit(None).cast("string"), F.lit(default))

        first = text_of(
            indent, "   • ", ticket, " [", field("priority", "Unknown"), "] ",
            field("status", "Unknown"),
        )
        second = text_of(indent, '     "', shorten(field("summary", "No summary"), SUMMARY_WIDTH, SUMMARY_CUT), '"')
        third = text_of(indent, "     Assignee: ", field("assignee", "Unassigned"))
        alone = text_of(indent, "   • ", ticket)
        return F.when(meta.isNull(), F.array(alone)).otherwise(F.array(first, second, third))

    listed = F.concat(
        F.array(text_of(indent, f"{TICKETS_LABEL} Tickets:")),
        F.flatten(F.transform(tickets, block)),
    )
    ids = F.array(text_of(indent, f"{TICKETS_LABEL}: ", F.array_join(tickets, ", ")))
    return (
        F.when(list_size(tickets) == 0, F.array().cast("array<string>"))
        .when(list_size(metadata) == 0, ids)
        .otherwise(listed)
    )


def attachments(indent: Column, compact: Column) -> Column:
    """Reaction, file and ticket lines of a row; ``compact`` leaves out their labels.

    File types are shown under top-level messages only.
    """
    reactions, files = F.col("reactions"), F.col("files")
    typed = (F.col("depth") == 0) & ~compact
    names = F.when(typed, file_text(files)).otherwise(file_text(files, False))
    lines = F.array(
        *some(
            list_size(reactions) > 0,
            text_of(
                indent, F.when(compact, "😊 ").otherwise(REACTIONS_LABEL), reaction_text(reactions)
            ),
        ),
        *some(
            list_size(files) > 0,
            text_of(indent, F.when(compact, "📎 ").otherwise(FILES_LABEL), names),
        ),
    )
    return F.concat(lines, ticket_lines(F.col("jira_tickets"), F.col("jira_metadata"), indent))


def view_rows(
    messages: DataFrame,
    tickets: DataFrame,
    names: DataFrame | None,
    as_of: Column,
    bucket: str | None = None,
    once: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The views' thread structure, and the same rows with everything a line shows.

    ``messages`` carry the ``view_id`` they belong to; a message that several views show comes
    once for each. ``once`` gives the messages as they are stored, where they are at hand; else
    their copies are merged again. Mentions stay unresolved when ``names`` is None.
    """
    layout = structure(messages, ["view_id"], ["view_id"], bucket)
    shown = messages.select(
        "view_id", *MESSAGE_KEY, "text", "timestamp", "reactions", "files", "jira_tickets"
    )
    # what is known of a message by its key alone is made once, however many views show it
    if once is None:
        once = messages.drop("view_id").dropDuplicates(MESSAGE_KEY)
    sides = [shown, ticket_metadata(once, tickets)]
    if names is not None:
        sides.append(mention_names(once, names))
    rows = with_columns_of(layout, *sides)
    text = F.col("text") if names is None else with_names(F.col("text"))
    return layout, rows.withColumns(
        {
            "resolved_text": or_empty(text),
            "stamp": stamp(F.col("timestamp"), as_of),
            "shown_name": who(),
        }
    )


def _reply_head() -> list[Column]:
    return [
        text_of(
            "    ↳ REPLY #", F.col("reply_no").cast("string"), ": ", F.col("shown_name"), " at ",
            F.col("stamp"), ":",
        ),
        text_of("       ", F.col("resolved_text")),
    ]


def _blocks(
    rows: DataFrame, head: list[Column], indent: str, compact: bool, after: Column, tail: Column,
    **order: Column,
) -> DataFrame:
    """Message, reply and closing lines in one pass over the rows."""
    top = F.col("depth") == 0
    depth_indent = F.when(top, indent).otherwise("       ")
    rows = rows.withColumn("_extra", attachments(depth_indent, top & F.lit(compact)))
    return emit_parts(
        rows,
        [
            (top, 0, F.concat(F.array(*head), F.col("_extra"), after)),
            (~top, 1, F.concat(F.array(*_reply_head()), F.col("_extra"))),
            (top, 2, tail),
        ],
        item_no=F.col("message_no"),
        reply_no=F.col("reply_no"),
        **order,
    )


def _some_missing() -> Column:
    expected = F.coalesce(F.col("reply_count"), F.lit(0))
    return F.col("has_clipped_replies") & (expected > F.col("present_replies"))


def message_blocks(rows: DataFrame, show_channel: bool = False) -> DataFrame:
    """Body lines of view rows: messages, nested replies, clip hints, rules."""
    clipped = F.col("is_clipped_thread") | F.col("is_orphaned_reply")
    threaded = F.col("present_replies") > 0
    count = text_of(
        "  🧵 THREAD REPLIES (showing ", F.col("present_replies").cast("string"), " of ",
        F.col("reply_count").cast("string"), "+ replies):",
    )
    head = [
        text_of(
            "💬 MESSAGE #", F.col("message_no").cast("string"),
            F.when(clipped, " (🔗 Thread clipped)").otherwise(""),
        ),
        *some(F.lit(show_channel), text_of("📍 Channel: #", F.coalesce("channel", F.lit("unknown")))),
        text_of("👤 ", F.col("shown_name"), " at ", F.col("stamp"), ":"),
        text_of("   ", F.col("resolved_text")),
    ]
    after = F.array(
        *some(threaded, F.lit(""), F.when(_some_missing(), count).otherwise("  🧵 THREAD REPLIES:")),
        *some(
            ~threaded & F.col("is_orphaned_reply"),
            F.lit("  🔗 Thread clipped (parent message outside time window)"),
            F.lit("  💡 Widen date range to see full thread"),
        ),
    )
    hint = F.lit("  💡 Thread may have additional replies outside this time range")
    tail = [*some(threaded & _some_missing(), F.lit(""), hint), F.lit(""), F.lit(THIN), F.lit("")]
    return _blocks(rows, head, "   ", False, after, F.array(*tail))


def footer_lines(footer: DataFrame) -> DataFrame:
    """Summary lines from (view_id, messages, thread_replies, active_threads)."""
    return emit(
        footer,
        [
            F.lit("📊 CONVERSATION SUMMARY:"),
            text_of("   • Total Messages: ", F.col("messages").cast("string")),
            text_of("   • Total Thread Replies: ", F.col("thread_replies").cast("string")),
            text_of("   • Active Threads: ", F.col("active_threads").cast("string")),
        ],
        section=F.lit(2),
    )


def described_channels(views: DataFrame, channels: DataFrame, single: bool) -> DataFrame:
    """(view_id, described): the views' channel description lines, in listed order."""
    config = channels.select(F.col("name").alias("config"), "description")
    each = views.select("view_id", F.posexplode("channels").alias("pos", "name"))
    exact = config.select(F.col("config").alias("name"), F.col("description").alias("d1"))
    bare = config.select(F.col("config").alias("bare"), F.col("description").alias("d2"))
    found = (
        each.withColumn("bare", without_prefix(F.col("name")))
        .join(exact, "name", "left")
        .join(bare, "bare", "left")
        .withColumn("d", display_name(F.col("d1"), F.col("d2")))
        .filter(F.col("d").isNotNull())
    )
    line = text_of("   Purpose: ", F.col("d")) if single else text_of("   • ", F.col("name"), ": ", F.col("d"))
    lists = found.groupBy("view_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("_d")
    )
    return lists.select("view_id", F.transform("_d", lambda e: e["line"]).alias("described"))


def stakeholder_lines(stakeholders: DataFrame) -> Column:
    """The header's stakeholder block as one array value."""
    top = first_stakeholders(stakeholders)
    line = text_of(
        "   ", attention_mark(F.col("weight")), " ", or_empty(F.col("name")), " - ",
        or_empty(F.col("role")),
    )
    rank = F.struct((-F.col("weight")).alias("w"), "name", line.alias("line"))
    listed = top.agg(F.sort_array(F.collect_list(rank)).alias("s")).select(
        F.transform("s", lambda e: e["line"]).alias("s")
    )
    return F.coalesce(listed.scalar(), F.array().cast("array<string>"))


def header_lines(
    views: DataFrame, metrics: DataFrame | None = None, org: Organisation = Organisation()
) -> DataFrame:
    """Header lines for (view_id, title, channels, window_text).

    A view with one entry in ``channels`` and no title is a single-channel view; ``title``
    is shown otherwise only when there are no channels.
    """
    single = list_size(F.col("channels")) <= 1
    described = F.array().cast("array<string>")
    rows = views
    if org.channels is not None:
        one = described_channels(views.filter(single), org.channels, True)
        many = described_channels(views.filter(~single), org.channels, False)
        rows = rows.join(one.unionByName(many), "view_id", "left")
        described = F.coalesce(F.col("described"), described)
    top = [
        F.lit(THICK),
        F.lit(f"🏢 ORGANIZATION: {org.name}" if org.name else None).cast("string"),
        F.when(single, text_of("📱 SLACK CHANNEL: ", F.col("title"))).otherwise(
            text_of("📱 SLACK CHANNELS: ", F.array_join("channels", ", "))
        ),
    ]
    middle = some(
        F.col("window_text").isNotNull(), text_of("⏰ TIME WINDOW: ", F.col("window_text"))
    )
    if metrics is not None:
        rows = rows.join(metrics, "view_id", "left")
        n = {c: F.coalesce(F.col(c), F.lit(0)) for c in metrics.columns if c != "view_id"}

        def figure(name: str) -> Column:
            return n[name].cast("string")

        middle += [
            F.lit(""),
            F.lit("📊 CONVERSATION METRICS:"),
            text_of("   • Total Messages: ", figure("total_messages")),
            text_of(
                "   • Active Threads: ", figure("total_threads"), " (", figure("total_replies"),
                " replies)",
            ),
            *some(
                n["avg_thread_depth"] > 0,
                F.format_string("   • Avg Thread Depth: %.1f replies", n["avg_thread_depth"]),
            ),
            text_of("   • Unique Participants: ", figure("unique_participants")),
            *some(
                n["high_engagement_threads"] > 0,
                text_of(
                    "   • High Engagement Threads: ", figure("high_engagement_threads"),
                    " (5+ replies)",
                ),
            ),
            *some(
                n["leadership_messages"] > 0,
                text_of(
                    "   • Leadership Involvement: ", figure("leadership_messages"),
                    " messages from key stakeholders",
                ),
            ),
        ]
    people = F.array().cast("array<string>")
    if org.stakeholders is not None:
        rows = rows.withColumn("_people", stakeholder_lines(org.stakeholders))
        people = F.when(
            F.size("_people") > 0,
            F.concat(F.array(F.lit(""), F.lit("👥 KEY STAKEHOLDERS:")), F.col("_people")),
        ).otherwise(people)
    lines = F.concat(
        F.array(*top), described, F.array(*middle), people, F.array(F.lit(THICK), F.lit(""))
    )
    return emit(rows, lines, section=F.lit(0))


def empty_lines(views: DataFrame) -> DataFrame:
    """The whole text of views without messages."""
    return emit(
        views,
        [
            F.lit(THICK),
            text_of("📱 SLACK CHANNEL: ", F.col("title")),
            *some(
                F.col("window_text").isNotNull(), text_of("⏰ TIME WINDOW: ", F.col("window_text"))
            ),
            F.lit(THICK),
            F.lit(""),
            F.lit("No messages found in the specified time window."),
            F.lit(""),
            F.lit(THICK),
        ],
        section=F.lit(0),
    )


def split_empty(views: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Views that have rows, and views that have none."""
    present = rows.select("view_id").distinct()
    return views.join(present, "view_id", "left_semi"), views.join(present, "view_id", "left_anti")


def _framed(
    views: DataFrame, layout: DataFrame, body: DataFrame, org: Organisation
) -> DataFrame:
    filled, empty = split_empty(views, layout)
    metrics = None
    if org.stakeholders is not None:
        metrics = view_metrics(layout, ["view_id"], org.stakeholders)
    return stack(
        header_lines(filled, metrics, org),
        body,
        footer_lines(view_footer(layout, ["view_id"])),
        empty_lines(empty),
    )


def channel_view(
    views: DataFrame,
    messages: DataFrame,
    tickets: DataFrame,
    names: DataFrame | None,
    as_of: Column,
    org: Organisation = Organisation(),
    once: DataFrame | None = None,
) -> DataFrame:
    """Single-channel views of messages that carry their ``view_id``."""
    layout, rows = view_rows(messages, tickets, names, as_of, once=once)
    return _framed(views, layout, message_blocks(rows), org)


def user_view(
    views: DataFrame,
    timeline: DataFrame,
    tickets: DataFrame,
    names: DataFrame | None,
    as_of: Column,
    org: Organisation = Organisation(),
) -> DataFrame:
    """A user's timeline over several channels; every message names its channel.

    The timeline is a small part of the messages and is made durable, because it is read
    several times.
    """
    shared_folder(timeline.sparkSession)
    timeline = timeline.checkpoint()
    layout, rows = view_rows(timeline, tickets, names, as_of, once=timeline.drop("view_id"))
    return _framed(views, layout, message_blocks(rows, True), org)


def bucketed_view(
    views: DataFrame,
    messages: DataFrame,
    tickets: DataFrame,
    names: DataFrame | None,
    as_of: Column,
    bucket: str = "hour",
    org: Organisation = Organisation(),
    once: DataFrame | None = None,
) -> DataFrame:
    """Multi-channel views in hour or day buckets, by channel inside a bucket."""
    layout, rows = view_rows(messages, tickets, names, as_of, bucket, once)
    at = F.date_format("bucket", "yyyy-MM-dd'T'HH:mm:ss")
    top = F.col("depth") == 0
    threaded = F.col("present_replies") > 0
    head = [
        text_of("  💬 ", F.col("shown_name"), " at ", stamp_short(F.col("timestamp")), ":"),
        text_of("     ", F.col("resolved_text")),
    ]
    after = F.array(*some(threaded, F.lit(""), F.lit("  🧵 THREAD REPLIES:")))
    inside = {"bucket": at, "channel_group": F.col("channel")}
    per_channel = layout.filter(top).groupBy("view_id", "bucket", "channel").agg(
        F.count("*").alias("n")
    )
    per_bucket = per_channel.groupBy("view_id", "bucket").agg(
        F.sum("n").alias("n"), F.count("*").alias("channels")
    )
    bucket_head = [
        F.lit(THICK),
        text_of("📅 TIME BUCKET: ", bucket_label(F.col("bucket"), bucket)),
        text_of(
            "   Total Messages: ", F.col("n").cast("string"), " across ",
            F.col("channels").cast("string"), " channels",
        ),
        F.lit(THICK),
        F.lit(""),
    ]
    channel_head = [
        text_of("📱 #", F.col("channel"), " (", F.col("n").cast("string"), " messages)"),
        F.lit(""),
    ]
    messages_body = _blocks(rows, head, "     ", True, after, F.array(F.lit("")), **inside)
    body = stack(
        emit(per_bucket, bucket_head, bucket=at, bucket_part=F.lit(0)),
        emit(per_channel, channel_head, channel_part=F.lit(0), **inside),
        messages_body,
        emit(per_channel, [F.lit(MEDIUM), F.lit("")], channel_part=F.lit(2), **inside),
        emit(per_bucket, [F.lit(THICK), F.lit("")], bucket=at, bucket_part=F.lit(2)),
    )
    return _framed(views, layout, body, org)


def bucketed_user_view(
    views: DataFrame,
    timeline: DataFrame,
    tickets: DataFrame,
    names: DataFrame | None,
    as_of: Column,
    bucket: str = "hour",
    org: Organisation = Organisation(),
) -> DataFrame:
    """A user's timeline in hour or day buckets, by channel inside a bucket."""
    shared_folder(timeline.sparkSession)
    timeline = timeline.checkpoint()
    once = timeline.drop("view_id")
    return bucketed_view(views, timeline, tickets, names, as_of, bucket, org, once)
