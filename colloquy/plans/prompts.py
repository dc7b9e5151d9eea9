"""Prompt corpora: a view's lines inside an instruction frame, with token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    attention_level,
    list_size,
    or_empty,
    signal_mark,
    token_estimate,
    without_prefix,
)
from .lines import ORDER, emit, sizes, stack
from .views import text_of

_ROSTER_SLICES = 64
VIEW_TYPES = ("single_channel", "multi_channel", "user_timeline")

# Our own wording; callers may replace the instructions.
_OPENING = {
    "single_channel": "Below is the conversation of the channel {name} for {window}.",
    "multi_channel": "Below are the conversations of the channels {channels} for {window}.",
    "user_timeline": "Below is what {name} wrote in {channels} for {window}, with whole threads.",
}
_INSTRUCTIONS = {
    "single_channel": "Sum up the main subjects, decisions, open questions and tickets.",
    "multi_channel": "Compare the channels: shared subjects, decisions, blockers and tickets.",
    "user_timeline": "Sum up this person's work, commitments, open questions and tickets.",
}


def _opening(view_type: str) -> Column:
    if view_type not in VIEW_TYPES:
        raise ValueError(f"unknown view type: {view_type}")
    text = F.lit(_OPENING[view_type])
    listed = F.when(list_size(F.col("channels")) > 0, F.array_join("channels", ", ")).otherwise(
        "multiple channels"
    )
    for mark, value in (
        ("{name}", or_empty(F.col("title"))),
        ("{channels}", listed),
        ("{window}", or_empty(F.col("window_text"))),
    ):
        text = F.replace(text, F.lit(mark), value)
    return text


def organisation_lines(
    views: DataFrame,
    view_type: str,
    name: str | None = None,
    stakeholders: DataFrame | None = None,
    channels: DataFrame | None = None,
) -> DataFrame:
    """Context lines: organisation, stakeholders of leadership weight, channel notes."""
    tables = []
    if name:
        tables.append(emit(views, [F.lit(f"All this was said at {name}.")], part=F.lit(0), section=F.lit(0)))
    if stakeholders is not None:
        level = attention_level(F.col("weight"))
        head = [F.lit(""), F.lit("People whose words weigh most:")]
        tables.append(emit(views, head, part=F.lit(1), section=F.lit(0)))
        roster = stakeholders.filter(level.isNotNull()).select(
            F.pmod(F.xxhash64("name"), F.lit(_ROSTER_SLICES)).cast("int").alias("_slice"),
            "name",
            text_of("- ", F.col("name"), ", ", or_empty(F.col("role")), ": ", level).alias(
                "leader"
            ),
        )
        # Every prompt names every leader, so views times leaders lines come out by
        # definition. The slices spread them; the leader's name is the order in the block.
        slices = F.sequence(F.lit(0), F.lit(_ROSTER_SLICES - 1))
        each = views.select("view_id", F.explode(slices).alias("_slice"))
        tables.append(
            emit(
                each.join(roster, "_slice"),
                [F.col("leader")],
                section=F.lit(0),
                channel_group=F.col("name"),
                part=F.lit(2),
                bucket_part=F.lit(2),
            )
        )
    if channels is not None and view_type in ("single_channel", "multi_channel"):
        each = views.select("view_id", F.posexplode("channels").alias("pos", "channel"))
        config = channels.select("name", "description", "signal_type")
        found = each.join(config, without_prefix(F.col("channel")) == F.col("name"))
        found = found.filter(or_empty(F.col("description")) != "")
        tables.append(
            emit(
                views,
                [F.lit(""), F.lit("What the channels are for:")],
                part=F.lit(3),
                section=F.lit(0),
                bucket_part=F.lit(3),
            )
        )
        note = text_of(
            "- #", F.col("name"), " [", signal_mark(F.col("signal_type")), "] ", F.col("description")
        )
        tables.append(
            emit(
                found,
                [note],
                part=F.lit(4),
                section=F.lit(0),
                bucket_part=F.lit(3),
                reply_no=F.col("pos"),
            )
        )
    return stack(*tables) if tables else emit(views.limit(0), [F.lit("")])


def prompt_lines(
    views: DataFrame,
    lines: DataFrame,
    view_type: str,
    custom_instructions: str | None = None,
    context: DataFrame | None = None,
) -> DataFrame:
    """Frame, context, view lines and instructions as one line table per view.

    ``section`` is widened to 0 frame, 1 context, 2-4 the view's own sections, 5
    instructions.
    """
    own = lines.withColumn("section", F.col("section") + 2)
    rest = custom_instructions or _INSTRUCTIONS[view_type]
    tables = [
        emit(views, [_opening(view_type), F.lit("")], section=F.lit(0)),
        own,
        emit(views, [F.lit(""), F.lit(rest)], section=F.lit(5)),
    ]
    if context is not None:
        tables.append(context.withColumn("section", F.lit(1)))
    return stack(*tables).select("view_id", *ORDER, "line")


def prompt_sizes(prompts: DataFrame) -> DataFrame:
    """Characters and estimated tokens of each prompt, without building its text."""
    return sizes(prompts).withColumn("tokens", token_estimate(F.col("characters")))
