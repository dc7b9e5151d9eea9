"""Column functions over thread flags and ticket fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, list_size


def is_thread_parent(message_id: Column, thread_ts: Column, reply_count: Column) -> Column:
    return F.coalesce((thread_ts == message_id) & (reply_count > 0), F.lit(False))


def is_thread_reply(message_id: Column, thread_ts: Column) -> Column:
    return F.coalesce(thread_ts != message_id, F.lit(False))


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total * 100.0).otherwise(F.lit(0.0))


def map_total(counts: Column) -> Column:
    """Sum of a map's values; zero for a null or empty map."""
    values = F.coalesce(F.map_values(counts), F.array().cast("array<bigint>"))
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, n: acc + n)


def sprint_from_text(sprint: Column) -> Column:
    """A sprint printed as ``[k=v,k=v]`` or as a JSON object, to name and state."""
    inner = sprint.substr(F.lit(2), F.char_length(sprint) - 2)
    pairs = F.str_to_map(inner, F.lit(","), F.lit("="))
    parsed = F.from_json(sprint, "name string, state string")
    as_json = sprint.startswith("{")
    name = F.when(as_json, parsed["name"]).otherwise(F.try_element_at(pairs, F.lit("name")))
    state = F.when(as_json, parsed["state"]).otherwise(F.try_element_at(pairs, F.lit("state")))
    return F.struct(
        F.coalesce(name, F.lit("Unknown")).alias("name"),
        F.coalesce(state, F.lit("Unknown")).alias("state"),
    )


def _labelled(label: str, value: Column) -> Column:
    text = blank_to_null(value.cast("string"))
    return F.when(text.isNotNull(), F.concat(F.lit(f"{label}: "), text))


def _listed(label: str, values: Column) -> Column:
    body = F.concat(F.lit(f"{label}: ['"), F.array_join(values, "', '"), F.lit("']"))
    return F.when(list_size(values) > 0, body)


def ticket_details(t: Column) -> Column:
    """All filled-in fields of a ticket as one bracketed text.

    Summary, status, assignee and priority come first, then the rest in table
    order; ``t`` is a struct with the columns of the tickets table.
    """
    percent = F.bround(t["progress_done"] / F.nullif(t["progress_total"], F.lit(0)) * 100.0, 0)
    sprints = F.array_join(
        F.transform(t["sprints"], lambda s: F.concat(s["name"], F.lit("("), s["state"], F.lit(")"))),
        ", ",
    )
    comments = map_total(t["comments"])
    parts = [
        _labelled("summary", t["summary"]),
        _labelled("status", t["status"]),
        _labelled("assignee", t["assignee"]),
        _labelled("priority", t["priority"]),
        _labelled("issue_type", t["issue_type"]),
        _labelled("due_date", t["due_date"]),
        _labelled("story_points", t["story_points"]),
        _labelled("created", t["created"]),
        _labelled("updated", t["updated"]),
        _listed("blocks", t["blocks"]),
        _listed("blocked_by", t["blocked_by"]),
        _listed("depends_on", t["depends_on"]),
        _listed("related", t["related"]),
        _listed("components", t["components"]),
        _listed("labels", t["labels"]),
        _listed("fix_versions", t["fix_versions"]),
        _labelled("resolution", t["resolution"]),
        F.when(
            t["progress_total"] > 0,
            F.concat(F.lit("progress: "), percent.cast("bigint"), F.lit("%")),
        ),
        _labelled("project", t["project"]),
        _labelled("team", t["team"]),
        _labelled("epic_link", t["epic_link"]),
        F.when(comments > 0, F.concat(F.lit("comments: "), comments)),
        F.when(list_size(t["sprints"]) > 0, F.concat(F.lit("sprints: "), sprints)),
    ]
    return F.concat(F.lit("["), F.concat_ws(" | ", *parts), F.lit("]"))
