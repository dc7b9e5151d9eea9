"""Normalisation of raw JSON records into the stored tables' rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.fields import (
    is_thread_parent,
    is_thread_reply,
    map_total,
    progress_percent,
    sprint_from_text,
)
from ..functions.instants import day_of, from_epoch, iso_text
from ..functions.text import list_size, or_empty, ticket_ids

_CORRUPT = "_corrupt_record"


def parse_json(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Adds ``record`` (null when the JSON is malformed); unknown fields are dropped.

    A row's JSON is parsed once: as a generated column it isn't repeated in the filters on it,
    nor carried below a shuffle with them.
    """
    wide = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json(
        F.col(column), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    )
    good = F.struct(*[F.col("_parsed")[f.name].alias(f.name) for f in schema.fields])
    broken = F.col("_parsed").isNull() | F.col("_parsed")[_CORRUPT].isNotNull()
    return (
        lines.select("*", F.explode(F.array(parsed)).alias("_parsed"))
        .withColumn("record", F.when(~broken, good))
        .drop("_parsed")
    )


def split_rejects(parsed: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to go on with, and rows to set aside; together they are all rows."""
    ok = F.coalesce(F.col("record").isNotNull() & valid, F.lit(False))
    return parsed.filter(ok), parsed.filter(~ok)


def message_columns(raw: Column) -> list[Column]:
    """The stored message columns from one raw message struct."""
    who = raw["user_info"]
    reactions = F.transform(
        raw["reactions"],
        lambda r: F.struct(
            r["name"].alias("emoji"),
            r["count"].alias("count"),
            F.coalesce(r["users"], F.array().cast("array<string>")).alias("users"),
        ),
    )
    files = F.transform(
        raw["files"],
        lambda f: F.struct(
            f["id"].alias("id"),
            f["name"].alias("name"),
            f["mimetype"].alias("mimetype"),
            f["url_private"].alias("url"),
            f["size"].alias("size"),
        ),
    )
    replies = F.coalesce(raw["reply_count"], F.lit(0).cast("bigint"))
    return [
        raw["ts"].alias("message_id"),
        raw["user"].alias("user_id"),
        or_empty(raw["text"]).alias("text"),
        iso_text(from_epoch(raw["ts"])).alias("timestamp"),
        raw["thread_ts"].alias("thread_ts"),
        is_thread_parent(raw["ts"], raw["thread_ts"], replies).alias("is_thread_parent"),
        is_thread_reply(raw["ts"], raw["thread_ts"]).alias("is_thread_reply"),
        replies.alias("reply_count"),
        who["name"].alias("user_name"),
        who["real_name"].alias("user_real_name"),
        who["profile"]["email"].alias("user_email"),
        F.when(who.isNotNull(), F.coalesce(who["is_bot"], F.lit(False))).alias("user_is_bot"),
        F.coalesce(reactions, F.array().cast(schemas.array(schemas.REACTION))).alias("reactions"),
        F.coalesce(files, F.array().cast(schemas.array(schemas.FILE))).alias("files"),
        ticket_ids(raw["text"]).alias("jira_tickets"),
        (list_size(raw["reactions"]) > 0).alias("has_reactions"),
        (list_size(raw["files"]) > 0).alias("has_files"),
        F.lit(False).alias("has_thread"),
    ]


def normalise_messages(
    lines: DataFrame, run_day: str, carry: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """JSON lines (``value``, ``channel``) to stored message rows, and the rejects.

    Each message goes to the day of its own time, or to ``run_day`` when that time
    cannot be read. Columns named in ``carry`` go along with the rows.
    """
    parsed = parse_json(lines, schemas.RAW_MESSAGE)
    good, rejects = split_rejects(parsed, F.col("record")["ts"].isNotNull())
    rows = good.select(*message_columns(F.col("record")), "channel", *carry)
    return route_by_day(rows, run_day), rejects


def route_by_day(rows: DataFrame, run_day: str) -> DataFrame:
    day = day_of(from_epoch(F.col("message_id")))
    return rows.withColumn("dt", F.coalesce(day, F.lit(run_day))).select(
        *[c for c in rows.columns if c not in ("dt", "channel")], "dt", "channel"
    )


def flatten_threads(timeline: DataFrame, threads: DataFrame) -> DataFrame:
    """Timeline lines plus the replies of thread payloads as one set of raw lines.

    ``timeline`` has (value, channel); ``threads`` has (messages array<string>,
    channel), where the first message of each payload is the parent and is dropped.
    """
    replies = threads.select(
        F.explode(F.slice("messages", F.lit(2), F.greatest(F.size("messages") - 1, F.lit(0)))).alias(
            "value"
        ),
        "channel",
    )
    return timeline.select("value", "channel").unionByName(replies)


def _names(values: Column) -> Column:
    return F.coalesce(
        F.transform(values, lambda v: v["name"]), F.array().cast("array<string>")
    )


def _linked(links: Column, kind: str, side: str) -> Column:
    picked = F.filter(
        links, lambda x: (x["type"]["name"] == kind) & x[side]["key"].isNotNull()
    )
    return F.coalesce(
        F.transform(picked, lambda x: x[side]["key"]), F.array().cast("array<string>")
    )


def ticket_columns(record: Column) -> list[Column]:
    """The stored ticket columns (without ``cached_at``) from one raw issue struct."""
    f = record["fields"]
    authors = F.coalesce(
        F.transform(f["comment"]["comments"], lambda c: c["author"]["displayName"]),
        F.array().cast("array<string>"),
    )
    counts = F.map_from_entries(
        F.transform(
            F.array_distinct(authors),
            lambda a: F.struct(a, F.size(F.filter(authors, lambda x: x == a)).cast("bigint")),
        )
    )
    total = F.coalesce(f["progress"]["total"], F.lit(0).cast("bigint"))
    done = F.coalesce(f["progress"]["progress"], F.lit(0).cast("bigint"))
    sprints = F.coalesce(
        F.transform(f["customfield_10020"], sprint_from_text),
        F.array().cast(schemas.array(schemas.SPRINT)),
    )
    return [
        record["key"].alias("ticket_id"),
        f["summary"].alias("summary"),
        f["priority"]["name"].alias("priority"),
        f["issuetype"]["name"].alias("issue_type"),
        f["status"]["name"].alias("status"),
        F.coalesce(f["assignee"]["displayName"], F.lit("Unassigned")).alias("assignee"),
        f["duedate"].alias("due_date"),
        f["customfield_10016"].cast("bigint").alias("story_points"),
        f["created"].alias("created"),
        f["updated"].alias("updated"),
        _linked(f["issuelinks"], "Blocks", "outwardIssue").alias("blocks"),
        _linked(f["issuelinks"], "Blocks", "inwardIssue").alias("blocked_by"),
        _linked(f["issuelinks"], "Depends", "outwardIssue").alias("depends_on"),
        _linked(f["issuelinks"], "Relates", "outwardIssue").alias("related"),
        _names(f["components"]).alias("components"),
        F.coalesce(f["labels"], F.array().cast("array<string>")).alias("labels"),
        _names(f["fixVersions"]).alias("fix_versions"),
        f["resolution"]["name"].alias("resolution"),
        total.alias("progress_total"),
        done.alias("progress_done"),
        progress_percent(done, total).alias("progress_percentage"),
        f["project"]["key"].alias("project"),
        f["customfield_10021"].alias("team"),
        f["customfield_10014"].alias("epic_link"),
        counts.alias("comments"),
        map_total(counts).alias("total_comments"),
        sprints.alias("sprints"),
    ]


def normalise_tickets(
    lines: DataFrame, carry: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """JSON lines (``value``) to ticket rows without ``cached_at``, and the rejects.

    Columns named in ``carry`` go along with the rows.
    """
    parsed = parse_json(lines, schemas.RAW_ISSUE)
    good, rejects = split_rejects(parsed, F.col("record")["key"].isNotNull())
    return good.select(*ticket_columns(F.col("record")), *carry), rejects


def normalise_users(lines: DataFrame, cached_at: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines (``value``) to user rows, and the rejects."""
    parsed = parse_json(lines, schemas.RAW_USER)
    good, rejects = split_rejects(parsed, F.col("record")["id"].isNotNull())
    r = F.col("record")
    rows = good.select(
        r["id"].alias("user_id"),
        r["name"].alias("user_name"),
        r["real_name"].alias("user_real_name"),
        r["profile"]["email"].alias("user_email"),
        F.coalesce(r["is_bot"], F.lit(False)).alias("is_bot"),
        F.lit(cached_at).alias("cached_at"),
    )
    return rows, rejects
