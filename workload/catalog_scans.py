"""Scans, ingest, sinks, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import schemas
from colloquy.functions import fields, instants, text
from colloquy.operators.channels import split_by_id
from colloquy.operators.keys import latest_per_key
from colloquy.operators.numbering import number_rows, number_sorted
from colloquy.operators.people import first_stakeholders, find_user, find_users, starter_roster
from colloquy.operators.analytics import written_by
from colloquy.session import fresh_folder
from colloquy.sources import raw, store, tables

from . import adapter
from .adapter import Chat
from .oracle import instant, listed
from .registry import instant_text, joined, query

DAY, START, END, BUSY = "2024-01-05", "2024-01-05", "2024-01-12", "ch0"
AS_OF = "2024-02-01T00:00:00Z"
MESSAGE = ["channel", "message_id", "user_id", "text", "timestamp"]
MESSAGE_SQL = 'SELECT channel, message_id, user_id, text, "timestamp" FROM messages'


@query("S1", f"{MESSAGE_SQL} WHERE channel = '{BUSY}' AND dt = '{DAY}' AND NOT is_thread_reply")
def scan_channel_day(c: Chat) -> DataFrame:
    return tables.scan_channel(c.messages, BUSY, DAY, {"is_thread_reply": False}).select(*MESSAGE)


@query("S2", f"{MESSAGE_SQL} WHERE channel = '{BUSY}' AND dt BETWEEN '{START}' AND '{END}'")
def scan_channel_range(c: Chat) -> DataFrame:
    return tables.scan_channel_range(c.messages, BUSY, START, END).select(*MESSAGE)


@query(
    "S3",
    f"SELECT channel AS channel_name, message_id, text FROM messages WHERE dt = '{DAY}'",
)
def scan_all_channels_day(c: Chat) -> DataFrame:
    return tables.scan_all_channels(c.messages, DAY).select("channel_name", "message_id", "text")


@query(
    "S4",
    "SELECT user_id, user_name, user_real_name, user_email, is_bot, cached_at FROM users",
)
def scan_users(c: Chat) -> DataFrame:
    return c.users


@query("S5", "SELECT user_id, user_real_name FROM users WHERE user_id = 'U7'")
def user_lookup(c: Chat) -> DataFrame:
    return tables.get_user(c.users, "U7").select("user_id", "user_real_name")


@query("S5", "SELECT count(*) AS users FROM users")
def user_count(c: Chat) -> DataFrame:
    return tables.user_count(c.users)


@query("S6", "SELECT ticket_id, dt, status, priority, assignee FROM snapshots")
def scan_ticket_snapshots(c: Chat) -> DataFrame:
    return c.tickets.select("ticket_id", "dt", "status", "priority", "assignee")


def _reaction_text(column: str) -> str:
    return (
        f"array_to_string(list_transform({column}, lambda r: r.emoji || ':' || r.count || ':'"
        " || array_to_string(r.users, '+')), ',')"
    )


@query(
    "S7 H9 S10",
    f"""SELECT channel, dt, message_id, user_id, text, "timestamp", thread_ts, is_thread_parent,
  is_thread_reply, reply_count, user_name, user_real_name, user_email, user_is_bot,
  {_reaction_text("reactions")} AS reactions,
  array_to_string(list_transform(files, lambda f: f.id || f.name || f.mimetype || f.url || f.size), ',') AS files,
  {listed("jira_tickets")} AS tickets, has_reactions, has_files, false AS has_thread
FROM messages""",
)
def normalise_messages(c: Chat) -> DataFrame:
    rows, _ = raw.normalise_messages(adapter.message_lines(c.spark, c.sf_dir), adapter.RUN_DAY)
    return rows.select(
        "channel", "dt", "message_id", "user_id", "text", "timestamp", "thread_ts",
        "is_thread_parent", "is_thread_reply", "reply_count", "user_name", "user_real_name",
        "user_email", "user_is_bot",
        F.array_join(
            F.transform(
                "reactions",
                lambda r: F.concat(
                    r["emoji"], F.lit(":"), r["count"], F.lit(":"), F.array_join(r["users"], "+")
                ),
            ),
            ",",
        ).alias("reactions"),
        F.array_join(
            F.transform(
                "files", lambda f: F.concat(f["id"], f["name"], f["mimetype"], f["url"], f["size"])
            ),
            ",",
        ).alias("files"),
        joined("jira_tickets").alias("tickets"),
        "has_reactions", "has_files", "has_thread",
    )


@query(
    "S7",
    """SELECT channel, count(*) AS good, count_if(event_type = 'error') AS rejected
FROM messages GROUP BY channel""",
)
def normalise_message_rejects(c: Chat) -> DataFrame:
    """Every line once as it is, and those of one event type once more, cut in half."""
    lines = adapter.message_lines(c.spark, c.sf_dir)
    cut = lines.filter(F.get_json_object("value", "$.text").startswith("error")).withColumn(
        "value", F.col("value").substr(F.lit(1), F.floor(F.char_length("value") / 2).cast("int"))
    )
    good, rejects = raw.normalise_messages(lines.unionByName(cut), adapter.RUN_DAY)
    counted = good.groupBy("channel").agg(F.count("*").alias("good"))
    return counted.join(
        rejects.groupBy("channel").agg(F.count("*").alias("rejected")), "channel", "left"
    )


@query(
    "S8 A19 H10 H11 H21",
    """SELECT ticket_id, summary, priority, issue_type, status, assignee, CAST(p_size AS BIGINT) AS story_points,
  array_to_string(blocks, ',') AS blocks, array_to_string(blocked_by, ',') AS blocked_by,
  array_to_string(related, ',') AS related, '' AS depends_on, p_type AS components, lower(p_type) AS labels,
  CAST(p_size * 2 AS BIGINT) AS progress_total, CAST(p_size AS BIGINT) AS progress_done,
  CASE WHEN p_size > 0 THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS progress_percentage, 'PROJ' AS project,
  p_partkey % 4 + 1 AS total_comments,
  CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END AS comment_authors,
  'Sprint ' || (p_partkey % 3) || '/active' AS sprints
FROM snapshots WHERE day_no = 1""",
)
def normalise_tickets(c: Chat) -> DataFrame:
    rows, _ = raw.normalise_tickets(adapter.ticket_lines(c.spark, c.sf_dir))
    lists = ["blocks", "blocked_by", "related", "depends_on", "components", "labels"]
    return rows.select(
        "ticket_id", "summary", "priority", "issue_type", "status", "assignee", "story_points",
        *[F.array_join(x, ",").alias(x) for x in lists],
        "progress_total", "progress_done", "progress_percentage", "project", "total_comments",
        F.size(F.map_keys("comments")).alias("comment_authors"),
        F.array_join(
            F.transform("sprints", lambda s: F.concat(s["name"], F.lit("/"), s["state"])), ","
        ).alias("sprints"),
    )


@query("S9", "SELECT user_id, user_name, user_real_name, user_email, is_bot FROM users")
def normalise_users(c: Chat) -> DataFrame:
    rows, _ = raw.normalise_users(adapter.user_lines(c.spark, c.sf_dir), adapter.USERS_CACHED_AT)
    return rows.drop("cached_at")


@query(
    "S10 H4",
    """SELECT dt, channel, count(*) AS messages FROM (
  SELECT dt, channel FROM messages
  UNION ALL SELECT '2024-01-31', channel FROM messages WHERE event_type = 'signup')
GROUP BY ALL""",
)
def route_messages_by_day(c: Chat) -> DataFrame:
    """All messages, and those of one event type once more with an unreadable time."""
    rows = c.messages.select("message_id", "channel", "text")
    unreadable = rows.filter(F.col("text").startswith("signup")).withColumn(
        "message_id", F.concat(F.lit("x"), "message_id")
    )
    routed = raw.route_by_day(rows.unionByName(unreadable), adapter.RUN_DAY)
    return routed.groupBy("dt", "channel").agg(F.count("*").alias("messages"))


@query(
    "S11",
    """SELECT m.channel, m.message_id, m.is_thread_reply FROM messages m
LEFT JOIN parents p ON p.channel = m.channel AND p.thread_ts = m.thread_ts
WHERE NOT m.is_thread_reply OR p.pid IS NOT NULL""",
)
def flatten_thread_payloads(c: Chat) -> DataFrame:
    lines = adapter.message_lines(c.spark, c.sf_dir)
    thread_ts = F.get_json_object("value", "$.thread_ts")
    timeline = lines.filter(
        thread_ts.isNull() | (thread_ts == F.get_json_object("value", "$.ts"))
    )
    flat = raw.flatten_threads(timeline, adapter.thread_payloads(c.spark, c.sf_dir))
    rows, _ = raw.normalise_messages(flat, adapter.RUN_DAY)
    return rows.select("channel", "message_id", "is_thread_reply")


# Sinks


@query(
    "K1 U2",
    """SELECT dt, channel, message_id,
  text || CASE WHEN has_reactions THEN ' (edited)' ELSE '' END AS text FROM messages""",
)
def upsert_messages(c: Chat) -> DataFrame:
    """Store all rows twice in one batch, then an edit of those with reactions."""
    root = fresh_folder(c.spark, "upsert-messages")
    rows = c.messages.select(*schemas.MESSAGES_STORED.fieldNames())
    drafts = rows.withColumn("text", F.lit("draft")).withColumn("at", F.lit(1))
    twice = drafts.unionByName(rows.withColumn("at", F.lit(2)))
    store.upsert_messages(c.spark, twice, root, sequence="at")
    edited = rows.filter("has_reactions").withColumn("text", F.concat("text", F.lit(" (edited)")))
    store.upsert_messages(c.spark, edited, root)
    store.upsert_messages(c.spark, edited.limit(0), root)
    return tables.read_messages(c.spark, root).select("dt", "channel", "message_id", "text")


@query("K2", "SELECT ticket_id, dt, status FROM snapshots")
def upsert_tickets(c: Chat) -> DataFrame:
    root = fresh_folder(c.spark, "upsert-tickets")
    for day, stamp in adapter.SNAPSHOTS.items():
        rows = adapter.ticket_batch(c.spark, c.sf_dir, day)
        for status in (F.lit("Draft"), F.col("status")):
            store.upsert_tickets(
                c.spark, rows.withColumn("status", status), root, day, instants.instant(stamp), "at"
            )
    return tables.read_tickets(c.spark, root).select("ticket_id", "dt", "status")


@query("K3", "SELECT user_id, lower(user_real_name) AS user_real_name FROM users")
def upsert_users(c: Chat) -> DataFrame:
    root = fresh_folder(c.spark, "upsert-users")
    store.upsert_users(c.spark, c.users, root)
    renamed = c.users.withColumn("user_real_name", F.lower("user_real_name"))
    store.upsert_users(c.spark, renamed, root)
    return tables.read_users(c.spark, root).select("user_id", "user_real_name")


@query("K4", "SELECT channel, dt, count(*) AS messages FROM messages WHERE NOT is_thread_reply GROUP BY ALL")
def overwrite_partitions(c: Chat) -> DataFrame:
    """A plain overwrite leaves nothing of the replaced partitions."""
    root = fresh_folder(c.spark, "overwrite")
    rows = c.messages.select(*schemas.MESSAGES_STORED.fieldNames())
    store.overwrite_messages(rows, root)
    kept = rows.filter("NOT is_thread_reply")
    store.overwrite_messages(kept, root)
    touched = kept.select("dt", "channel").distinct()
    stored = tables.read_messages(c.spark, root).join(touched, ["dt", "channel"], "left_semi")
    return stored.groupBy("channel", "dt").agg(F.count("*").alias("messages"))


@query("K5", "SELECT dt, count(*) AS messages FROM messages GROUP BY dt")
def checked_days(c: Chat) -> DataFrame:
    day = store.checked_day(F.col("dt")).alias("dt")
    return c.messages.select(day).groupBy("dt").agg(F.count("*").alias("messages"))


@query(
    "K6",
    """SELECT dt, channel, count(*) AS rows, 1 AS partitions FROM messages GROUP BY dt, channel
UNION ALL SELECT NULL, NULL, count(*), count(DISTINCT dt || channel) FROM messages""",
)
def partition_inventory(c: Chat) -> DataFrame:
    return store.inventory(c.spark, c.root).select("dt", "channel", "rows", "partitions")


@query("K7", "SELECT user_real_name, count(*) AS messages FROM messages GROUP BY ALL")
def export_json(c: Chat) -> DataFrame:
    counted = c.messages.groupBy("user_real_name").agg(F.count("*").alias("messages"))
    path = store.export_fresh(counted, "json")
    return c.spark.read.schema("user_real_name string, messages bigint").json(path)


@query("K7", "SELECT channel, message_id, text FROM messages")
def export_csv(c: Chat) -> DataFrame:
    path = store.export_fresh(c.messages.select("channel", "message_id", "text"), "csv")
    return c.spark.read.schema("channel string, message_id string, text string").csv(path, header=True)


# Filters


@query(
    "F1",
    f"{MESSAGE_SQL} WHERE user_name IS NULL AND has_files",
)
def equality_filters(c: Chat) -> DataFrame:
    wanted = tables.equals_all({"user_name": None, "has_files": True})
    return c.messages.filter(wanted).select(*MESSAGE)


@query(
    "F2",
    f"{MESSAGE_SQL} WHERE dt BETWEEN '{START}' AND '{END}' AND channel IN ('ch1', 'ch2')",
)
def partition_filters(c: Chat) -> DataFrame:
    return tables.pruned(c.messages, START, END, ["ch1", "ch2"]).select(*MESSAGE)


@query("F3", f"{MESSAGE_SQL} WHERE dt BETWEEN '2024-01-24' AND '2024-01-30'")
def trailing_days(c: Chat) -> DataFrame:
    return tables.pruned(c.messages, *tables.trailing_days("2024-01-30", 7)).select(*MESSAGE)


@query(
    "F4",
    f"{MESSAGE_SQL} WHERE ts BETWEEN TIMESTAMP '2024-01-14 08:00:00' AND TIMESTAMP '2024-01-15 12:00:00'",
)
def instant_window(c: Chat) -> DataFrame:
    as_of = instants.instant("2024-01-15T12:00:00Z")
    return tables.in_window(c.messages, as_of, 1, 4).select(*MESSAGE)


@query(
    "F5",
    """SELECT user_real_name, count(*) AS messages FROM messages
WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts <= TIMESTAMP '2024-01-15 23:59:59' GROUP BY ALL""",
)
def instant_range(c: Chat) -> DataFrame:
    rows = tables.read_instants(
        c.spark, c.root, instants.instant("2024-01-08T00:00:00Z"), instants.instant("2024-01-15T23:59:59Z")
    )
    return rows.groupBy("user_real_name").agg(F.count("*").alias("messages"))


@query(
    "F6",
    """SELECT channel, count_if(has_reactions) AS reacted, count_if(is_thread_parent) AS parents,
  count_if(is_thread_reply) AS replies, count_if(user_is_bot) AS bots FROM messages GROUP BY channel""",
)
def flag_counts(c: Chat) -> DataFrame:
    return c.messages.groupBy("channel").agg(
        F.count_if("has_reactions").alias("reacted"),
        F.count_if("is_thread_parent").alias("parents"),
        F.count_if("is_thread_reply").alias("replies"),
        F.count_if("user_is_bot").alias("bots"),
    )


@query("F6", f"{MESSAGE_SQL} WHERE has_reactions AND is_thread_reply AND NOT user_is_bot")
def flag_filter(c: Chat) -> DataFrame:
    wanted = F.col("has_reactions") & F.col("is_thread_reply") & ~F.col("user_is_bot")
    return c.messages.filter(wanted).select(*MESSAGE)


@query(
    "F7",
    f"{MESSAGE_SQL} WHERE list_contains(jira_tickets, 'PROJ-5') AND dt BETWEEN '{START}' AND '{END}'",
)
def messages_with_ticket(c: Chat) -> DataFrame:
    rows = tables.pruned(c.messages, START, END)
    return rows.filter(F.array_contains("jira_tickets", "PROJ-5")).select(*MESSAGE)


@query("F8", f"{MESSAGE_SQL} WHERE text LIKE '%<@U12>%'")
def messages_mentioning_user(c: Chat) -> DataFrame:
    return c.messages.filter(text.mentions_user(F.col("text"), "U12")).select(*MESSAGE)


@query("F9", f"{MESSAGE_SQL} WHERE len(jira_tickets) > 0 AND len(files) > 0")
def nonempty_lists(c: Chat) -> DataFrame:
    tickets, files = text.list_size(F.col("jira_tickets")), text.list_size(F.col("files"))
    return c.messages.filter((tickets > 0) & (files > 0)).select(*MESSAGE)


@query(
    "F10 W4",
    """SELECT channel, message_id, text FROM messages WHERE user_name = 'user3'
ORDER BY ts DESC, channel DESC, message_id DESC LIMIT 50""",
)
def newest_by_author(c: Chat) -> DataFrame:
    return written_by(c.messages, "user3", 50).select("channel", "message_id", "text")


@query(
    "F11",
    "SELECT channel, message_id, user_real_name, text, len(reactions) AS reactions FROM messages"
    " WHERE has_reactions AND ts BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'",
)
def recent_reactions(c: Chat) -> DataFrame:
    rows = tables.in_window(c.messages, instants.instant("2024-01-31T00:00:00Z"), 7, 0)
    return rows.filter("has_reactions").select(
        "channel", "message_id", "user_real_name", "text",
        F.size("reactions").cast("bigint").alias("reactions"),
    )


@query("F12", "SELECT name, id, starts_with(id, 'C') AS valid FROM channels")
def channel_id_check(c: Chat) -> DataFrame:
    good, bad = split_by_id(c.channels)
    return good.select("name", "id", F.lit(True).alias("valid")).unionByName(
        bad.select("name", "id", F.lit(False).alias("valid"))
    )


# Windows and sorts


@query("W1 J3", "SELECT ticket_id, dt, status FROM latest")
def first_row_per_key(c: Chat) -> DataFrame:
    rows = c.tickets.select("ticket_id", "dt", "status", "cached_at")
    return latest_per_key(rows, ["ticket_id"], [F.col("cached_at")]).drop("cached_at")


@query(
    "W2",
    """SELECT channel, message_id,
  row_number() OVER (PARTITION BY channel ORDER BY ts, message_id) AS message_no FROM messages""",
)
def message_numbers(c: Chat) -> DataFrame:
    rows = c.messages.select("channel", "message_id", "event_ts")
    return number_rows(rows, ["channel"], "event_ts", ["message_id"], "message_no").drop("event_ts")


@query(
    "W2",
    """SELECT channel, message_id, row_number() OVER (PARTITION BY channel
  ORDER BY CASE WHEN NOT is_thread_reply THEN ts END NULLS FIRST, message_id) AS message_no FROM messages""",
)
def message_numbers_without_times(c: Chat) -> DataFrame:
    """The same where replies have no time: all of a channel's are one slice, which is sorted whole."""
    at = F.when(~F.col("is_thread_reply"), F.col("event_ts")).alias("at")
    rows = c.messages.select("channel", "message_id", at)
    return number_sorted(rows, ["channel"], ["at", "message_id"], "message_no").drop("at")


@query("W3 U1", f"{MESSAGE_SQL} WHERE dt BETWEEN '{START}' AND '{END}'")
def chronological_order(c: Chat) -> DataFrame:
    return tables.in_order(tables.pruned(c.messages, START, END)).select(*MESSAGE)


@query(
    "W6",
    "SELECT name, weight FROM stakeholders ORDER BY weight DESC, name LIMIT 5",
)
def leading_stakeholders(c: Chat) -> DataFrame:
    return first_stakeholders(c.stakeholders).select("name", "weight")


@query("W6", "SELECT user_real_name AS name, user_id FROM users ORDER BY 1, 2 LIMIT 50")
def first_roster(c: Chat) -> DataFrame:
    return starter_roster(c.users)


@query(
    "W7",
    """SELECT arg_min(user_id, (CASE WHEN lower(user_name) = 'user11' THEN 1
    WHEN lower(user_name) LIKE '%user11%' THEN 2 ELSE 3 END, user_id)) AS user_id
FROM users WHERE lower(user_name) LIKE '%user11%' OR lower(user_real_name) LIKE '%user11%'""",
)
def best_name_match(c: Chat) -> DataFrame:
    return find_user(c.users, "User11")


@query(
    "W7",
    """, wanted AS (
  SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN 'USER' || c_custkey WHEN 1 THEN 'ser' || c_custkey
    WHEN 2 THEN right(c_name, 5) WHEN 3 THEN 'er#' || right(c_name, 2) ELSE 'nobody' || c_custkey END AS name FROM customer
), ranked AS (
  SELECT w.name, u.user_id, CASE WHEN lower(u.user_name) = lower(w.name) THEN 1
    WHEN contains(lower(u.user_name), lower(w.name)) THEN 2 WHEN contains(lower(u.user_real_name), lower(w.name)) THEN 3 END AS rank
  FROM wanted w, users u
)
SELECT w.name, min(user_id) FILTER (WHERE r.rank = best) AS user_id
FROM wanted w LEFT JOIN (SELECT *, min(rank) OVER (PARTITION BY name) AS best FROM ranked WHERE rank IS NOT NULL) r USING (name)
GROUP BY w.name""",
)
def names_resolved(c: Chat) -> DataFrame:
    """Names, parts of names and unknown names of a table, all resolved in one job."""
    customers = c.spark.read.parquet(f"{c.sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    number = key.cast("string")
    wanted = customers.select(
        F.when(key % 5 == 0, F.concat(F.lit("USER"), number))
        .when(key % 5 == 1, F.concat(F.lit("ser"), number))
        .when(key % 5 == 2, F.right("c_name", F.lit(5)))
        .when(key % 5 == 3, F.concat(F.lit("er#"), F.right("c_name", F.lit(2))))
        .otherwise(F.concat(F.lit("nobody"), number))
        .alias("name")
    )
    return find_users(c.users, wanted)


@query(
    "U3 A18",
    """SELECT 'ticket' AS kind, ticket_id AS id FROM mt GROUP BY ALL
UNION ALL SELECT 'user', user_id FROM mm GROUP BY ALL""",
)
def distinct_ids(c: Chat) -> DataFrame:
    from colloquy.operators.analytics import mentions_in_scope, tickets_in_scope

    found = tickets_in_scope(c.messages).select(F.lit("ticket").alias("kind"), F.col("ticket_id").alias("id"))
    named = mentions_in_scope(c.messages).select(F.lit("user").alias("kind"), F.col("user_id").alias("id"))
    return found.unionByName(named)


# Scalar functions


@query(
    "H1 H2",
    f"""SELECT channel, message_id, {listed("jira_tickets")} AS tickets,
  array_to_string(mentions, '|') AS mentions FROM messages""",
)
def extracted_ids(c: Chat) -> DataFrame:
    return c.messages.select(
        "channel", "message_id",
        joined(text.ticket_ids(F.col("text"))).alias("tickets"),
        F.array_join(text.mention_ids(F.col("text")), "|").alias("mentions"),
    )


@query(
    "H1",
    """SELECT doc_id, array_to_string(list_sort(list_distinct(
  regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g'), '\\b[A-Z]+-\\d+\\b'))), '|') AS tickets
FROM documents""",
)
def document_ticket_ids(c: Chat) -> DataFrame:
    """Ticket-shaped ids in whole documents; letters outside ASCII count as blanks here,
    because the two engines disagree on word borders next to them."""
    docs = c.spark.read.parquet(f"{c.sf_dir}/documents.parquet")
    ascii_text = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    return docs.select("doc_id", joined(text.ticket_ids(ascii_text)).alias("tickets"))


@query(
    "H3 H4",
    f"""SELECT channel, message_id, {instant()} AS at, "timestamp" AS iso, dt AS day FROM messages""",
)
def epoch_times(c: Chat) -> DataFrame:
    ts = instants.from_epoch(F.col("message_id"))
    return c.messages.select(
        "channel", "message_id", instant_text(ts).alias("at"), instants.iso_text(ts).alias("iso"),
        instants.day_of(ts).alias("day"),
    )


_AGE = "CAST(floor((epoch_us(TIMESTAMP '{t}') - us) / 1000000.0) AS BIGINT)"
LONG = """CASE WHEN s < 60 THEN 'just now'
  WHEN s < 3600 THEN (s // 60) || ' min' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END || ' ago'
  WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago'
  WHEN s < 604800 THEN (s // 86400) || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago'
  WHEN s < 2592000 THEN (s // 604800) || ' week' || CASE WHEN s // 604800 = 1 THEN '' ELSE 's' END || ' ago'
  WHEN s < 31536000 THEN (s // 2592000) || ' month' || CASE WHEN s // 2592000 = 1 THEN '' ELSE 's' END || ' ago'
  ELSE (s // 31536000) || ' year' || CASE WHEN s // 31536000 = 1 THEN '' ELSE 's' END || ' ago' END"""
SHORT = """CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago'
  WHEN s < 86400 THEN (s // 3600) || 'h ago'
  ELSE (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h ago' END"""
_NOW = "2024-01-30 12:00:00"


@query(
    "H5 H6",
    f"""SELECT channel, message_id, {LONG} AS relative, {SHORT} AS relative_short
FROM (SELECT *, {_AGE.format(t=_NOW)} AS s FROM messages)""",
)
def relative_times(c: Chat) -> DataFrame:
    as_of = instants.instant(_NOW)
    return c.messages.select(
        "channel", "message_id",
        instants.relative_long(F.col("event_ts"), as_of).alias("relative"),
        instants.relative_short(F.col("event_ts"), as_of).alias("relative_short"),
    )


@query(
    "H7",
    f"""SELECT channel, message_id,
  CASE event_type WHEN 'error' THEN left('bad ' || "timestamp", 16) WHEN 'view' THEN 'unknown time'
    ELSE strftime(ts, '%Y-%m-%d %H:%M') || ' (' || {LONG} || ')' END AS long_stamp,
  CASE event_type WHEN 'error' THEN left('bad ' || "timestamp", 5) WHEN 'view' THEN 'unknown'
    ELSE strftime(ts, '%H:%M') END AS short_stamp
FROM (SELECT *, {_AGE.format(t=_NOW)} AS s FROM messages)""",
)
def time_stamps(c: Chat) -> DataFrame:
    """Readable, malformed and empty times by event type."""
    kind = F.split("text", " ")[0]
    shown = F.when(kind == "error", F.concat(F.lit("bad "), "timestamp")).when(
        kind == "view", F.lit("")
    ).otherwise(F.col("timestamp"))
    return c.messages.select(
        "channel", "message_id",
        instants.stamp(shown, instants.instant(_NOW)).alias("long_stamp"),
        instants.stamp_short(shown).alias("short_stamp"),
    )


@query(
    "H8",
    """SELECT channel, message_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_start,
  strftime(date_trunc('hour', ts) + INTERVAL 3599 SECOND, '%Y-%m-%d %H:%M:%S') AS hour_end,
  strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day_start,
  strftime(date_trunc('day', ts) + INTERVAL 86399 SECOND, '%Y-%m-%d %H:%M:%S') AS day_end FROM messages""",
)
def bucket_bounds(c: Chat) -> DataFrame:
    ts, form = F.col("event_ts"), "yyyy-MM-dd HH:mm:ss"
    bounds = [
        F.date_format(fn(ts, unit), form).alias(f"{unit}_{name}")
        for unit in ("hour", "day")
        for name, fn in (("start", instants.bucket_start), ("end", instants.bucket_end))
    ]
    return c.messages.select("channel", "message_id", *bounds)


@query(
    "H12",
    """SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 47) || '...' ELSE text END AS short,
  CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS reply FROM documents""",
)
def shortened_texts(c: Chat) -> DataFrame:
    docs = c.spark.read.parquet(f"{c.sf_dir}/documents.parquet")
    whole = F.col("text")
    return docs.select(
        "doc_id", text.shorten(whole, 50, 47).alias("short"), text.shorten(whole, 100).alias("reply")
    )


@query("H13", "SELECT ticket_id, 'https://tracker.example/browse/' || ticket_id AS url FROM latest")
def ticket_urls(c: Chat) -> DataFrame:
    url = text.ticket_url("https://tracker.example", F.col("ticket_id"))
    return tables.latest_tickets(c.tickets).select("ticket_id", url.alias("url"))


@query(
    "H14",
    """SELECT channel, message_id,
  array_to_string(list_transform(reactions, lambda r: r.emoji || '(' || r.count || ')'), ', ') AS reactions,
  array_to_string(list_transform(files, lambda f: f.name || ' (' || f.mimetype || ')'), ', ') AS files
FROM messages""",
)
def reaction_and_file_texts(c: Chat) -> DataFrame:
    return c.messages.select(
        "channel", "message_id", text.reaction_text(F.col("reactions")).alias("reactions"),
        text.file_text(F.col("files")).alias("files"),
    )


@query(
    "H15",
    """SELECT coalesce(user_real_name, user_name, user_id) AS name, count(*) AS messages
FROM messages GROUP BY ALL""",
)
def display_names(c: Chat) -> DataFrame:
    name = text.display_name(F.col("user_real_name"), F.col("user_name"), F.col("user_id"))
    return c.messages.groupBy(name.alias("name")).agg(F.count("*").alias("messages"))


@query(
    "H16",
    """SELECT ticket_id, '[summary: ' || summary || ' | status: ' || status || ' | assignee: ' || assignee
  || ' | priority: ' || priority || ' | issue_type: ' || issue_type || ' | story_points: ' || p_size
  || ' | created: 2024-01-02T08:00:00.000+0000 | updated: 2024-01-09T08:00:00.000+0000'
  || CASE WHEN len(blocks) > 0 THEN ' | blocks: [''' || array_to_string(blocks, ''', ''') || ''']' ELSE '' END
  || CASE WHEN len(blocked_by) > 0 THEN ' | blocked_by: [''' || array_to_string(blocked_by, ''', ''') || ''']' ELSE '' END
  || CASE WHEN len(related) > 0 THEN ' | related: [''' || array_to_string(related, ''', ''') || ''']' ELSE '' END
  || ' | components: [''' || p_type || '''] | labels: [''' || lower(p_type) || ''']'
  || CASE WHEN p_size > 0 THEN ' | progress: 50%' ELSE '' END
  || ' | project: PROJ | comments: ' || (p_partkey % 4 + 1)
  || ' | sprints: Sprint ' || (p_partkey % 3) || '(active)]' AS details
FROM latest""",
)
def ticket_details(c: Chat) -> DataFrame:
    newest = tables.latest_tickets(c.tickets)
    whole = F.struct(*[F.col(x) for x in newest.columns])
    return newest.select("ticket_id", fields.ticket_details(whole).alias("details"))


@query("H18", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimates(c: Chat) -> DataFrame:
    docs = c.spark.read.parquet(f"{c.sf_dir}/documents.parquet")
    return docs.select("doc_id", text.token_estimate(F.char_length("text")).alias("tokens"))


@query(
    "H19",
    """SELECT name, weight, CASE WHEN weight >= 9 THEN 'CEO/Executive' WHEN weight >= 7 THEN 'Leadership' END
  AS level FROM stakeholders""",
)
def attention_levels(c: Chat) -> DataFrame:
    return c.stakeholders.select("name", "weight", text.attention_level(F.col("weight")).alias("level"))


@query(
    "H19",
    """SELECT name, CAST(CASE signal_type WHEN 'critical' THEN 10 WHEN 'high' THEN 8 WHEN 'medium' THEN 5
  WHEN 'low' THEN 2 ELSE 5 END AS INTEGER) AS weight FROM channels""",
)
def signal_weights(c: Chat) -> DataFrame:
    return c.channels.select("name", text.signal_weight(F.col("signal_type")).alias("weight"))


@query(
    "H20",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
)
def json_fields(c: Chat) -> DataFrame:
    e = c.spark.read.parquet(f"{c.sf_dir}/events.parquet")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
