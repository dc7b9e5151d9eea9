"""Text views, reports and prompt corpora, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import instants
from colloquy.operators import people, timeline, tickets
from colloquy.plans import lines, prompts, reports, views
from colloquy.session import fresh_folder
from colloquy.sources import tables

from .adapter import Chat
from .catalog_scans import AS_OF, LONG, SHORT
from .registry import query

LINE = ["view_id", *lines.ORDER, "line"]
ORG = "Example Org"
_T = "TIMESTAMP '2024-02-01 00:00:00'"

# Shared pieces of the oracles. A view source is a named table ``vm`` of messages with
# ``view_id``; every list of lines may hold nulls, which are no lines.
_SAID = f""", found AS (
  SELECT DISTINCT m.channel, m.message_id, m.user_id, n.name FROM mm m JOIN names n ON n.user_id = m.user_id
), swaps AS (
  SELECT channel, message_id, list('<@' || user_id || '>=>@' || name) AS pairs FROM found GROUP BY ALL
), mtp AS (
  SELECT channel, message_id, unnest(jira_tickets) AS ticket_id, generate_subscripts(jira_tickets, 1) AS pos
  FROM messages
), tl AS (
  SELECT m.channel, m.message_id, list_concat(['🎫 JIRA Tickets:'], flatten(list([
    '   • ' || m.ticket_id || ' [' || coalesce(l.priority, 'Unknown') || '] ' || coalesce(l.status, 'Unknown'),
    '     "' || CASE WHEN length(l.summary) > 50 THEN left(l.summary, 47) || '...'
        ELSE coalesce(l.summary, 'No summary') END || '"',
    '     Assignee: ' || coalesce(l.assignee, 'Unassigned')] ORDER BY m.pos))) AS tlines
  FROM mtp m LEFT JOIN latest l ON l.ticket_id = m.ticket_id GROUP BY m.channel, m.message_id
), said AS (
  SELECT x.channel, x.message_id, coalesce(tlines, []) AS tlines,
    CASE WHEN pairs IS NULL THEN text ELSE list_reduce(list_prepend(text, pairs),
      lambda acc, p: replace(acc, split_part(p, '=>', 1), split_part(p, '=>', 2))) END AS said,
    strftime(ts, '%Y-%m-%d %H:%M') || ' (' || {LONG} || ')' AS stamp, strftime(ts, '%H:%M') AS short_stamp,
    coalesce(user_real_name, 'Unknown User') AS who,
    CASE WHEN has_reactions THEN
      array_to_string(list_transform(reactions, lambda r: r.emoji || '(' || r.count || ')'), ', ') END AS rtext,
    CASE WHEN has_files THEN
      array_to_string(list_transform(files, lambda f: f.name || ' (' || f.mimetype || ')'), ', ') END AS ftext,
    CASE WHEN has_files THEN array_to_string(list_transform(files, lambda f: f.name), ', ') END AS fnames
  FROM (SELECT *, CAST(floor((epoch_us({_T}) - us) / 1000000.0) AS BIGINT) AS s FROM messages) x
  LEFT JOIN swaps w ON w.channel = x.channel AND w.message_id = x.message_id
  LEFT JOIN tl ON tl.channel = x.channel AND tl.message_id = x.message_id
)"""

_LAYOUT = """, vp AS (
  SELECT view_id, channel, thread_ts, message_id AS pid, ts AS pts FROM vm WHERE is_thread_parent
), vr AS (
  SELECT view_id, channel, thread_ts, count(*) AS present FROM vm WHERE is_thread_reply GROUP BY ALL
), vf AS (
  SELECT m.*, p.pid AS vpid, p.pts AS vpts, m.is_thread_reply AND p.pid IS NOT NULL AS nested,
    m.is_thread_reply AND p.pid IS NULL AS orphan,
    CASE WHEN m.is_thread_parent THEN coalesce(r.present, 0) ELSE 0 END AS present,
    m.is_thread_parent AND m.reply_count > coalesce(r.present, 0) AS missing
  FROM vm m LEFT JOIN vp p ON p.view_id = m.view_id AND p.channel = m.channel AND p.thread_ts = m.thread_ts
  LEFT JOIN vr r ON r.view_id = m.view_id AND r.channel = m.channel AND r.thread_ts = m.thread_ts
), tops AS (
  SELECT *, {group} AS grp, row_number() OVER (PARTITION BY {group} ORDER BY ts, channel, message_id) AS no
  FROM vf WHERE NOT nested
), reps2 AS (
  SELECT v.*, t.no, t.grp, t.ts AS tts,
    row_number() OVER (PARTITION BY v.view_id, v.channel, v.vpid ORDER BY v.ts, v.message_id) AS rno
  FROM vf v JOIN tops t ON t.view_id = v.view_id AND t.channel = v.channel AND t.message_id = v.vpid
  WHERE v.nested
)"""

_REPLY_LINES = """list_concat(['    ↳ REPLY #' || rno || ': ' || who || ' at ' || stamp || ':', '       ' || said,
    '       😊 Reactions: ' || rtext, '       📎 Files: ' || fnames],
    list_transform(tlines, lambda l: '       ' || l))"""

_METRICS = """, met AS (
  SELECT view_id, count_if(NOT nested) AS n_messages, count_if(present > 0) AS n_threads,
    CAST(sum(present) AS BIGINT) AS n_replies, count(DISTINCT user_real_name) AS n_people,
    sum(present) / nullif(count_if(present > 0), 0) AS mean_depth, count_if(present >= 5) AS n_high,
    count_if(lower(user_real_name) IN (SELECT lower_name FROM leads)) AS n_lead
  FROM vf GROUP BY view_id
), top5 AS (
  SELECT list('   ' || CASE WHEN weight >= 9 THEN '🔴' WHEN weight >= 7 THEN '🟠' ELSE '🟡' END || ' ' || name
    || ' - ' || role ORDER BY weight DESC, name) AS people
  FROM (SELECT * FROM stakeholders ORDER BY weight DESC, name LIMIT 5)
)"""

_HEAD = f"""list_concat([repeat('=', 80), '🏢 ORGANIZATION: {ORG}', title_line], described,
    ['⏰ TIME WINDOW: ' || window_text, '', '📊 CONVERSATION METRICS:',
     '   • Total Messages: ' || n_messages, '   • Active Threads: ' || n_threads || ' (' || n_replies || ' replies)',
     CASE WHEN mean_depth > 0 THEN '   • Avg Thread Depth: ' || printf('%.1f', mean_depth) || ' replies' END,
     '   • Unique Participants: ' || n_people,
     CASE WHEN n_high > 0 THEN '   • High Engagement Threads: ' || n_high || ' (5+ replies)' END,
     CASE WHEN n_lead > 0 THEN '   • Leadership Involvement: ' || n_lead || ' messages from key stakeholders' END,
     '', '👥 KEY STAKEHOLDERS:'], (SELECT people FROM top5), [repeat('=', 80), ''])"""

_FOOT = """['📊 CONVERSATION SUMMARY:', '   • Total Messages: ' || n_messages,
    '   • Total Thread Replies: ' || n_replies, '   • Active Threads: ' || n_threads]"""

_OUT = """
SELECT view_id, section, bucket, bucket_part, channel_group, channel_part, CAST(item_no AS BIGINT) AS item_no,
  part, CAST(reply_no AS BIGINT) AS reply_no, CAST(unnest(generate_series(0, len(ls) - 1)) AS INTEGER) AS line_no,
  unnest(ls) AS line
FROM (SELECT * EXCLUDE (ls), list_filter(ls, lambda x: x IS NOT NULL) AS ls FROM ({blocks}))"""

_EMPTY = """SELECT view_id, 0 AS section, '' AS bucket, 1 AS bucket_part, '' AS channel_group, 1 AS channel_part,
  0 AS item_no, 0 AS part, 0 AS reply_no, [repeat('=', 80), '📱 SLACK CHANNEL: ' || title,
  '⏰ TIME WINDOW: ' || window_text, repeat('=', 80), '', 'No messages found in the specified time window.', '',
  repeat('=', 80)] AS ls FROM vw WHERE view_id NOT IN (SELECT view_id FROM vm)"""

_TAIL = """[CASE WHEN present > 0 AND missing THEN '' END,
    CASE WHEN present > 0 AND missing THEN '  💡 Thread may have additional replies outside this time range' END,
    '', repeat('-', 60), '']"""


def _message_lines(show_channel: bool) -> str:
    channel = "'📍 Channel: #' || t.channel," if show_channel else ""
    return f"""list_concat(['💬 MESSAGE #' || no || CASE WHEN orphan OR (missing AND present = 0)
      THEN ' (🔗 Thread clipped)' ELSE '' END, {channel} '👤 ' || who || ' at ' || stamp || ':', '   ' || said,
      '   😊 Reactions: ' || rtext, '   📎 Files: ' || ftext], list_transform(tlines, lambda l: '   ' || l),
    [CASE WHEN present > 0 THEN '' END,
     CASE WHEN present > 0 AND missing
       THEN '  🧵 THREAD REPLIES (showing ' || present || ' of ' || reply_count || '+ replies):'
       WHEN present > 0 THEN '  🧵 THREAD REPLIES:' END,
     CASE WHEN orphan THEN '  🔗 Thread clipped (parent message outside time window)' END,
     CASE WHEN orphan THEN '  💡 Widen date range to see full thread' END])"""


def _plain(section: int, item: str, part: int, reply: str, ls: str, source: str) -> str:
    return f"""SELECT view_id, {section} AS section, '' AS bucket, 1 AS bucket_part, '' AS channel_group,
  1 AS channel_part, {item} AS item_no, {part} AS part, {reply} AS reply_no, {ls} AS ls FROM {source}"""


_SAY = "JOIN said s ON s.channel = t.channel AND s.message_id = t.message_id"


def _view_sql(vm: str, vw: str, show_channel: bool = False) -> str:
    """Oracle of unbucketed views: ``vm`` selects messages with view_id, ``vw`` the views with
    title, window_text, title_line and described."""
    blocks = " UNION ALL ".join(
        [
            _plain(0, "0", 0, "0", _HEAD, "vw JOIN met USING (view_id)"),
            _plain(1, "no", 0, "0", _message_lines(show_channel), f"tops t {_SAY}"),
            _plain(1, "no", 1, "rno", _REPLY_LINES, f"reps2 t {_SAY}"),
            _plain(1, "no", 2, "0", _TAIL, "tops"),
            _plain(2, "0", 0, "0", _FOOT, "met"),
            _EMPTY,
        ]
    )
    return (
        _SAID + f", vm AS ({vm})" + _LAYOUT.format(group="view_id") + _METRICS + f", vw AS ({vw})"
        + _OUT.format(blocks=blocks)
    )


def _org(c: Chat) -> views.Organisation:
    return views.Organisation(ORG, c.channels, c.stakeholders)


def _names(c: Chat) -> DataFrame:
    return people.name_map(c.messages, c.users)


def _as_of():
    return instants.instant(AS_OF)


def _day_views(c: Chat) -> DataFrame:
    """Every channel's stored days, and the day after the last, which has no messages."""
    days = c.messages.select("dt", "channel").distinct()
    after = days.select(F.lit("2024-02-01").alias("dt"), "channel").distinct()
    return days.unionByName(after).select(
        F.concat_ws("/", "dt", "channel").alias("view_id"),
        F.col("channel").alias("title"),
        F.array("channel").alias("channels"),
        F.col("dt").alias("window_text"),
    )


_PURPOSE = """coalesce((SELECT ['   Purpose: ' || description] FROM channels k WHERE k.name = d.channel), [])"""
_DAY_VW = f"""SELECT dt || '/' || channel AS view_id, channel AS title, dt AS window_text,
  '📱 SLACK CHANNEL: ' || channel AS title_line, {_PURPOSE} AS described
FROM (SELECT DISTINCT dt, channel FROM messages UNION ALL SELECT DISTINCT '2024-02-01', channel FROM messages) d"""
_DAY_VM = "SELECT *, dt || '/' || channel AS view_id FROM messages"


def _day_messages(c: Chat) -> DataFrame:
    return c.messages.withColumn("view_id", F.concat_ws("/", "dt", "channel"))


def _channel_day_lines(c: Chat) -> DataFrame:
    return views.channel_view(
        _day_views(c), _day_messages(c), c.tickets, _names(c), _as_of(), _org(c), c.messages
    )


@query("V1 V4 V5 V6 A15", _view_sql(_DAY_VM, _DAY_VW))
def channel_day_views(c: Chat) -> DataFrame:
    return _channel_day_lines(c).select(*LINE)


@query(
    "V1 K7",
    _view_sql(_DAY_VM, _DAY_VW).replace("\nSELECT view_id, section", ", out AS (SELECT view_id, section", 1)
    + """)
SELECT view_id, page_no, count(*) AS lines, string_agg(line, chr(10) ORDER BY seq) AS text
FROM (SELECT view_id, line, seq, (seq - 1) // 500 AS page_no FROM (
  SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY section, item_no, part, reply_no, line_no) AS seq
  FROM out)) GROUP BY view_id, page_no""",
)
def channel_day_view_pages(c: Chat) -> DataFrame:
    return lines.pages(_channel_day_lines(c), 500)


_CHANNEL_VW = f"""SELECT channel AS view_id, channel AS title, '2024-01-01 to 2024-01-30' AS window_text,
  '📱 SLACK CHANNEL: ' || channel AS title_line, {_PURPOSE} AS described
FROM (SELECT DISTINCT channel FROM messages) d"""


def _whole_channel_lines(c: Chat) -> tuple[DataFrame, DataFrame]:
    shown = c.messages.select("channel").distinct().select(
        F.col("channel").alias("view_id"),
        F.col("channel").alias("title"),
        F.array("channel").alias("channels"),
        F.lit("2024-01-01 to 2024-01-30").alias("window_text"),
    )
    rows = c.messages.withColumn("view_id", F.col("channel"))
    return shown, views.channel_view(shown, rows, c.tickets, _names(c), _as_of(), _org(c), c.messages)


@query("V1", _view_sql("SELECT *, channel AS view_id FROM messages", _CHANNEL_VW))
def whole_channel_views(c: Chat) -> DataFrame:
    return _whole_channel_lines(c)[1].select(*LINE)


_OVERLAPPING = [("2024-01-01", "2024-01-07"), ("2024-01-04", "2024-01-10"), ("2024-01-08", "2024-01-14")]
_WEEKS = "VALUES " + ", ".join(f"('{a}', '{z}')" for a, z in _OVERLAPPING)
_ROLLING_VM = f"""SELECT m.*, m.channel || '/' || a AS view_id FROM messages m JOIN ({_WEEKS}) w(a, z)
  ON m.dt BETWEEN a AND z"""
_ROLLING_VW = f"""SELECT channel || '/' || a AS view_id, channel AS title, a || ' to ' || z AS window_text,
  '📱 SLACK CHANNEL: ' || channel AS title_line, {_PURPOSE} AS described
FROM (SELECT DISTINCT channel FROM messages) d, ({_WEEKS}) w(a, z)"""


@query("V1", _view_sql(_ROLLING_VM, _ROLLING_VW))
def rolling_window_views(c: Chat) -> DataFrame:
    """Views of seven days each that overlap, for every channel, in one job."""
    weeks = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a, z in _OVERLAPPING]
    )
    shown = (
        c.messages.select("channel")
        .distinct()
        .select("*", F.explode(weeks).alias("w"))
        .select("channel", "w.*")
        .select(
            F.concat_ws("/", "channel", "a").alias("view_id"),
            F.col("channel").alias("title"),
            F.array("channel").alias("channels"),
            F.concat_ws(" to ", "a", "z").alias("window_text"),
        )
    )
    shown_in = F.filter(weeks, lambda w: F.col("dt").between(w["a"], w["z"]))
    rows = c.messages.select("*", F.explode(shown_in).alias("w")).select(
        *c.messages.columns, F.concat_ws("/", "channel", "w.a").alias("view_id")
    )
    made = views.channel_view(shown, rows, c.tickets, _names(c), _as_of(), _org(c), c.messages)
    return made.select(*LINE)


@query(
    "V1 K7",
    _view_sql("SELECT *, channel AS view_id FROM messages", _CHANNEL_VW).replace(
        "\nSELECT view_id, section", ", out AS (SELECT view_id, section", 1
    )
    + ") SELECT view_id, line FROM out",
)
def view_text_files(c: Chat) -> DataFrame:
    """Views written as text files and read back."""
    path = fresh_folder(c.spark, "view-text")
    lines.write_text(_whole_channel_lines(c)[1], path)
    return c.spark.read.text(path).select("view_id", F.col("value").alias("line"))


_MULTI_VW = """SELECT dt AS view_id, dt AS title, dt AS window_text,
  '📱 SLACK CHANNELS: ' || string_agg(channel, ', ' ORDER BY channel) AS title_line,
  coalesce(list('   • ' || channel || ': ' || k.description ORDER BY channel) FILTER (WHERE k.name IS NOT NULL), [])
    AS described
FROM (SELECT DISTINCT dt, channel FROM messages) d LEFT JOIN channels k ON k.name = d.channel GROUP BY dt"""


def _multi_sql(vm: str, vw: str) -> str:
    at = "strftime(b, '%Y-%m-%dT%H:%M:%S')"

    def row(source: str, bucket_part: int, group: str, channel_part: int, item: str, part: int, reply: str, ls: str) -> str:
        return f"""SELECT view_id, 1 AS section, {at} AS bucket, {bucket_part} AS bucket_part, {group} AS channel_group,
  {channel_part} AS channel_part, {item} AS item_no, {part} AS part, {reply} AS reply_no, {ls} AS ls FROM {source}"""

    compact = """list_concat(['  💬 ' || who || ' at ' || short_stamp || ':', '     ' || said, '     😊 ' || rtext,
      '     📎 ' || fnames], list_transform(tlines, lambda l: '     ' || l),
      [CASE WHEN present > 0 THEN '' END, CASE WHEN present > 0 THEN '  🧵 THREAD REPLIES:' END])"""
    label = "strftime(b, '%Y-%m-%d %H:00-%H:59')"
    tops = f"(SELECT t.*, s.* EXCLUDE (channel, message_id), date_trunc('hour', t.ts) AS b FROM tops t {_SAY})"
    replies = f"(SELECT t.*, s.* EXCLUDE (channel, message_id), date_trunc('hour', t.tts) AS b FROM reps2 t {_SAY})"
    blocks = " UNION ALL ".join(
        [
            _plain(0, "0", 0, "0", _HEAD, "vw JOIN met USING (view_id)"),
            row("pb", 0, "''", 1, "0", 0, "0", f"""[repeat('=', 80), '📅 TIME BUCKET: ' || {label},
      '   Total Messages: ' || n || ' across ' || nc || ' channels', repeat('=', 80), '']"""),
            row("pc", 1, "channel", 0, "0", 0, "0", "['📱 #' || channel || ' (' || n || ' messages)', '']"),
            row(tops, 1, "channel", 1, "no", 0, "0", compact),
            row(replies, 1, "channel", 1, "no", 1, "rno", _REPLY_LINES),
            row(tops, 1, "channel", 1, "no", 2, "0", "['']"),
            row("pc", 1, "channel", 2, "0", 0, "0", "[repeat('-', 50), '']"),
            row("pb", 2, "''", 1, "0", 0, "0", "[repeat('=', 80), '']"),
            _plain(2, "0", 0, "0", _FOOT, "met"),
        ]
    )
    extra = """, pc AS (SELECT view_id, date_trunc('hour', ts) AS b, channel, count(*) AS n FROM tops GROUP BY ALL),
pb AS (SELECT view_id, b, CAST(sum(n) AS BIGINT) AS n, count(*) AS nc FROM pc GROUP BY ALL)"""
    return (
        _SAID + f", vm AS ({vm})"
        + _LAYOUT.format(group="(view_id, date_trunc('hour', ts), channel)")
        + _METRICS + f", vw AS ({vw})" + extra + _OUT.format(blocks=blocks)
    )


_WHOLE_DAY_VM = "SELECT *, dt AS view_id FROM messages"


def _bucketed_day_lines(c: Chat) -> tuple[DataFrame, DataFrame]:
    days = c.messages.select("dt", "channel").distinct()
    shown = days.groupBy("dt").agg(F.sort_array(F.collect_list("channel")).alias("channels")).select(
        F.col("dt").alias("view_id"), F.col("dt").alias("title"), "channels", F.col("dt").alias("window_text")
    )
    rows = c.messages.withColumn("view_id", F.col("dt"))
    return shown, views.bucketed_view(
        shown, rows, c.tickets, _names(c), _as_of(), "hour", _org(c), c.messages
    )


@query("V2 B1", _multi_sql(_WHOLE_DAY_VM, _MULTI_VW))
def bucketed_day_views(c: Chat) -> DataFrame:
    """All channels of each day, in hour buckets."""
    return _bucketed_day_lines(c)[1].select(*LINE)


_USER_VM = """SELECT x.*, 'user7' AS view_id FROM messages x WHERE x.user_name = 'user7' AND x.thread_ts IS NULL
UNION ALL SELECT x.*, 'user7' FROM messages x
  JOIN (SELECT DISTINCT channel, thread_ts FROM messages WHERE user_name = 'user7' AND thread_ts IS NOT NULL) s
    ON s.channel = x.channel AND s.thread_ts = x.thread_ts"""
_USER_VW = """SELECT 'user7' AS view_id, 'user7' AS title, '2024-01-01 to 2024-01-30' AS window_text,
  '📱 SLACK CHANNELS: ' || (SELECT string_agg(DISTINCT channel, ', ' ORDER BY channel) FROM messages) AS title_line,
  (SELECT list('   • ' || k.name || ': ' || k.description ORDER BY k.name) FROM channels k
   WHERE k.name IN (SELECT channel FROM messages)) AS described"""


def _of_user(c: Chat) -> tuple[DataFrame, DataFrame]:
    """The view of one user, and the messages of their timeline."""
    shown = c.messages.select("channel").distinct().agg(
        F.sort_array(F.collect_list("channel")).alias("channels")
    ).select(
        F.lit("user7").alias("view_id"),
        F.lit("user7").alias("title"),
        "channels",
        F.lit("2024-01-01 to 2024-01-30").alias("window_text"),
    )
    rows = timeline.user_timeline(c.messages, "user7").withColumn("view_id", F.lit("user7"))
    return shown, rows


def _user_lines(c: Chat) -> tuple[DataFrame, DataFrame]:
    shown, rows = _of_user(c)
    return shown, views.user_view(shown, rows, c.tickets, _names(c), _as_of(), _org(c))


@query("V3 J7", _view_sql(_USER_VM, _USER_VW, True))
def user_timeline_view(c: Chat) -> DataFrame:
    return _user_lines(c)[1].select(*LINE)


@query("V3 J7 B1", _multi_sql(_USER_VM, _USER_VW))
def bucketed_user_timeline(c: Chat) -> DataFrame:
    """The same timeline in hour buckets, by channel inside a bucket."""
    shown, rows = _of_user(c)
    return views.bucketed_user_view(
        shown, rows, c.tickets, _names(c), _as_of(), "hour", _org(c)
    ).select(*LINE)


@query(
    "V4 H12",
    _SAID + """ SELECT channel, message_id, CAST(unnest(generate_series(0, len(tlines) - 1)) AS INTEGER) AS line_no,
  '   ' || unnest(tlines) AS line FROM said WHERE len(tlines) > 0""",
)
def ticket_blocks(c: Chat) -> DataFrame:
    rich = tickets.enrich(c.messages, c.tickets)
    block = views.ticket_lines(F.col("jira_tickets"), F.col("jira_metadata"), "   ")
    return rich.select("channel", "message_id", F.posexplode(block).alias("line_no", "line"))


_R60 = "repeat('=', 60)"


@query(
    "V7 T5",
    f""", rt AS (
  SELECT t.*, t.channel || '/' || t.thread_id AS view_id, m.text FROM threads t
  JOIN messages m ON m.channel = t.channel AND m.message_id = t.thread_id
), rr AS (
  SELECT m.*, m.channel || '/' || m.thread_ts AS view_id,
    row_number() OVER (PARTITION BY m.channel, m.thread_ts ORDER BY ts, message_id) AS no
  FROM messages m JOIN threads t ON t.channel = m.channel AND t.thread_id = m.thread_ts WHERE m.is_thread_reply
), tt AS (
  SELECT DISTINCT m.channel || '/' || m.thread_ts AS view_id, unnest(m.jira_tickets) AS ticket_id
  FROM messages m JOIN threads t ON t.channel = m.channel AND t.thread_id = m.thread_ts
  WHERE m.is_thread_reply OR m.is_thread_parent
)""" + _OUT.format(blocks=" UNION ALL ".join([
        _plain(1, "0", 0, "0", f"""[{_R60}, 'THREAD SUMMARY', {_R60}, 'Thread started by ' || coalesce(starter, 'Unknown')
  || ' | ' || reply_count || ' replies from ' || participant_count || ' participants'
  || CASE WHEN duration_minutes > 0 AND duration_minutes < 60
       THEN ' | Duration: ' || printf('%.1f', duration_minutes) || ' minutes'
     WHEN duration_minutes >= 60 THEN ' | Duration: ' || printf('%.1f', duration_minutes / 60) || ' hours'
     ELSE '' END
  || CASE WHEN ticket_count > 0 THEN ' | JIRA tickets discussed: ' || replace(tickets, '|', ', ') ELSE '' END, '',
  'ORIGINAL MESSAGE (' || strftime(pts, '%Y-%m-%d %H:%M:%S') || ') - ' || coalesce(starter, 'Unknown') || ':',
  '  ' || text, '', CASE WHEN reply_count > 0 THEN 'REPLIES:' END]""", "rt"),
        _plain(1, "0", 1, "no", """['  ' || no || '. (' || strftime(ts, '%H:%M:%S') || ') '
  || coalesce(user_real_name, 'Unknown') || ': '
  || CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END]""", "rr"),
        _plain(1, "0", 2, "0", "['', 'JIRA TICKETS MENTIONED:']", "rt WHERE ticket_count > 0"),
        """SELECT view_id, 1, '', 2, tt.ticket_id, 1, 0, 0, 0,
  ['  • ' || tt.ticket_id || coalesce(': ' || l.summary || ' [' || l.status || ']', ': (Could not fetch details)')]
  FROM tt LEFT JOIN latest l ON l.ticket_id = tt.ticket_id""",
        _plain(2, "0", 0, "0", f"[{_R60}]", "rt"),
    ])),
)
def thread_reports(c: Chat) -> DataFrame:
    return reports.thread_reports(c.messages, c.tickets).select(*LINE)


_SPOKEN = """, found AS (
  SELECT DISTINCT m.channel, m.message_id, m.user_id, n.name FROM mm m JOIN names n ON n.user_id = m.user_id
), swaps AS (
  SELECT channel, message_id, list('<@' || user_id || '>=>' || name) AS pairs FROM found GROUP BY ALL
), spoken AS (
  SELECT x.channel, x.message_id, CASE WHEN pairs IS NULL THEN text ELSE list_reduce(list_prepend(text, pairs),
    lambda acc, p: replace(acc, split_part(p, '=>', 1), split_part(p, '=>', 2))) END AS said,
    coalesce(user_real_name, 'Unknown User') AS who
  FROM messages x LEFT JOIN swaps w ON w.channel = x.channel AND w.message_id = x.message_id
)"""
_NOTE = """'[summary: ' || summary || ' | status: ' || status || ' | assignee: ' || assignee
  || ' | priority: ' || priority || ' | issue_type: ' || issue_type || ' | story_points: ' || p_size
  || ' | created: 2024-01-02T08:00:00.000+0000 | updated: 2024-01-09T08:00:00.000+0000'
  || CASE WHEN len(blocks) > 0 THEN ' | blocks: [''' || array_to_string(blocks, ''', ''') || ''']' ELSE '' END
  || CASE WHEN len(blocked_by) > 0 THEN ' | blocked_by: [''' || array_to_string(blocked_by, ''', ''') || ''']' ELSE '' END
  || CASE WHEN len(related) > 0 THEN ' | related: [''' || array_to_string(related, ''', ''') || ''']' ELSE '' END
  || ' | components: [''' || p_type || '''] | labels: [''' || lower(p_type) || ''']'
  || CASE WHEN p_size > 0 THEN ' | progress: 50%' ELSE '' END
  || ' | project: PROJ | comments: ' || (p_partkey % 4 + 1)
  || ' | sprints: Sprint ' || (p_partkey % 3) || '(active)]'"""
_DIGEST_HEAD = "who || ' at ' || strftime(ts, '%Y-%m-%d %H:%M') || ' (' || rel || '):'"


@query(
    "V8 H17",
    _SPOKEN
    + f""", noted AS (SELECT ticket_id, {_NOTE} AS note FROM latest),
dig AS (
  SELECT m.*, p.who, {SHORT} AS rel,
    coalesce(regexp_replace(p.said, '(PROJ-\\d+)', '\\1 ' || note), p.said)
      || CASE WHEN has_files THEN chr(10) || '    📎 Files: ' || files[1].name || ' (' || files[1].mimetype || ')' ELSE '' END
      || CASE WHEN has_reactions THEN chr(10) || '    😊 Reactions: '
        || array_to_string(list_transform(reactions, lambda r: r.emoji || '(' || r.count || ')'), ', ') ELSE '' END AS body
  FROM (SELECT *, CAST(floor((epoch_us({_T}) - us) / 1000000.0) AS BIGINT) AS s FROM messages) m
  JOIN spoken p ON p.channel = m.channel AND p.message_id = m.message_id
  LEFT JOIN noted n ON n.ticket_id = list_filter(m.jira_tickets, lambda t: t LIKE 'PROJ-%')[1]
), win AS (SELECT * FROM dig WHERE ts BETWEEN TIMESTAMP '2024-01-21 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'),
root AS (
  SELECT *, channel AS view_id, row_number() OVER (PARTITION BY channel ORDER BY ts, message_id) AS no
  FROM win WHERE NOT is_thread_reply
), below AS (
  SELECT d.*, d.channel AS view_id, r.no,
    row_number() OVER (PARTITION BY d.channel, d.thread_ts ORDER BY d.ts, d.message_id) AS rno
  FROM dig d JOIN root r ON r.channel = d.channel AND r.message_id = d.thread_ts WHERE d.is_thread_reply
), tot AS (
  SELECT channel AS view_id, count_if(NOT is_thread_reply) AS roots, count_if(is_thread_reply) AS replies,
    count(DISTINCT CASE WHEN is_thread_reply THEN thread_ts END) AS active FROM win GROUP BY channel
), late AS (
  SELECT w.*, w.channel AS view_id, roots,
    row_number() OVER (PARTITION BY w.channel ORDER BY w.ts, w.message_id) AS late_no
  FROM win w JOIN tot ON tot.view_id = w.channel LEFT JOIN root r ON r.channel = w.channel AND r.message_id = w.thread_ts
  WHERE w.is_thread_reply AND r.no IS NULL
), opened AS (SELECT DISTINCT channel, thread_ts FROM below)"""
    + _OUT.format(blocks=" UNION ALL ".join([
        _plain(0, "0", 0, "0", """[repeat('=', 80), '📱 SLACK CHANNEL: ' || view_id,
  '⏰ TIME WINDOW: 10d 0h ago to now', repeat('=', 80), '']""", "tot"),
        _plain(1, "no", 0, "0", f"""['💬 MESSAGE #' || no, '👤 ' || {_DIGEST_HEAD}, '   ' || body,
  CASE WHEN o.channel IS NOT NULL THEN '' END, CASE WHEN o.channel IS NOT NULL THEN '  🧵 THREAD REPLIES:' END]""",
               "root LEFT JOIN opened o ON o.channel = root.channel AND o.thread_ts = root.message_id"),
        _plain(1, "no", 1, "rno", f"""['    ↳ REPLY #' || rno || ':     👤 ' || {_DIGEST_HEAD}, '       ' || body]""", "below"),
        _plain(1, "no", 2, "0", "['', repeat('-', 60), '']", "root"),
        f"""SELECT view_id, 1, '', 2, '', 1, roots + late_no, 3, 0,
  [CASE WHEN late_no = 1 THEN '🔗 ORPHANED THREAD REPLIES (parent messages outside time window):' END,
   CASE WHEN late_no = 1 THEN '' END, '💬 MESSAGE #' || (roots + late_no) || ' (📎 Reply to older thread)',
   '👤 ' || {_DIGEST_HEAD}, '   ' || body, '', repeat('-', 60), ''] FROM late""",
        _plain(2, "0", 0, "0", """['📊 CONVERSATION SUMMARY:', '   • Total Messages: ' || roots,
  '   • Total Thread Replies: ' || replies, '   • Active Threads: ' || active]""", "tot"),
    ])),
)
def window_digests(c: Chat) -> DataFrame:
    """The last ten days of every channel, with whole threads."""
    window = tables.in_window(c.messages, instants.instant("2024-01-31T00:00:00Z"), 10, 0)
    made = reports.window_digests(
        c.messages, window, c.tickets, _names(c), _as_of(), "10d 0h ago to now"
    )
    return made.select(*LINE)


@query(
    "H17",
    f""", notes AS (SELECT ticket_id, {_NOTE} AS note FROM latest)
SELECT m.channel, m.message_id,
  coalesce(regexp_replace(text, '(PROJ-\\d+)', '\\1 ' || note), text) AS annotated_text
FROM messages m LEFT JOIN notes n ON n.ticket_id = list_filter(m.jira_tickets, lambda t: t LIKE 'PROJ-%')[1]""",
)
def annotated_messages(c: Chat) -> DataFrame:
    return tickets.annotate(c.messages, c.tickets).select("channel", "message_id", "annotated_text")


@query(
    "V9 J11",
    _SPOKEN
    + f""", rr AS (
  SELECT channel, message_id, unnest(reactions) AS r, generate_subscripts(reactions, 1) AS r_no FROM messages
), ru AS (
  SELECT channel, message_id, r_no, r.emoji AS emoji, r.count AS n, unnest(r.users) AS user_id,
    generate_subscripts(r.users, 1) AS u_no FROM rr
), rline AS (
  SELECT channel, message_id, r_no, emoji || ' (' || n || ') by '
    || string_agg(coalesce(u.user_real_name, 'Unknown User'), ', ' ORDER BY u_no) AS line
  FROM ru LEFT JOIN users u ON u.user_id = ru.user_id GROUP BY channel, message_id, r_no, emoji, n
), rtext AS (
  SELECT channel, message_id, chr(10) || 'Reactions: ' || string_agg(line, chr(10) ORDER BY r_no) AS reacted
  FROM rline GROUP BY channel, message_id
), base AS (
  SELECT m.*, p.said, p.who, coalesce(reacted, '') AS reacted, t.reply_count AS opened,
    strftime(m.ts, '%Y-%m-%d %H:%M:%S') || ' - ' || p.who || ': ' || p.said || coalesce(reacted, '') AS spoken_line,
    CAST(floor((epoch_us({_T}) - epoch_us(date_trunc('minute', m.ts))) / 1000000.0) AS BIGINT) AS s
  FROM messages m JOIN spoken p ON p.channel = m.channel AND p.message_id = m.message_id
  LEFT JOIN rtext r ON r.channel = m.channel AND r.message_id = m.message_id
  LEFT JOIN threads t ON t.channel = m.channel AND t.thread_id = m.message_id
), rep AS (
  SELECT b.*, t.reply_count AS present,
    row_number() OVER (PARTITION BY b.channel, b.thread_ts ORDER BY b.ts, b.message_id) AS no
  FROM base b JOIN threads t ON t.channel = b.channel AND t.thread_id = b.thread_ts WHERE b.is_thread_reply
)"""
    + _OUT.format(blocks=" UNION ALL ".join([
        _plain(1, "0", 0, "0", f"""['MESS_START:' || strftime(ts, '%Y-%m-%d %H:%M') || ':' || ({SHORT}) || ' - ' || who
  || ': ' || said || CASE WHEN has_files THEN chr(10) || 'File URLs:' || chr(10) || files[1].url ELSE '' END || reacted
  || CASE WHEN opened IS NULL THEN ' MESS_END' ELSE ' >> REPLIES_START : ' || chr(10) || spoken_line
    || CASE WHEN opened = 0 THEN ' << REPLIES_END MESS_END' ELSE '' END END]""",
               "(SELECT *, channel || '/' || message_id AS view_id FROM base)"),
        _plain(1, "0", 1, "no", """[spoken_line || CASE WHEN no = present THEN ' << REPLIES_END MESS_END' ELSE '' END]""",
               "(SELECT *, channel || '/' || thread_ts AS view_id FROM rep)"),
    ])),
)
def delimited_messages(c: Chat) -> DataFrame:
    return reports.message_texts(c.messages, c.users, _names(c), _as_of()).select(*LINE)


_CHANNEL_SQL = _view_sql("SELECT *, channel AS view_id FROM messages", _CHANNEL_VW)
_OPENED = "'Below is the conversation of the channel ' || title || ' for ' || window_text || '.'"


def _prompt_sql(
    own: str, extra: str = "", instructions: str = "", base: str = _CHANNEL_SQL, opened: str = _OPENED
) -> str:
    return (
        base.replace("\nSELECT view_id, section", ", out AS (SELECT view_id, section", 1)
        + f"""), prompt AS (
  SELECT * REPLACE (section + 2 AS section) FROM out
  UNION ALL SELECT view_id, 0, '', 1, '', 1, 0, 0, 0, unnest([0, 1]), unnest([{opened}, '']) FROM vw
  UNION ALL SELECT view_id, 5, '', 1, '', 1, 0, 0, 0, unnest([0, 1]), unnest(['', '{instructions}']) FROM vw
  {extra}) {own}"""
    )


_PEOPLE = f"""UNION ALL SELECT view_id, 1, '', 1, '', 1, 0, 0, 0, 0, 'All this was said at {ORG}.' FROM vw
  UNION ALL SELECT view_id, 1, '', 1, '', 1, 0, 1, 0, unnest([0, 1]),
    unnest(['', 'People whose words weigh most:']) FROM vw
  UNION ALL SELECT view_id, 1, '', 2, name, 1, 0, 2, 0, 0, '- ' || name || ', ' || role || ': '
    || CASE WHEN weight >= 9 THEN 'CEO/Executive' ELSE 'Leadership' END FROM vw, stakeholders WHERE weight >= 7"""


def _context_sql(channels: str) -> str:
    """``channels`` gives (view_id, pos, channel)."""
    return _PEOPLE + f"""
  UNION ALL SELECT view_id, 1, '', 3, '', 1, 0, 3, 0, unnest([0, 1]), unnest(['', 'What the channels are for:']) FROM vw
  UNION ALL SELECT view_id, 1, '', 3, '', 1, 0, 4, pos, 0, '- #' || name || ' [' || CASE signal_type
    WHEN 'critical' THEN '🔴 CRITICAL' WHEN 'high' THEN '🟠 HIGH' WHEN 'low' THEN '⚪ LOW' ELSE '🟡 MEDIUM' END
    || '] ' || description FROM ({channels}) JOIN channels ON name = channel"""


_CONTEXT = _context_sql("SELECT view_id, 0 AS pos, view_id AS channel FROM vw")


@query(
    "V10 H18 H19",
    _prompt_sql(
        "SELECT * FROM prompt", _CONTEXT,
        "Sum up the main subjects, decisions, open questions and tickets.",
    ),
)
def prompt_corpus(c: Chat) -> DataFrame:
    """One prompt per channel over the whole range, as lines."""
    shown, body = _whole_channel_lines(c)
    context = prompts.organisation_lines(shown, "single_channel", ORG, c.stakeholders, c.channels)
    return prompts.prompt_lines(shown, body, "single_channel", None, context).select(*LINE)


@query(
    "V10 H18",
    _prompt_sql(
        """SELECT view_id, count(*) AS lines, CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS characters,
  CAST((sum(length(line)) + count(*) - 1) // 4 AS BIGINT) AS tokens FROM prompt GROUP BY view_id""",
        instructions="List the open questions.",
    ),
)
def prompt_sizes(c: Chat) -> DataFrame:
    shown, body = _whole_channel_lines(c)
    made = prompts.prompt_lines(shown, body, "single_channel", "List the open questions.")
    return prompts.prompt_sizes(made)


_DAY_CHANNELS = """SELECT dt AS view_id, row_number() OVER (PARTITION BY dt ORDER BY channel) - 1 AS pos, channel
FROM (SELECT DISTINCT dt, channel FROM messages)"""


@query(
    "V10 V2 H18",
    _prompt_sql(
        "SELECT * FROM prompt", _context_sql(_DAY_CHANNELS),
        "Compare the channels: shared subjects, decisions, blockers and tickets.",
        _multi_sql(_WHOLE_DAY_VM, _MULTI_VW),
        f"""'Below are the conversations of the channels ' || (SELECT string_agg(channel, ', ' ORDER BY pos)
    FROM ({_DAY_CHANNELS}) d WHERE d.view_id = vw.view_id) || ' for ' || window_text || '.'""",
    ),
)
def multi_channel_prompts(c: Chat) -> DataFrame:
    """One prompt per day over all its channels, in hour buckets."""
    shown, body = _bucketed_day_lines(c)
    context = prompts.organisation_lines(shown, "multi_channel", ORG, c.stakeholders, c.channels)
    return prompts.prompt_lines(shown, body, "multi_channel", None, context).select(*LINE)


@query(
    "V10 V3 H18",
    _prompt_sql(
        "SELECT * FROM prompt", _PEOPLE,
        "Sum up this person''s work, commitments, open questions and tickets.",
        _view_sql(_USER_VM, _USER_VW, True),
        """'Below is what ' || title || ' wrote in ' || (SELECT string_agg(DISTINCT channel, ', ' ORDER BY channel)
    FROM messages) || ' for ' || window_text || ', with whole threads.'""",
    ),
)
def user_timeline_prompt(c: Chat) -> DataFrame:
    """The prompt for one user's timeline."""
    shown, body = _user_lines(c)
    context = prompts.organisation_lines(shown, "user_timeline", ORG, c.stakeholders, c.channels)
    return prompts.prompt_lines(shown, body, "user_timeline", None, context).select(*LINE)
