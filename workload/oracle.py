"""The chat tables of ``workload.adapter`` stated in DuckDB SQL.

``PREFIX`` opens every oracle text; only the named tables a query uses are evaluated.
"""

from __future__ import annotations

PREFIX = r"""
WITH ev AS (
  SELECT event_id AS i, ts, event_type, user_id AS u, event_id // 5 AS g, event_id % 5 AS k,
         (event_id // 5) % 3 AS kind, (event_id // 5) // 3 AS h, epoch_us(ts) AS us,
         CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.'
           || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') AS message_id
  FROM events
), firsts AS (
  SELECT g AS t, message_id AS root_id FROM ev WHERE k = 0
), msg0 AS (
  SELECT ev.*,
    CASE WHEN h % 3 = 0 THEN 'ch0' ELSE 'ch' || (h % 7) END AS channel,
    strftime(ts, '%Y-%m-%d') AS dt,
    CASE WHEN us % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
         ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS "timestamp",
    'U' || u AS user_id,
    CASE WHEN kind = 0 AND (k = 0 OR h % 10 <> 9) THEN root_id
         WHEN kind = 1 AND h % 3 = 0 THEN root_id
         WHEN kind = 2 AND k = 0 THEN message_id
         WHEN kind = 2 THEN 'missing-' || g END AS thread_ts,
    CAST(CASE WHEN kind = 0 AND k = 0 THEN CASE WHEN h % 2 = 0 THEN 4 ELSE 6 END ELSE 0 END
         AS BIGINT) AS reply_count,
    event_type
      || CASE WHEN i % 4 <> 3
              THEN ' PROJ-' || CASE WHEN i % 5 = 0 THEN i % 40 ELSE i // 4 END ELSE '' END
      || CASE WHEN i % 3 = 0 THEN ' see OPS-' || (i % 7) ELSE '' END
      || CASE WHEN i % 8 = 0 THEN ' <@U' || (u + 1) || '>'
              WHEN i % 8 = 4 THEN ' <@U' || (i // 6) || '>' ELSE '' END AS text,
    CASE WHEN u % 25 <> 24 THEN 'user' || u END AS user_name,
    CASE WHEN u % 25 <> 24 THEN 'Person ' || u END AS user_real_name,
    CASE WHEN u % 25 <> 24 THEN 'user' || u || '@example.com' END AS user_email,
    CASE WHEN u % 25 <> 24 THEN u % 10 = 0 END AS user_is_bot,
    CASE WHEN event_type = 'click' THEN
           [{'emoji': 'thumbsup', 'count': CAST(1 + i % 3 AS BIGINT), 'users': ['U' || u]}]
         WHEN event_type = 'purchase' THEN
           [{'emoji': 'fire', 'count': CAST(1 AS BIGINT), 'users': ['U' || u]},
            {'emoji': 'eyes', 'count': CAST(2 AS BIGINT), 'users': ['U' || u, 'U' || (u + 2)]}]
         ELSE [] END AS reactions,
    CASE WHEN event_type = 'view' THEN
           [{'id': 'F' || i, 'name': 'file' || i || '.png', 'mimetype': 'image/png',
             'url': 'https://files.example/F' || i, 'size': i * 10}]
         ELSE [] END AS files
  FROM ev LEFT JOIN firsts
    ON firsts.t = CASE WHEN kind = 0 THEN ev.g WHEN kind = 1 AND h % 3 = 0 THEN 0 END
), messages AS (
  SELECT *,
    coalesce(thread_ts = message_id AND reply_count > 0, false) AS is_thread_parent,
    coalesce(thread_ts <> message_id, false) AS is_thread_reply,
    len(reactions) > 0 AS has_reactions, len(files) > 0 AS has_files,
    regexp_extract_all(text, '\b[A-Z]+-\d+\b') AS jira_tickets,
    regexp_extract_all(text, '<@(U[A-Z0-9]+)>', 1) AS mentions
  FROM msg0
), snapshots AS (
  SELECT *, CASE day_no WHEN 1 THEN '2024-01-10' ELSE '2024-01-20' END AS dt,
    'PROJ-' || p_partkey AS ticket_id,
    p_name || CASE WHEN p_partkey % 4 = 0 THEN ' - ' || repeat(p_type || ' ', 9) ELSE '' END AS summary,
    p_brand AS priority, p_type AS issue_type,
    CASE (p_size + day_no - 1) % 3 WHEN 0 THEN 'Open' WHEN 1 THEN 'In Progress' ELSE 'Done' END
      AS status,
    CASE WHEN p_partkey % 9 <> 8 THEN 'Person ' || (p_partkey % 20) ELSE 'Unassigned' END AS assignee,
    CASE WHEN p_partkey % 5 = 0 THEN ['PROJ-' || (p_partkey + 1)] ELSE [] END AS blocked_by,
    CASE WHEN p_partkey % 5 = 1 THEN ['PROJ-' || (p_partkey - 1)] ELSE [] END AS blocks,
    CASE WHEN p_partkey % 7 = 0 THEN ['PROJ-' || (p_partkey + 2)] ELSE [] END AS related
  FROM part, (VALUES (1), (2)) AS d(day_no)
  WHERE day_no = 1 OR p_partkey % 2 = 0
), latest AS (
  SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY dt DESC) = 1
), users AS (
  SELECT 'U' || c_custkey AS user_id, 'user' || c_custkey AS user_name, c_name AS user_real_name,
    'user' || c_custkey || '@example.com' AS user_email, c_custkey % 10 = 0 AS is_bot,
    '2024-01-15T00:00:00' AS cached_at
  FROM customer
), stakeholders AS (
  SELECT CASE WHEN s_suppkey % 4 = 3 THEN lower('Person ' || s_suppkey) ELSE 'Person ' || s_suppkey END
      AS name, CAST(1 + s_suppkey * 7 % 10 AS INTEGER) AS weight, s_name AS role
  FROM supplier
), channels AS (
  SELECT CASE WHEN r_regionkey % 3 = 1 THEN 'channel_ch' || r_regionkey ELSE 'ch' || r_regionkey END
      AS name,
    CASE WHEN r_regionkey = 4 THEN 'G00' ELSE 'C00' END || r_regionkey AS id,
    'About ' || r_name AS description,
    ['critical', 'high', 'medium', 'low'][r_regionkey % 4 + 1] AS signal_type
  FROM region
), requested AS (
  SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'channel_ch' || n_nationkey ELSE 'ch' || n_nationkey END
      AS channel
  FROM nation
), mt AS (
  SELECT channel, message_id, user_id, user_real_name, text, ts, dt, unnest(jira_tickets) AS ticket_id
  FROM messages
), mm AS (
  SELECT channel, message_id, ts, unnest(mentions) AS user_id FROM messages
), authors AS (
  SELECT user_id, arg_max(coalesce(user_real_name, user_name, user_id), ts) AS name
  FROM messages GROUP BY user_id
), names AS (
  SELECT coalesce(a.user_id, u.user_id) AS user_id,
         coalesce(a.name, u.user_real_name, u.user_name, u.user_id) AS name
  FROM authors a FULL JOIN users u ON a.user_id = u.user_id
), leads AS (
  SELECT lower(name) AS lower_name, max(weight) AS weight FROM stakeholders GROUP BY 1
  HAVING max(weight) >= 7
), parents AS (
  SELECT channel, thread_ts, message_id AS pid, ts AS pts FROM messages WHERE is_thread_parent
), reps AS (
  SELECT channel, thread_ts, count(*) AS present, max(ts) AS last_ts
  FROM messages WHERE is_thread_reply GROUP BY ALL
), flat AS (
  SELECT m.*, p.pid, coalesce(r.present, 0) AS present,
    CASE WHEN m.is_thread_reply AND p.pid IS NOT NULL THEN 1 ELSE 0 END AS depth,
    CASE WHEN m.is_thread_reply AND p.pid IS NOT NULL THEN p.pid ELSE m.message_id END AS root_id,
    CASE WHEN m.is_thread_reply AND p.pid IS NOT NULL THEN p.pts ELSE m.ts END AS root_ts,
    CASE WHEN m.is_thread_parent THEN coalesce(r.present, 0) ELSE 0 END AS present_replies,
    m.is_thread_reply AND p.pid IS NULL AS is_orphaned_reply,
    m.is_thread_parent AND m.reply_count > coalesce(r.present, 0) AS has_clipped_replies,
    (m.is_thread_reply AND p.pid IS NULL)
      OR (m.is_thread_parent AND m.reply_count > 0 AND coalesce(r.present, 0) = 0)
      AS is_clipped_thread
  FROM messages m
  LEFT JOIN parents p ON p.channel = m.channel AND p.thread_ts = m.thread_ts
    AND (m.is_thread_reply OR m.is_thread_parent)
  LEFT JOIN reps r ON r.channel = m.channel AND r.thread_ts = m.thread_ts
), threads AS (
  SELECT p.channel, p.thread_ts AS thread_id, p.pts, coalesce(r.present, 0) AS reply_count, r.last_ts,
    coalesce((epoch_us(r.last_ts) - epoch_us(p.pts)) / 60000000.0, 0.0) AS duration_minutes,
    m.participants, coalesce(m.participant_count, 0) AS participant_count, m.starter, m.n_users,
    coalesce(t.tickets, '') AS tickets, coalesce(t.ticket_count, 0) AS ticket_count
  FROM parents p
  LEFT JOIN reps r ON r.channel = p.channel AND r.thread_ts = p.thread_ts
  LEFT JOIN (
    SELECT channel, thread_ts, count(DISTINCT user_real_name) AS participant_count,
      string_agg(DISTINCT user_real_name, '|' ORDER BY user_real_name) AS participants,
      max(user_real_name) FILTER (WHERE is_thread_parent) AS starter,
      count(DISTINCT user_id) AS n_users
    FROM messages WHERE is_thread_parent OR is_thread_reply GROUP BY ALL
  ) m ON m.channel = p.channel AND m.thread_ts = p.thread_ts
  LEFT JOIN (
    SELECT channel, thread_ts, count(DISTINCT ticket) AS ticket_count,
      string_agg(DISTINCT ticket, '|' ORDER BY ticket) AS tickets
    FROM (SELECT channel, thread_ts, unnest(jira_tickets) AS ticket FROM messages
          WHERE is_thread_parent OR is_thread_reply) GROUP BY ALL
  ) t ON t.channel = p.channel AND t.thread_ts = p.thread_ts
)
"""


def instant(column: str = "ts") -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def listed(column: str) -> str:
    return f"array_to_string(list_sort({column}), '|')"
