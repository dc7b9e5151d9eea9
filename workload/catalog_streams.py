"""Streaming jobs over file sources, and relations between messages, people and tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy import schemas
from colloquy.functions import instants
from colloquy.operators import related, similar
from colloquy.operators.tickets import mentioned
from colloquy.session import fresh_folder
from colloquy.sources import tables
from colloquy.streaming import jobs

from . import adapter
from .adapter import Chat
from .registry import instant_text, query


def _landed(c: Chat, copies: int = 1) -> str:
    """A landing folder with every stored message ``copies`` times, in files that mix all days;
    later copies are edits."""
    folder = fresh_folder(c.spark, "landing")
    rows = c.messages.select(*schemas.MESSAGES_STORED.fieldNames())
    for k in range(copies):
        text = F.concat("text", F.lit(f" (edit {k})")) if k else F.col("text")
        rows.withColumn("text", text).repartition(4, F.xxhash64("message_id", F.lit(k))).write.mode(
            "append"
        ).parquet(folder)
    return folder


@query("X1 K1", "SELECT dt, channel, message_id, text || ' (edit 1)' AS text FROM messages")
def streamed_upsert(c: Chat) -> DataFrame:
    """Every message and then an edit of it arrive in micro-batches; the edit is stored."""
    root = fresh_folder(c.spark, "streamed-store")
    stream = jobs.message_stream(c.spark, _landed(c, 2), files_per_batch=3)
    jobs.upsert_stream(stream, root, fresh_folder(c.spark, "progress")).awaitTermination()
    return tables.read_messages(c.spark, root).select("dt", "channel", "message_id", "text")


@query("X2", "SELECT channel, message_id FROM messages")
def streamed_without_repeats(c: Chat) -> DataFrame:
    stream = jobs.message_stream(c.spark, _landed(c, 2), files_per_batch=3)
    path = fresh_folder(c.spark, "unique")
    jobs.without_repeats(stream, path, fresh_folder(c.spark, "progress"), buckets=2).awaitTermination()
    return jobs.kept_keys(c.spark, path)


def _landed_lines(c: Chat) -> str:
    """Raw JSON lines by channel: every message, then an edit of it, and lines that can't be read."""
    folder = fresh_folder(c.spark, "landing-raw")
    lines = adapter.raw_messages(c.spark, c.sf_dir)
    for k in range(2):
        text = F.concat(F.col("record.text"), F.lit(f" (edit {k})")) if k else F.col("record.text")
        record = F.col("record").withField("text", text)
        rows = lines.select(F.to_json(record).alias("value"), "channel", F.col("record.ts").alias("ts"))
        bad = rows.filter(F.col("ts").endswith(str(k))).select(F.expr("left(value, 20)").alias("value"), "channel", "ts")
        if k:
            bad = bad.withColumn("value", F.lit('{"text": "no time"}'))
        rows.unionByName(bad).repartition(4, "ts").drop("ts").write.mode("append").partitionBy(
            "channel"
        ).text(folder)
    return folder


def _ingested(c: Chat) -> tuple[str, str]:
    root, rejects = fresh_folder(c.spark, "ingested"), fresh_folder(c.spark, "rejects")
    stream = jobs.raw_stream(c.spark, _landed_lines(c), files_per_batch=12)
    jobs.ingest_raw(stream, root, rejects, fresh_folder(c.spark, "progress"), adapter.RUN_DAY).awaitTermination()
    return root, rejects


@query("X1 S7 S10", "SELECT dt, channel, message_id, text || ' (edit 1)' AS text, user_id FROM messages")
def streamed_raw_messages(c: Chat) -> DataFrame:
    """Raw records and edits of them land by channel; each message is stored once, on its day."""
    root, _ = _ingested(c)
    return tables.read_messages(c.spark, root).select("dt", "channel", "message_id", "text", "user_id")


@query(
    "X1 S7",
    """SELECT channel, count(*) AS rejects, count(*) FILTER (WHERE message_id LIKE '%1') AS without_time
FROM messages WHERE message_id LIKE '%0' OR message_id LIKE '%1' GROUP BY channel""",
)
def streamed_rejects(c: Chat) -> DataFrame:
    """What the same stream sets aside: lines cut off, and records without a time."""
    _, rejects = _ingested(c)
    return (
        jobs.rejected(c.spark, rejects)
        .groupBy("channel")
        .agg(F.count("*").alias("rejects"), F.count_if(F.col("value").contains("no time")).alias("without_time"))
    )


@query(
    "X3 B1",
    """SELECT strftime(date_trunc('hour', ts) - to_hours(j), '%Y-%m-%d %H:%M:%S') AS window_start, channel,
  count(*) AS messages, count_if(is_thread_reply) AS replies, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last
FROM messages, (SELECT unnest(range(0, 6)) AS j) GROUP BY ALL""",
)
def streamed_sliding_counts(c: Chat) -> DataFrame:
    """Windows of six hours that slide by one; files arrive with all days mixed."""
    path = fresh_folder(c.spark, "panes")
    stream = jobs.message_stream(c.spark, _landed(c), files_per_batch=2)
    jobs.sliding_panes(stream, path, fresh_folder(c.spark, "progress")).awaitTermination()
    rows = jobs.sliding_counts(c.spark, path)
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "channel", "messages",
        "replies", instant_text("first").alias("first"), instant_text("last").alias("last"),
    )


@query(
    "X3 B1",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket_start, channel,
  count(*) AS messages FROM messages GROUP BY ALL""",
)
def streamed_hour_counts(c: Chat) -> DataFrame:
    stream = jobs.message_stream(c.spark, _landed(c), files_per_batch=2)
    path = fresh_folder(c.spark, "counts")
    jobs.windowed_counts(stream, path, fresh_folder(c.spark, "progress")).awaitTermination()
    rows = jobs.summed_counts(c.spark, path)
    return rows.withColumn("bucket_start", F.date_format("bucket_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "X4",
    """, gaps AS (
  SELECT channel, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE
    THEN 1 ELSE 0 END AS opens FROM messages WINDOW w AS (PARTITION BY channel ORDER BY ts)
), numbered AS (
  SELECT channel, ts, sum(opens) OVER (PARTITION BY channel ORDER BY ts) AS no FROM gaps
)
SELECT channel, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
  strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS messages
FROM numbered GROUP BY channel, no
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 DAY FROM messages)""",
)
def streamed_sessions(c: Chat) -> DataFrame:
    """Sessions that ended a day before the newest message."""
    stream = jobs.message_stream(c.spark, _landed(c), files_per_batch=2)
    path = fresh_folder(c.spark, "sessions")
    jobs.conversation_sessions(stream, path, fresh_folder(c.spark, "progress")).awaitTermination()
    rows = jobs.joined_sessions(c.spark, path)
    form = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return rows.withColumn("session_start", F.date_format("session_start", form)).withColumn(
        "session_end", F.date_format("session_end", form)
    )


@query(
    "G1",
    """SELECT 'user:' || user_id AS source, 'msg:' || channel || '/' || message_id AS target,
  'posted' AS edge_type FROM messages
UNION ALL SELECT 'msg:' || channel || '/' || message_id, 'msg:' || channel || '/' || thread_ts, 'replied_to'
  FROM messages WHERE is_thread_reply
UNION ALL SELECT 'msg:' || channel || '/' || message_id, 'thread:' || channel || '/' || thread_ts, 'part_of'
  FROM messages WHERE is_thread_reply OR is_thread_parent
UNION ALL SELECT 'msg:' || channel || '/' || message_id, 'jira:' || ticket_id, 'references' FROM mt
UNION ALL SELECT DISTINCT 'user:' || user_id, 'msg:' || channel || '/' || message_id, 'mentioned' FROM mm
UNION ALL SELECT DISTINCT 'user:' || user_id, 'channel:' || channel, 'active_in' FROM messages""",
)
def edge_list(c: Chat) -> DataFrame:
    return related.edge_list(c.messages)


@query(
    "G2",
    """SELECT ticket_id, user_id, count(DISTINCT channel) AS channels FROM mt GROUP BY ALL
HAVING count(DISTINCT channel) > 1""",
)
def users_across_channels(c: Chat) -> DataFrame:
    return related.users_across_channels(c.messages)


_SCORES = """, scored AS (
  SELECT e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
), near AS (SELECT vec_id, label, round(s, 6) AS score FROM scored ORDER BY s DESC, vec_id LIMIT 10)"""


@query("G3", _SCORES + " SELECT vec_id, label, score FROM near")
def nearest_vectors(c: Chat) -> DataFrame:
    return related.nearest_to(c.vectors, 0).withColumn("score", F.round("score", 6))


@query("G3", _SCORES + " SELECT vec_id, label, score FROM near WHERE score > 0.25 AND vec_id <> 0")
def near_duplicate_vectors(c: Chat) -> DataFrame:
    return related.near_duplicates(c.vectors, 0, above=0.25).withColumn("score", F.round("score", 6))


def near_copies(c: Chat) -> DataFrame:
    """Every vector, a copy of it that is changed more or less by its id, and of every 50th one
    exact copies in other channels."""
    w = F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.1, 0.25, 0.4, 0.6)]), (F.col("vec_id") % 5 + 1).cast("int"))
    changed = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda x, i: x * (1.0 + F.col("w") * (F.pmod(i * 7 + F.col("vec_id"), F.lit(5)) - 2)),
    )
    rows = c.vectors.select("vec_id", "embedding", w.alias("w"))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("vec_id") % 50 == 0, 5).otherwise(1))).alias("k")
    rows = rows.select("vec_id", "w", "embedding", changed.alias("changed"), copies)
    moved = (F.col("k") == 1) & (F.col("vec_id") % 50 != 0)
    return rows.select(
        (F.col("vec_id") * 10 + F.col("k")).alias("vec_id"),
        F.when(moved, F.col("changed")).otherwise(F.col("embedding").cast("array<double>")).alias("embedding"),
        F.concat(F.lit("ch"), (F.col("vec_id") + F.col("k") * 3) % 7).alias("channel"),
    )


_NEAR_COPIES = """, vecs AS (
  SELECT vec_id * 10 + k AS id, 'ch' || ((vec_id + k * 3) % 7) AS channel,
    CASE WHEN k = 1 AND vec_id % 50 <> 0 THEN
      list_transform(range(0, len(embedding)), lambda i: embedding[i + 1]::DOUBLE * (1.0::DOUBLE
        + ([0.0, 0.1, 0.25, 0.4, 0.6]::DOUBLE[])[vec_id % 5 + 1] * ((i * 7 + vec_id) % 5 - 2)))
      ELSE embedding::DOUBLE[] END AS v
  FROM (SELECT vec_id, embedding, unnest(range(0, CASE WHEN vec_id % 50 = 0 THEN 6 ELSE 2 END)) AS k FROM embeddings)
), classes AS (
  SELECT v, min(id) AS id, count(*) AS members, count(DISTINCT channel) AS channels, min(channel) AS channel
  FROM vecs GROUP BY v
), near_pairs AS (
  SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS score, x.members AS a_members, y.members AS b_members
  FROM classes x JOIN classes y ON x.id < y.id
  WHERE list_cosine_similarity(x.v, y.v) > 0.85 AND (x.channels > 1 OR y.channels > 1 OR x.channel <> y.channel)
  UNION ALL SELECT id, id, 1.0, members, members FROM classes WHERE channels > 1
)
"""


@query("G3", _NEAR_COPIES + "SELECT a, b, round(score, 6) AS score, a_members, b_members FROM near_pairs")
def near_duplicate_pairs(c: Chat) -> DataFrame:
    """All pairs over 0.85 across channels, equal vectors as one class."""
    rows = similar.duplicates_across_channels(near_copies(c), "channel", recall=0.999)
    return rows.withColumn("score", F.round("score", 6))


@query(
    "G3 G4",
    _NEAR_COPIES
    + """, both_ways AS (SELECT a, b FROM near_pairs UNION SELECT b, a FROM near_pairs), grouped AS (
  SELECT node, min(seen) AS group_id FROM (
    WITH RECURSIVE reach(node, seen) AS (
      SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen
    ) SELECT * FROM reach) GROUP BY node)
SELECT group_id, count(*) AS classes, sum(members)::BIGINT AS members FROM grouped JOIN classes ON node = id GROUP BY group_id""",
)
def near_duplicate_groups(c: Chat) -> DataFrame:
    """Groups that those pairs join, with their classes and members."""
    return similar.duplicate_groups(near_copies(c), "channel", recall=0.999)


def similar_messages(c: Chat) -> DataFrame:
    """Edges between a message and the one before it in the same hour on the same ticket,
    scored by how close in time they are."""
    hour = F.date_trunc("hour", "event_ts")
    rows = mentioned(c.messages, "event_ts").select(
        "ticket_id", "event_ts", hour.alias("hour"),
        F.concat_ws("/", "channel", "message_id").alias("a"),
    )
    order = W.partitionBy("ticket_id", "hour").orderBy("event_ts", "a")
    gap = (F.unix_micros("event_ts") - F.unix_micros(F.lag("event_ts").over(order))) / 3_600_000_000
    return (
        rows.withColumn("b", F.lag("a").over(order))
        .withColumn("score", 1.0 - gap)
        .filter(F.col("b").isNotNull())
        .select("a", "b", "score")
    )


@query(
    "G4",
    """, pairs AS (
  SELECT channel || '/' || message_id AS a, lag(channel || '/' || message_id) OVER w AS b,
    1.0 - (us - lag(us) OVER w) / 3600000000.0 AS score
  FROM (SELECT mt.*, epoch_us(ts) AS us FROM mt)
  WINDOW w AS (PARTITION BY ticket_id, date_trunc('hour', ts) ORDER BY ts, channel || '/' || message_id)
), sim AS (SELECT a, b FROM pairs WHERE score > 0.7 AND a <> b),
both_ways AS (SELECT a, b FROM sim UNION SELECT b, a FROM sim)
SELECT node, min(seen) AS cluster FROM (
  WITH RECURSIVE reach(node, seen) AS (
    SELECT a, a FROM both_ways UNION SELECT b, b FROM both_ways
    UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen
  ) SELECT * FROM reach) GROUP BY node""",
)
def message_clusters(c: Chat) -> DataFrame:
    return related.clusters(similar_messages(c))


@query(
    "G5",
    """SELECT label AS topic_id, count(*) AS messages, count(DISTINCT channel) AS channel_count,
  string_agg(DISTINCT channel, '|' ORDER BY channel) AS channels
FROM (SELECT label, CASE WHEN vec_id // 15 % 3 = 0 THEN 'ch0' ELSE 'ch' || (vec_id // 15 % 7) END AS channel
      FROM embeddings) GROUP BY label HAVING count(*) > 1""",
)
def topics_across_channels(c: Chat) -> DataFrame:
    h = F.floor(F.col("vec_id") / 15).cast("bigint")
    rows = c.vectors.select(
        F.col("label").alias("topic_id"),
        F.when(h % 3 == 0, "ch0").otherwise(F.concat(F.lit("ch"), h % 7)).alias("channel"),
        F.col("vec_id").cast("string").alias("message_id"),
    )
    return related.topics(rows).withColumn("channels", F.array_join("channels", "|"))


@query(
    "G6",
    """, aged AS (
  SELECT ticket_id, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) // 86400000000 AS age FROM mt
), counted AS (
  SELECT ticket_id, count_if(age < 7) AS current_mentions, count_if(age >= 7) AS earlier_mentions
  FROM aged WHERE age BETWEEN 0 AND 27 GROUP BY ticket_id
)
SELECT *, CASE WHEN earlier_mentions = 0 THEN 'appearing' WHEN current_mentions = 0 THEN 'fading'
  ELSE 'persisting' END AS state FROM counted""",
)
def topic_states(c: Chat) -> DataFrame:
    return related.topic_states(c.messages, instants.instant("2024-01-31T00:00:00Z"))
