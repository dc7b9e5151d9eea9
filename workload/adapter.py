"""Chat data derived from the given tables.

Raw JSON records are built from whole tables (events give messages, part gives tickets,
customer gives user profiles, supplier the stakeholder roster, region the channel
configuration), normalised by the library and stored once per application below the
shared folder. FIXTURES.md lists the rules; ``workload.oracle`` states them in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.instants import instant
from colloquy.operators.keys import lookup
from colloquy.operators.numbering import HOUR, number_rows
from colloquy.session import fresh_folder, pin_utc
from colloquy.sources import raw, store, tables

SNAPSHOTS = {"2024-01-10": "2024-01-10T06:00:00Z", "2024-01-20": "2024-01-20T06:00:00Z"}
USERS_CACHED_AT = "2024-01-15T00:00:00"
RUN_DAY = "2024-01-31"
PAYLOAD_REPLIES = 200

_chats: dict[tuple[str, str], Chat] = {}


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _div(value: Column, by: int) -> Column:
    return F.floor(value / by).cast("bigint")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    message_id = _text(_div(us, 1_000_000), ".", F.lpad((us % 1_000_000).cast("string"), 6, "0"))
    g = _div(F.col("event_id"), 5)
    return e.select(
        "event_id",
        "event_type",
        F.col("user_id").alias("u"),
        message_id.alias("message_id"),
        g.alias("g"),
        (F.col("event_id") % 5).alias("k"),
        (g % 3).alias("kind"),
        _div(g, 3).alias("h"),
    )


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw message records plus their channel."""
    e = events(spark, sf_dir)
    i, u, k, kind, h = (F.col(c) for c in ("event_id", "u", "k", "kind", "h"))
    busy = (kind == 1) & (h % 3 == 0)
    e = e.withColumn("t", F.when(kind == 0, F.col("g")).when(busy, F.lit(0).cast("bigint")))
    firsts = e.filter(k == 0).select(F.col("g").alias("t"), F.col("message_id").alias("root_id"))
    e = lookup(e, firsts, ["t"], spread=["event_id"])
    thread = (
        F.when((kind == 0) & ((k == 0) | (h % 10 != 9)), F.col("root_id"))
        .when(busy, F.col("root_id"))
        .when((kind == 2) & (k == 0), F.col("message_id"))
        .when(kind == 2, _text("missing-", F.col("g")))
    )
    ticket = F.when(i % 5 == 0, i % 40).otherwise(_div(i, 4))
    text = _text(
        F.col("event_type"),
        F.when(i % 4 != 3, _text(" PROJ-", ticket)).otherwise(""),
        F.when(i % 3 == 0, _text(" see OPS-", i % 7)).otherwise(""),
        F.when(i % 8 == 0, _text(" <@U", u + 1, ">"))
        .when(i % 8 == 4, _text(" <@U", _div(i, 6), ">"))
        .otherwise(""),
    )
    me = _text("U", u)
    name = _text("user", u)
    profile = F.struct(
        me.alias("id"),
        name.alias("name"),
        _text("Person ", u).alias("real_name"),
        (u % 10 == 0).alias("is_bot"),
        F.struct(_text(name, "@example.com").alias("email")).alias("profile"),
    )

    def reaction(emoji: str, n: Column, *users: Column) -> Column:
        return F.struct(
            F.lit(emoji).alias("name"),
            n.cast("bigint").alias("count"),
            F.array(*users).alias("users"),
        )

    reactions = F.when(
        F.col("event_type") == "click", F.array(reaction("thumbsup", 1 + i % 3, me))
    ).when(
        F.col("event_type") == "purchase",
        F.array(
            reaction("fire", F.lit(1), me), reaction("eyes", F.lit(2), me, _text("U", u + 2))
        ),
    )
    file = F.struct(
        _text("F", i).alias("id"),
        _text("file", i, ".png").alias("name"),
        _text("https://files.example/F", i).alias("url_private"),
        F.lit("image/png").alias("mimetype"),
        (i * 10).alias("size"),
    )
    announced = F.when((kind == 0) & (k == 0), F.when(h % 2 == 0, 4).otherwise(6)).otherwise(0)
    return e.select(
        F.struct(
            F.col("message_id").alias("ts"),
            me.alias("user"),
            text.alias("text"),
            thread.alias("thread_ts"),
            announced.cast("bigint").alias("reply_count"),
            F.when(u % 25 != 24, profile).alias("user_info"),
            reactions.alias("reactions"),
            F.when(F.col("event_type") == "view", F.array(file)).alias("files"),
        ).alias("record"),
        F.when(h % 3 == 0, "ch0").otherwise(_text("ch", h % 7)).alias("channel"),
    )


def message_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_messages(spark, sf_dir).select(F.to_json("record").alias("value"), "channel")


def ticket_lines(spark: SparkSession, sf_dir: str, moved: bool = False) -> DataFrame:
    """Issue JSON of every part; ``moved`` gives only those that changed by the later
    snapshot, with their status one step on. ``at`` keeps the order of the table's rows."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    if moved:
        p = p.filter(F.col("p_partkey") % 2 == 0)
    # a compressed file of a few MB is one task, and a row's JSON costs far more than its bytes
    p = p.withColumn("at", F.monotonically_increasing_id()).repartition("p_partkey", "at")
    step = size + (1 if moved else 0)
    status = F.when(step % 3 == 0, "Open").when(step % 3 == 1, "In Progress").otherwise("Done")

    def named(value: Column) -> Column:
        return F.struct(value.alias("name"))

    def link(kind: str, side: str, other: Column) -> Column:
        keyed = F.struct(_text("PROJ-", other).alias("key"))
        nothing = F.lit(None).cast("struct<key:string>")
        return F.struct(
            named(F.lit(kind)).alias("type"),
            (keyed if side == "out" else nothing).alias("outwardIssue"),
            (keyed if side == "in" else nothing).alias("inwardIssue"),
        )

    links = F.concat(
        F.when(key % 5 == 0, F.array(link("Blocks", "in", key + 1))).otherwise(F.array()),
        F.when(key % 5 == 1, F.array(link("Blocks", "out", key - 1))).otherwise(F.array()),
        F.when(key % 7 == 0, F.array(link("Relates", "out", key + 2))).otherwise(F.array()),
    )
    authors = F.transform(
        F.sequence(F.lit(1), (key % 4 + 1).cast("int")),
        lambda n: F.struct(
            F.struct(_text("Person ", (key + n % 2) % 20).alias("displayName")).alias("author")
        ),
    )
    fields = F.struct(
        _text(
            F.col("p_name"),
            F.when(key % 4 == 0, _text(" - ", F.repeat(_text(F.col("p_type"), " "), 9))).otherwise(""),
        ).alias("summary"),
        named(status).alias("status"),
        named(F.col("p_brand")).alias("priority"),
        named(F.col("p_type")).alias("issuetype"),
        F.when(key % 9 != 8, F.struct(_text("Person ", key % 20).alias("displayName"))).alias("assignee"),
        size.cast("double").alias("customfield_10016"),
        F.array(_text("[id=", key, ",name=Sprint ", key % 3, ",state=active]")).alias("customfield_10020"),
        F.lit("2024-01-02T08:00:00.000+0000").alias("created"),
        F.lit("2024-01-09T08:00:00.000+0000").alias("updated"),
        links.alias("issuelinks"),
        F.array(named(F.col("p_type"))).alias("components"),
        F.array(F.lower("p_type")).alias("labels"),
        F.struct((size * 2).alias("total"), size.alias("progress")).alias("progress"),
        F.struct(F.lit("PROJ").alias("key")).alias("project"),
        F.struct(authors.alias("comments")).alias("comment"),
    )
    record = F.struct(_text("PROJ-", key).alias("key"), fields.alias("fields"))
    return p.select(F.to_json(record).alias("value"), "at")


def user_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile JSON of every customer."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    name = _text("user", key)
    record = F.struct(
        _text("U", key).alias("id"),
        name.alias("name"),
        F.col("c_name").alias("real_name"),
        (key % 10 == 0).alias("is_bot"),
        F.struct(_text(name, "@example.com").alias("email")).alias("profile"),
    )
    return c.select(F.to_json(record).alias("value"))


def thread_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thread answers as the service pages them: the parent, then a page of replies."""
    r = raw_messages(spark, sf_dir).select(
        "channel",
        F.col("record.thread_ts").alias("thread_ts"),
        F.col("record.ts").alias("ts"),
        F.col("record.reply_count").alias("announced"),
        F.to_json("record").alias("value"),
    )
    key = ["channel", "thread_ts"]
    parents = r.filter((F.col("thread_ts") == F.col("ts")) & (F.col("announced") > 0)).select(
        *key, F.col("value").alias("parent")
    )
    replies = r.filter(F.col("thread_ts") != F.col("ts"))
    replies = replies.withColumn("at", F.timestamp_micros((F.col("ts").cast("decimal(20,6)") * 1_000_000).cast("bigint")))
    replies = number_rows(replies, key, "at", ["ts"], "no", HOUR)
    replies = lookup(replies, parents, key, "inner", spread=["ts"])
    page = F.floor((F.col("no") - 1) / PAYLOAD_REPLIES)
    return (
        replies.groupBy(*key, page.alias("page"))
        .agg(
            F.max("parent").alias("parent"),
            F.sort_array(F.collect_list(F.struct("no", "value"))).alias("rs"),
        )
        .select(
            "channel",
            F.concat(F.array("parent"), F.transform("rs", lambda x: x["value"])).alias("messages"),
        )
    )


def stakeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.col("s_suppkey")
    name = _text("Person ", key)
    return s.select(
        F.when(key % 4 == 3, F.lower(name)).otherwise(name).alias("name"),
        (1 + key * 7 % 10).cast("int").alias("weight"),
        F.col("s_name").alias("role"),
        F.lit("").alias("description"),
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    key = F.col("r_regionkey")
    kinds = F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low")])
    return r.select(
        F.when(key % 3 == 1, _text("channel_ch", key)).otherwise(_text("ch", key)).alias("name"),
        F.when(key == 4, _text("G00", key)).otherwise(_text("C00", key)).alias("id"),
        _text("About ", F.col("r_name")).alias("description"),
        F.element_at(kinds, (key % 4 + 1).cast("int")).alias("signal_type"),
        F.array(F.lower("r_name")).alias("tags"),
    )


def requested_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.col("n_nationkey")
    return n.select(
        F.when(key % 2 == 0, _text("channel_ch", key)).otherwise(_text("ch", key)).alias("channel")
    )


def once(rows: DataFrame, purpose: str) -> DataFrame:
    """Rows worked out once and kept, since sinks read their batch more than once."""
    path = fresh_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def ticket_batch(spark: SparkSession, sf_dir: str, day: str) -> DataFrame:
    """A snapshot's normalised tickets, in the order ``at``."""
    lines = ticket_lines(spark, sf_dir, day != "2024-01-10")
    return once(raw.normalise_tickets(lines, carry=["at"])[0], "ticket-batch")


def build_store(spark: SparkSession, sf_dir: str, root: str) -> None:
    messages, _ = raw.normalise_messages(message_lines(spark, sf_dir), RUN_DAY)
    store.overwrite_messages(once(messages, "message-batch"), root)
    for day, stamp in SNAPSHOTS.items():
        tickets = ticket_batch(spark, sf_dir, day)
        store.upsert_tickets(spark, tickets, root, day, instant(stamp), "at")
    users, _ = raw.normalise_users(user_lines(spark, sf_dir), USERS_CACHED_AT)
    store.upsert_users(spark, users, root)


class Chat:
    """The stored chat tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = pin_utc(spark)
        self.sf_dir = sf_dir.rstrip("/")

    @cached_property
    def root(self) -> str:
        root = fresh_folder(self.spark, "chat-store")
        build_store(self.spark, self.sf_dir, root)
        return root

    @cached_property
    def messages(self) -> DataFrame:
        return tables.read_messages(self.spark, self.root)

    @cached_property
    def tickets(self) -> DataFrame:
        return tables.read_tickets(self.spark, self.root)

    @cached_property
    def users(self) -> DataFrame:
        return tables.read_users(self.spark, self.root)

    @property
    def stakeholders(self) -> DataFrame:
        return stakeholders(self.spark, self.sf_dir)

    @property
    def channels(self) -> DataFrame:
        return channels(self.spark, self.sf_dir)

    @property
    def requested(self) -> DataFrame:
        return requested_channels(self.spark, self.sf_dir)

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/embeddings.parquet")


def chat(spark: SparkSession, sf_dir: str) -> Chat:
    """The chat tables of a folder, built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _chats:
        _chats[key] = Chat(spark, sf_dir)
    pin_utc(spark)
    return _chats[key]
