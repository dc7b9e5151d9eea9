"""Relations between messages, people, tickets and embedding vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from ..functions.text import mention_ids
from ..session import fresh_folder
from .keys import ROWS_PER_TASK, listed, lookup
from .tickets import mentioned

# Days of the current, comparison and persistence windows.
CURRENT_DAYS, COMPARISON_DAYS, PERSISTENCE_DAYS = 7, 21, 28
DUPLICATE_SCORE = 0.85
CLUSTER_SCORE = 0.7
# Nodes that a worker joins at once, before clusters are searched across tasks.
NODES_AT_ONCE = 200_000


def _node(kind: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.concat_ws("/", *parts))


def edge_list(messages: DataFrame) -> DataFrame:
    """Typed edges (source, target, edge_type) between users, messages, threads, tickets
    and channels."""
    user, message = _node("user", "user_id"), _node("msg", "channel", "message_id")

    def edges(df: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
        return df.select(
            source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type")
        )

    known = messages.filter(F.col("user_id").isNotNull())
    replies = messages.filter("is_thread_reply")
    threaded = messages.filter(F.col("is_thread_reply") | F.col("is_thread_parent"))
    mentions = messages.select(
        "channel", "message_id", F.explode(F.array_distinct(mention_ids(F.col("text")))).alias("u")
    )
    active = known.select("user_id", "channel").distinct()
    parts = [
        edges(known, user, message, "posted"),
        edges(replies, message, _node("msg", "channel", "thread_ts"), "replied_to"),
        edges(threaded, message, _node("thread", "channel", "thread_ts"), "part_of"),
        edges(mentioned(messages), message, _node("jira", "ticket_id"), "references"),
        edges(mentions, _node("user", "u"), message, "mentioned"),
        edges(active, user, _node("channel", "channel"), "active_in"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def users_across_channels(messages: DataFrame) -> DataFrame:
    """Users who discuss one ticket in more than one channel."""
    fine = mentioned(messages, "user_id").select("ticket_id", "user_id", "channel").distinct()
    return (
        fine.filter(F.col("user_id").isNotNull())
        .groupBy("ticket_id", "user_id")
        .agg(F.count("*").alias("channels"))
        .filter(F.col("channels") > 1)
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two float vectors, in double precision."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(
            F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )

    return dot(left, right) / F.nullif(F.sqrt(dot(left, left) * dot(right, right)), F.lit(0.0))


def nearest(
    vectors: DataFrame, query: Sequence[float], k: int = 10, vector: str = "embedding"
) -> DataFrame:
    """The ``k`` vectors closest to ``query`` by cosine, exactly."""
    target = F.array(*[F.lit(float(x)) for x in query])
    return (
        vectors.withColumn("score", cosine(F.col(vector), target))
        .orderBy(F.desc("score"), "vec_id")
        .limit(k)
        .drop(vector)
    )


def nearest_to(vectors: DataFrame, vec_id: int, k: int = 10) -> DataFrame:
    """The ``k`` nearest vectors of a stored one, itself included."""
    query = vectors.filter(F.col("vec_id") == vec_id).select(F.max("embedding")).scalar()
    return (
        vectors.withColumn("_query", query)
        .withColumn("score", cosine(F.col("embedding"), F.col("_query")))
        .orderBy(F.desc("score"), "vec_id")
        .limit(k)
        .drop("embedding", "_query")
    )


def near_duplicates(
    vectors: DataFrame, vec_id: int, k: int = 10, above: float = DUPLICATE_SCORE
) -> DataFrame:
    """Those of the ``k`` nearest vectors that score over ``above``, without the vector itself."""
    return nearest_to(vectors, vec_id, k).filter(
        (F.col("score") > above) & (F.col("vec_id") != vec_id)
    )


def clusters(
    edges: DataFrame, above: float = CLUSTER_SCORE, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Connected components of the edges (a, b, score) that score over ``above``.

    Edges that lie together are joined first, a bounded number at a time, so that a chain in
    one partition is a star before anything is shuffled. Nodes that then have one target and
    aren't a target themselves wait; they get their target's component in the end. For the others,
    large-star and small-star steps alternate (Kiveris et al., "Connected Components in MapReduce
    and Beyond", 2014) until every node points to the smallest id of its component. Every step is
    written to the shared folder, so a lost executor costs one step at most.
    """
    kept = edges.filter((F.col("score") > above) & (F.col("a") != F.col("b")))
    state = kept.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if all(isinstance(f.dataType, (StringType, IntegralType)) for f in state.schema):
        state = state.mapInArrow(_joined, state.schema)
    given = _written(state.distinct())
    waiting = _written(_ends(given))
    state = _written(lookup(given, waiting.select("u"), ["u"], "left_anti", rows_per_task, ["v"]))
    _emptied(given)
    while not _settled(state):
        for step in (_large_star, _small_star):
            before, state = state, _written(step(state, rows_per_task))
            _emptied(before)
    tops = state.select(F.col("u").alias("v"), F.col("v").alias("m"))
    waited = lookup(waiting, tops, ["v"], "left", rows_per_task, ["u"])
    waited = waited.select("u", F.coalesce("m", "v").alias("v"))
    found = _written(state.unionByName(waited))
    _emptied(state, waiting)
    roots = found.select(F.col("v").alias("node"), F.col("v").alias("cluster")).distinct()
    return found.select(F.col("u").alias("node"), F.col("v").alias("cluster")).unionByName(roots)


def _written(rows: DataFrame) -> DataFrame:
    """The rows, written below the shared folder and read from there."""
    path = fresh_folder(rows.sparkSession, "links")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _emptied(*tables: DataFrame) -> None:
    """Takes the rows out of written tables that aren't read any more."""
    for rows in tables:
        if files := rows.inputFiles():
            none = rows.sparkSession.createDataFrame([], rows.schema)
            none.write.mode("overwrite").parquet(files[0].rpartition("/")[0])


def _ends(state: DataFrame) -> DataFrame:
    """The edges of nodes with one edge in all, to a smaller node."""
    nothing = F.lit(None).cast(state.schema["v"].dataType)
    sides = state.select("u", F.col("v").alias("m"), F.lit(0).alias("onto")).unionByName(
        state.select(F.col("v").alias("u"), nothing.alias("m"), F.lit(1).alias("onto"))
    )
    seen = sides.groupBy("u").agg(F.min("m").alias("v"), F.max("m").alias("x"), F.max("onto").alias("onto"))
    return seen.filter("v = x AND onto = 0").select("u", "v")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join the same nodes as those given, each to the smallest node that it reaches
    within so many batches as hold ``NODES_AT_ONCE`` nodes."""
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while (up := parent[x]) != top:
            parent[x], x = top, up
        return top

    def stars(schema: pa.Schema) -> pa.RecordBatch:
        rows = [(x, top) for x in parent if (top := root(x)) != x]
        parent.clear()
        columns = [pa.array([r[i] for r in rows], schema.field(i).type) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=["u", "v"])

    schema = None
    for batch in batches:
        schema = batch.schema
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) >= NODES_AT_ONCE:
            yield stars(schema)
    if parent:
        yield stars(schema)


def _settled(state: DataFrame) -> bool:
    """Whether every node has one target, and no target points on."""
    targets = state.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))
    if not targets.filter("m < x").isEmpty():
        return False
    onward = state.select(F.col("u").alias("v"))
    return state.select("v").distinct().join(onward, "v", "left_semi").isEmpty()


def _large_star(state: DataFrame, rows_per_task: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it: edges lead from
    the larger to the smaller node, so that an edge's ``u`` is linked to the least target of its
    ``v``, or to ``v`` if that has none."""
    least = state.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    joined = lookup(state, least, ["v"], "left", rows_per_task, ["u"])
    return joined.select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(state: DataFrame, rows_per_task: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    least = state.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = lookup(state, least, ["u"], "inner", rows_per_task, ["v"], "n")
    linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return linked.unionByName(own).filter(F.col("u") != F.col("v")).distinct()


def topics(rows: DataFrame) -> DataFrame:
    """Per topic of (topic_id, channel, message_id): messages and channels, for topics with
    several messages; topic -1 means none."""
    fine = (
        rows.filter(F.col("topic_id") != -1)
        .groupBy("topic_id", "channel")
        .agg(F.count("message_id").alias("n"))
    )
    totals = fine.groupBy("topic_id").agg(F.sum("n").alias("messages"))
    lists = listed(
        fine.select("topic_id", "channel"),
        ["topic_id"],
        "channel",
        "channel_count",
        "channels",
    )
    return totals.filter(F.col("messages") > 1).join(lists, "topic_id")


def topic_states(messages: DataFrame, as_of: Column) -> DataFrame:
    """Each ticket's direction: appearing, fading or persisting.

    Appearing: mentioned in the current window but not in the comparison window before
    it. Fading: the other way round. Persisting: in both.
    """
    days = F.floor((F.unix_micros(as_of) - F.unix_micros("event_ts")) / 86_400_000_000)
    aged = mentioned(messages, "event_ts").withColumn("age", days)
    counted = (
        aged.filter(F.col("age").between(0, PERSISTENCE_DAYS - 1))
        .groupBy("ticket_id")
        .agg(
            F.count_if(F.col("age") < CURRENT_DAYS).alias("current_mentions"),
            F.count_if(
                F.col("age").between(CURRENT_DAYS, CURRENT_DAYS + COMPARISON_DAYS - 1)
            ).alias("earlier_mentions"),
        )
    )
    state = (
        F.when(F.col("earlier_mentions") == 0, "appearing")
        .when(F.col("current_mentions") == 0, "fading")
        .otherwise("persisting")
    )
    return counted.withColumn("state", state)
