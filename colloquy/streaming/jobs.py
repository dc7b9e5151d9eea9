"""Structured Streaming jobs over landed message files.

Messages may land in any order, weeks late too, and none is dropped: instead of a watermark that
forgets old state, each micro-batch leaves its part of the result in a folder of its own (a
replayed batch rewrites it), and the parts merge into the same result however the files were
dealt to batches. Watermarks only decide which sessions count as closed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.instants import day_of, from_epoch, from_iso
from ..session import shared_folder
from ..sources.raw import normalise_messages
from ..sources.store import upsert_messages

LATE = "1 day"
MESSAGE_KEY = ["channel", "message_id"]
#: Kept keys lie in parts by day and by a hash; each part has a Bloom filter of 64-bit words.
KEY_BUCKETS, FILTER_WORDS, FILTER_BITS = 16, 1 << 14, 4
NO_DAY = "none"
#: Sessions are first found within slices of this length, which must not be below the gap.
SLICE = "6 hours"
_SESSION = "channel string, session_start timestamp, session_end timestamp, messages bigint"


def message_stream(spark: SparkSession, landing: str, files_per_batch: int = 1_000) -> DataFrame:
    """Stored-schema message rows as they land, with ``event_ts`` and ``arrival``.

    ``arrival`` orders rows by their file's time, then its path and the row's place in it.
    """
    stream = (
        spark.readStream.schema(schemas.MESSAGES_STORED)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("partitionColumnTypeInference", "false")
        .parquet(landing)
    )
    arrival = F.struct(
        "_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index"
    )
    return stream.select("*", arrival.alias("arrival")).withColumn(
        "event_ts", from_iso(F.col("timestamp"))
    )


def _each_batch(stream: DataFrame, checkpoint: str, work) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _parts(spark: SparkSession, path: str, schema: str, number: int | None = None) -> DataFrame:
    """The parts that batches other than ``number`` have left."""
    try:
        rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], f"{schema}, batch bigint")
    return rows if number is None else rows.filter(F.col("batch") != number)


def _save(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def upsert_stream(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch into the stored messages, the last to arrive wins; a replayed
    batch changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.drop("event_ts")
        upsert_messages(batch.sparkSession, rows, root, sequence="arrival")

    return _each_batch(stream, checkpoint, merge)


def raw_stream(spark: SparkSession, landing: str, files_per_batch: int = 1_000) -> DataFrame:
    """Raw JSON lines (``value``) as they land below ``channel=…`` folders, with ``landed``."""
    stream = (
        spark.readStream.schema("value string, channel string")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(landing)
    )
    landed = F.struct(
        "_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"
    )
    return stream.select("*", landed.alias("landed"))


def ingest_raw(
    stream: DataFrame, root: str, rejects: str, checkpoint: str, run_day: str
) -> StreamingQuery:
    """Every micro-batch of raw records to both its sinks: normalised rows are merged into the
    stored messages, each on the day of its own time, and what can't be read is set aside.

    Both sinks may be replayed: a batch's rejects have a folder of their own, and an upsert of
    the same rows changes nothing.
    """

    def ingest(batch: DataFrame, number: int) -> None:
        arrival = F.struct("landed", F.monotonically_increasing_id().alias("line"))
        lines = batch.select("value", "channel", arrival.alias("arrival"))
        rows, bad = normalise_messages(lines, run_day, carry=["arrival"])
        _save(bad.select("value", "channel"), rejects, number)
        upsert_messages(batch.sparkSession, rows, root, sequence="arrival")

    return _each_batch(stream, checkpoint, ingest)


def rejected(spark: SparkSession, rejects: str) -> DataFrame:
    """The lines that no batch could read."""
    return _parts(spark, rejects, "value string, channel string").drop("batch")


def _keyed(rows: DataFrame, buckets: int) -> DataFrame:
    """Distinct keys with their part (the day of the id itself, so that a key never moves, and a
    bucket) and their place in its filter: a word, and the bits set there."""
    h = F.xxhash64("message_id", "channel")
    mask = F.lit(0).cast("bigint")
    for k in range(FILTER_BITS):
        bit = F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return rows.select(*MESSAGE_KEY).distinct().select(
        *MESSAGE_KEY,
        F.coalesce(day_of(from_epoch(F.col("message_id"))), F.lit(NO_DAY)).alias("day"),
        F.pmod(F.xxhash64(*MESSAGE_KEY), F.lit(buckets)).cast("int").alias("bucket"),
        F.pmod(F.shiftright(h, 32), F.lit(FILTER_WORDS)).cast("int").alias("word"),
        mask.alias("mask"),
    )


def state_parts(
    spark: SparkSession, path: str, schema: str, touched: Iterable[tuple[str, int]], number: int
) -> DataFrame:
    """The parts of the touched days and buckets that batches other than ``number`` have left.

    Only the folders of those days are listed.
    """
    whole = f"{schema}, day string, bucket int, batch bigint"
    days = sorted({d for d, _ in touched})
    buckets = sorted({b for _, b in touched})
    if not days:
        return spark.createDataFrame([], whole)
    try:
        rows = (
            spark.read.schema(whole)
            .option("basePath", path)
            .parquet(f"{path}/day={{{','.join(days)}}}")
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)
    return rows.filter(
        F.col("day").isin(days) & F.col("bucket").isin(buckets) & (F.col("batch") != number)
    )


def _save_state(rows: DataFrame, path: str, number: int) -> None:
    (
        rows.withColumn("batch", F.lit(number).cast("bigint"))
        .repartition("day", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "bucket", "batch")
        .parquet(path)
    )


def without_repeats(
    stream: DataFrame, path: str, checkpoint: str, buckets: int = KEY_BUCKETS
) -> StreamingQuery:
    """Each (channel, message_id) once, however far apart repeats come.

    Kept keys are parts by day, bucket and batch. A batch first asks the Bloom filters of its own
    days and buckets; only parts with a key that may have been kept are read and compared.
    ``buckets`` must stay the same for the life of ``path``.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        shared_folder(spark)
        keys = _keyed(batch, buckets).checkpoint()
        part = ["day", "bucket"]
        touched = [tuple(r) for r in keys.select(*part).distinct().collect()]
        filters = state_parts(spark, f"{path}/filters", "word int, bits bigint", touched, number)
        words = filters.groupBy(*part, "word").agg(F.bit_or("bits").alias("bits"))
        maybe = keys.join(words, [*part, "word"]).filter(
            F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")
        )
        known = [tuple(r) for r in maybe.select(*part).distinct().collect()]
        stored = state_parts(spark, f"{path}/keys", "channel string, message_id string", known, number)
        new = keys.join(stored.select(*MESSAGE_KEY), MESSAGE_KEY, "left_anti")
        bits = new.groupBy(*part, "word").agg(F.bit_or("mask").alias("bits"))
        _save_state(bits, f"{path}/filters", number)
        _save_state(new.select(*MESSAGE_KEY, *part), f"{path}/keys", number)

    return _each_batch(stream, checkpoint, keep)


def kept_keys(spark: SparkSession, path: str) -> DataFrame:
    return _parts(spark, f"{path}/keys", "channel string, message_id string").select(*MESSAGE_KEY)


def windowed_counts(
    stream: DataFrame, path: str, checkpoint: str, width: str = "1 hour"
) -> StreamingQuery:
    """Messages per tumbling window and channel, as partial counts of each batch."""

    def count(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy(F.window("event_ts", width).alias("w"), "channel").agg(
            F.count("*").alias("messages")
        )
        _save(rows.select(F.col("w.start").alias("bucket_start"), "channel", "messages"), path, number)

    return _each_batch(stream, checkpoint, count)


def summed_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of all batches together."""
    rows = _parts(spark, path, "bucket_start timestamp, channel string, messages bigint")
    return rows.groupBy("bucket_start", "channel").agg(F.sum("messages").alias("messages"))


def sliding_panes(
    stream: DataFrame, path: str, checkpoint: str, slide: str = "1 hour"
) -> StreamingQuery:
    """Partial counts of panes, the stretches of a slide's width that sliding windows are made
    of. A message belongs to one pane, whatever the number of windows over it."""

    def count(batch: DataFrame, number: int) -> None:
        panes = batch.groupBy(F.window("event_ts", slide).alias("w"), "channel").agg(
            F.count("*").alias("messages"),
            F.count_if("is_thread_reply").alias("replies"),
            F.min("event_ts").alias("first"),
            F.max("event_ts").alias("last"),
        )
        _save(panes.select(F.col("w.start").alias("pane"), *panes.columns[1:]), path, number)

    return _each_batch(stream, checkpoint, count)


def sliding_counts(
    spark: SparkSession, path: str, width: str = "6 hours", slide: str = "1 hour"
) -> DataFrame:
    """Every sliding window that holds a message, as the sum of its panes.

    ``width`` must be a whole number of slides, and ``slide`` the one the panes were made with.
    """
    kind = "pane timestamp, channel string, messages bigint, replies bigint, first timestamp, last timestamp"
    by = ["channel", "messages", "replies", "first", "last"]

    def merged(rows: DataFrame, start: str) -> DataFrame:
        return rows.groupBy(start, "channel").agg(
            F.sum("messages").alias("messages"),
            F.sum("replies").alias("replies"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
        )

    panes = merged(_parts(spark, path, kind), "pane")
    starts = F.expr(
        f"sequence(pane - INTERVAL '{width}' + INTERVAL '{slide}', pane, INTERVAL '{slide}')"
    )
    return merged(panes.select(F.explode(starts).alias("window_start"), *by), "window_start")


def _merged_sessions(rows: DataFrame, messages: Column, *by: str) -> DataFrame:
    """Rows (by, start, end) that overlap become one session.

    Bounds are aggregates, not the window's own: a filter on the window would be pushed below
    the merge and take away rows that join sessions.
    """
    length = F.concat(
        (F.unix_micros("end") - F.unix_micros("start")).cast("string"), F.lit(" microseconds")
    )
    return (
        rows.groupBy(*by, F.session_window("start", length).alias("w"))
        .agg(
            F.min("start").alias("session_start"),
            F.max("end").alias("session_end"),
            F.sum(messages).alias("messages"),
        )
        .drop("w")
    )


def _slice_of(start: Column | str) -> Column:
    return F.window(start, SLICE)["start"].alias("slice")


def conversation_sessions(
    stream: DataFrame, path: str, checkpoint: str, gap: str = "30 minutes"
) -> StreamingQuery:
    """Runs of a channel's messages with no pause longer than ``gap``, within each batch and
    slice of time."""

    def split(batch: DataFrame, number: int) -> None:
        end = F.expr(f"event_ts + INTERVAL '{gap}'").alias("end")
        rows = batch.filter("event_ts IS NOT NULL").select(
            "channel", _slice_of("event_ts"), F.col("event_ts").alias("start"), end
        )
        _save(_merged_sessions(rows, F.lit(1), "channel", "slice").drop("slice"), path, number)

    return _each_batch(stream, checkpoint, split)


def joined_sessions(
    spark: SparkSession, path: str, gap: str = "30 minutes", late: str | None = LATE
) -> DataFrame:
    """The sessions of all batches, those that overlap as one.

    Two levels, so that a busy channel is many tasks: sessions merge within a channel's slices of
    time first. Those that begin within a gap of their slice's start, or end at its end or behind,
    may go on in the next one; only these, two a slice at most, are stitched by channel.
    With ``late``, only sessions that ended that long before the newest message.
    """
    parts = _parts(spark, path, _SESSION)
    renamed = {"session_start": "start", "session_end": "end"}
    rows = parts.withColumnsRenamed(renamed).withColumn("slice", _slice_of("start"))
    within = _merged_sessions(rows, F.col("messages"), "channel", "slice")
    edge = (
        F.expr(f"session_start <= slice + INTERVAL '{gap}'")
        | F.expr(f"session_end >= slice + INTERVAL '{SLICE}'")
    )
    within = within.withColumn("edge", edge)
    stitched = _merged_sessions(
        within.filter("edge").withColumnsRenamed(renamed), F.col("messages"), "channel"
    )
    columns = ["channel", "session_start", "session_end", "messages"]
    sessions = within.filter("NOT edge").select(*columns).unionByName(stitched.select(*columns))
    if late is None:
        return sessions
    newest = parts.agg(F.max("session_end").alias("m")).select(
        F.expr(f"m - INTERVAL '{gap}' - INTERVAL '{late}'")
    )
    return sessions.filter(F.col("session_end") <= newest.scalar())
