"""Sinks of the stored tables: idempotent upserts, overwrites, inventory, exports.

There must be one writer per table at a time. An upsert reads only the partitions
its batch touches and replaces only those. A batch is evaluated twice, once for its partition
columns alone and once for the write, so it must give the same rows each time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.instants import from_iso
from ..session import fresh_folder, shared_folder
from .tables import messages_path, read_typed, tickets_path, users_path

DAY_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
ROWS_PER_FILE = 1_000_000
USER_BUCKETS = 64


USERS_STORED = T.StructType([*schemas.USERS.fields, T.StructField("bucket", T.IntegerType())])


def check_day(day: str) -> str:
    if not re.match(DAY_PATTERN, day):
        raise ValueError(f"Invalid date format: {day}. Expected YYYY-MM-DD")
    return day


def checked_day(day: Column) -> Column:
    """The day itself; the job fails on a malformed one."""
    bad = F.concat(F.lit("Invalid date format: "), F.coalesce(day, F.lit("null")))
    return F.when(day.rlike(DAY_PATTERN), day).otherwise(F.raise_error(bad))


def stacked(stored: DataFrame, batch: DataFrame, sequence: str | None = None) -> DataFrame:
    """Stored rows and those of a batch, with their order in ``_new`` and ``_seq``.

    ``sequence`` names the batch's order column, of any type that orders; without it the
    row order of the batch's partitions counts.
    """
    order = F.col(sequence) if sequence else F.monotonically_increasing_id()
    columns = stored.columns
    new = batch.select(*columns, order.alias("_seq")).withColumn("_new", F.lit(1))
    kind = new.schema["_seq"].dataType
    old = stored.withColumn("_seq", F.lit(None).cast(kind)).withColumn("_new", F.lit(0))
    return old.select(*columns, "_seq", "_new").unionByName(new)


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of stacked rows those that count: new ones beat stored ones, the last of a batch beats
    earlier ones. Rows that are already dealt out by some of the keys stay where they are."""
    first = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc("_seq"))
    numbered = rows.withColumn("_nth", F.row_number().over(first))
    return numbered.filter("_nth = 1").drop("_nth", "_new", "_seq")


@contextmanager
def _instants_with_statistics(spark: SparkSession) -> Iterator[None]:
    """Writes instants as whole microseconds, for which Parquet keeps minima and maxima."""
    name = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(name)
    spark.conf.set(name, "TIMESTAMP_MICROS")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _write_partitions(
    df: DataFrame,
    sizes: DataFrame,
    path: str,
    by: list[str],
    key: str,
    rows_per_file: int,
    merge: bool = False,
) -> int:
    """Swap in the partitions of ``df``; gives the number of files planned.

    ``sizes`` bounds the rows of each partition. A partition over ``rows_per_file`` is cut
    into slices, and each (partition, slice) is sorted by key and written by one task as one
    file, so a busy channel day neither stays in one task nor breaks into many small files.
    With ``merge`` rows are stacked ones: equal keys meet in that same task, so that rows are
    shuffled once. ``key`` gets a Bloom filter in each file.
    """
    needed = F.ceil(F.col("_rows") / rows_per_file).cast("int")
    total = sizes.agg(
        F.coalesce(F.sum(needed), F.lit(0)).alias("files"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")
    ).first()
    if total.files == 0:
        return 0
    spark = df.sparkSession
    spread = max(spark.sparkContext.defaultParallelism, -(-total.n // rows_per_file))
    # At most rows / rows_per_file partitions are heavy, which bounds the broadcast.
    heavy = sizes.filter(F.col("_rows") > rows_per_file).select(*by, needed.alias("_slices"))
    sliced = df.join(F.broadcast(heavy), by, "left").withColumn(
        "_slice", F.pmod(F.xxhash64(key), F.coalesce("_slices", F.lit(1)))
    )
    dealt = sliced.drop("_slices").repartition(min(total.files, spread), *by, "_slice")
    if merge:
        dealt = newest(dealt, [*by, "_slice", key])  # which sorts them too
    else:
        dealt = dealt.sortWithinPartitions(*by, key)
    with _instants_with_statistics(spark):
        (
            dealt.drop("_slice")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "snappy")
            .option(f"parquet.bloom.filter.enabled#{key}", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .partitionBy(*by)
            .parquet(path)
        )
    return total.files


def _sizes(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("_rows"))


def _upsert_partitions(
    spark: SparkSession,
    batch: DataFrame,
    path: str,
    schema: T.StructType,
    by: list[str],
    key: str,
    sequence: str | None,
    rows_per_file: int,
    derived: Mapping[str, Column] | None = None,
) -> None:
    """Merge a batch into the partitions it touches, in one shuffle.

    ``derived`` gives columns that files hold and batches, or older files, may lack.
    """
    shared_folder(spark)
    batch = batch.withColumn("dt", checked_day(F.col("dt")))
    new = _sizes(batch, by).checkpoint()  # a row for each partition touched
    first, last = new.agg(F.min("dt"), F.max("dt")).first()
    if first is None:
        return
    # The batch's first and last day as a partition filter keep days outside from being
    # listed and read; the semi join then leaves just the touched partitions.
    stored = read_typed(spark, path, schema).filter(F.col("dt").between(first, last))
    stored = stored.join(new.select(*by), by, "left_semi").select(*schema.fieldNames())
    for name, value in (derived or {}).items():
        stored = stored.withColumn(name, F.coalesce(name, value))
        batch = batch.withColumn(name, value)
    sizes = new.unionByName(_sizes(stored, by)).groupBy(*by).agg(F.sum("_rows").alias("_rows"))
    # Dynamic overwrite stages all output and swaps partitions at job commit, after
    # the last read of the old ones.
    rows = stacked(stored, batch, sequence)
    _write_partitions(rows, sizes, path, by, key, rows_per_file, merge=True)


def upsert_messages(
    spark: SparkSession,
    batch: DataFrame,
    root: str,
    sequence: str | None = None,
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Merge a batch into its (dt, channel) partitions by ``message_id``."""
    _upsert_partitions(
        spark,
        batch,
        messages_path(root),
        schemas.MESSAGES_FILE,
        ["dt", "channel"],
        "message_id",
        sequence,
        rows_per_file,
        {"event_ts": from_iso(F.col("timestamp"))},
    )


def upsert_tickets(
    spark: SparkSession,
    batch: DataFrame,
    root: str,
    day: str,
    cached_at: Column | None = None,
    sequence: str | None = None,
) -> None:
    """Merge a batch of tickets into one day's snapshot, stamped with ``cached_at``."""
    check_day(day)
    stamped = batch.withColumn("dt", F.lit(day)).withColumn(
        "cached_at", F.current_timestamp() if cached_at is None else cached_at
    )
    _upsert_partitions(
        spark,
        stamped,
        tickets_path(root),
        schemas.TICKETS_STORED,
        ["dt"],
        "ticket_id",
        sequence,
        ROWS_PER_FILE,
    )


def upsert_users(
    spark: SparkSession, batch: DataFrame, root: str, sequence: str | None = None
) -> None:
    """Merge a batch into the global user table by ``user_id``.

    Users lie in buckets by a hash of their id. Only touched buckets are read and swapped, by
    dynamic overwrite at job commit, so a failure leaves the old users in place.
    """
    shared_folder(spark)
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(USER_BUCKETS)).cast("int")
    batch = batch.withColumn("bucket", bucket).checkpoint()
    touched = [r.bucket for r in batch.select("bucket").distinct().collect()]
    if not touched:
        return
    stored = read_typed(spark, users_path(root), USERS_STORED)
    stored = stored.filter(F.col("bucket").isin(touched))
    merged = newest(stacked(stored, batch, sequence), ["bucket", "user_id"])
    (
        merged.repartition("bucket")
        .sortWithinPartitions("bucket", "user_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy("bucket")
        .parquet(users_path(root))
    )


def overwrite_messages(
    batch: DataFrame, root: str, rows_per_file: int = ROWS_PER_FILE
) -> None:
    """Replace the partitions of a batch without merging; an empty batch is an error."""
    shared_folder(batch.sparkSession)
    by = ["dt", "channel"]
    rows = batch.withColumn("dt", checked_day(F.col("dt")))
    sizes = _sizes(rows, by).checkpoint()
    rows = rows.withColumn("event_ts", from_iso(F.col("timestamp")))
    rows = rows.select(*schemas.MESSAGES_FILE.fieldNames())
    if not _write_partitions(rows, sizes, messages_path(root), by, "message_id", rows_per_file):
        raise ValueError("no messages to save")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Rows, files and bytes per partition, and one total row with null keys."""
    df = read_typed(spark, messages_path(root), schemas.MESSAGES_STORED)
    try:
        files = df.select(
            "dt",
            "channel",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("bytes"),
        )
    except AnalysisException:  # an absent table has no files
        files = df.select("dt", "channel", F.lit("").alias("path"), F.lit(0).alias("bytes"))
    per_file = files.groupBy("dt", "channel", "path", "bytes").agg(F.count("*").alias("n"))
    per_partition = per_file.groupBy("dt", "channel").agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("files"),
        F.sum("bytes").cast("bigint").alias("bytes"),
        F.lit(1).cast("bigint").alias("partitions"),
    )
    total = per_partition.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
            for c in ("rows", "files", "bytes", "partitions")
        ]
    )
    return per_partition.unionByName(total, allowMissingColumns=True)


def export(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Write a result as JSON lines or CSV with a header."""
    writer = df.write.mode("errorifexists")
    if fmt == "json":
        writer.json(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
    return path


def export_fresh(df: DataFrame, fmt: str = "json") -> str:
    """Export into a new folder below the shared folder."""
    return export(df, fresh_folder(df.sparkSession, f"export-{fmt}"), fmt)
