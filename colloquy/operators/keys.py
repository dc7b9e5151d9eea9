"""Building blocks that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key a single task should handle; keys above it are split.
ROWS_PER_TASK = 2_000_000
_NULL_KEY_SLICES = 256


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the one that is greatest by ``order``.

    An aggregate, not a window: copies of a key are reduced before the shuffle, so
    a key with very many copies costs no more than any other.
    """
    payload = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in payload]), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def heavy_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows, with their row count.

    At most ``rows / limit`` rows come out, which is what makes a broadcast of
    the result safe.
    """
    return df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > limit)


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    rows_per_task: int = ROWS_PER_TASK,
    spread: Sequence[str] | None = None,
    rows: str | None = None,
    large: bool = False,
) -> DataFrame:
    """Join ``left`` with ``right``, which has at most one row per key.

    Keys with more than ``rows_per_task`` rows on the left are split into slices,
    and their single right row is copied once per slice. Rows with a null key are
    spread too; they match nothing. Catalyst still picks a broadcast join by itself
    when the right side is small enough. ``large`` rules that out, for right sides that it
    takes for small: texts from compressed files, or made of many columns, are many times
    larger in memory than estimated.

    The heavy keys come from a count of the left keys, or, when the right side already
    knows how many rows each key has, from its column ``rows``.
    """
    keys = list(keys)
    by = spread or [c for c in left.columns if c not in keys] or keys
    needed = F.ceil(F.col("_rows") / rows_per_task).cast("int")
    if rows is None:
        heavy = heavy_keys(left.select(*keys), keys, rows_per_task)
        heavy = heavy.select(*keys, needed.alias("_slices"))
        copied = right.join(F.broadcast(heavy), keys, "left")
    else:
        counted = right.withColumn("_rows", F.col(rows))
        heavy = counted.filter(F.col("_rows") > rows_per_task).select(*keys, needed.alias("_slices"))
        copied = counted.withColumn("_slices", F.greatest(needed, F.lit(1))).drop("_rows")
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    one = F.lit(1)
    slices = F.when(some_null, F.lit(_NULL_KEY_SLICES)).otherwise(F.coalesce("_slices", one))
    sliced = left.join(F.broadcast(heavy), keys, "left").withColumn(
        "_slice", F.pmod(F.xxhash64(*[F.col(c) for c in by]), slices).cast("int")
    )
    copied = copied.withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", one) - 1))
    )
    copied = copied.drop("_slices")
    if large:
        copied = copied.hint("merge")
    joined = sliced.drop("_slices").join(copied, [*keys, "_slice"], how)
    semi = how in ("left_semi", "left_anti")
    extra = [] if semi else [c for c in right.columns if c not in keys]
    return joined.select(*left.columns, *extra)


def listed(
    pairs: DataFrame, keys: Sequence[str], value: str, counted_as: str, listed_as: str
) -> DataFrame:
    """Exact count and complete sorted list of the distinct values of each key.

    ``pairs`` holds distinct (key, value) rows, so a list is as long as a key has different
    users, channels or tickets, however many messages stand behind them.
    """
    return (
        pairs.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(value)).alias(listed_as))
        .select(*keys, F.size(listed_as).cast("bigint").alias(counted_as), listed_as)
    )
