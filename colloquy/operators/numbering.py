"""Row numbers within groups that may be too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder

MINUTE, HOUR = 60, 3_600


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    ts: str,
    ties: Sequence[str],
    name: str,
    grain: int = MINUTE,
) -> DataFrame:
    """Number rows 1, 2, 3 … per group in order of ``ts``, then ``ties``.

    The group is cut into time slices of ``grain`` seconds. Rows are numbered inside
    their slice, and each slice gets the count of all earlier slices of its group. A busy
    group is so spread over as many tasks as it has slices; the only table that one task
    sees whole per group has one small row per slice, so it grows with the time span and
    not with the rows.
    """
    group = list(group)
    slice_no = F.coalesce(F.floor(F.unix_seconds(F.col(ts)) / grain), F.lit(-1)).cast("bigint")
    cut = df.withColumn("_slice", slice_no)
    earlier = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        cut.groupBy(*group, "_slice")
        .agg(F.count("*").alias("_n"))
        .select(*group, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    )
    inside = W.partitionBy(*group, "_slice").orderBy(ts, *ties)
    numbered = cut.withColumn("_inside", F.row_number().over(inside))
    same = F.col("_slice") == F.col("_of_slice")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    bases = bases.select(
        "_base", F.col("_slice").alias("_of_slice"), *[F.col(g).alias(f"_of_{g}") for g in group]
    )
    return numbered.join(bases, same).select(
        *df.columns, (F.col("_base") + F.col("_inside")).cast("bigint").alias(name)
    )


def number_sorted(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str
) -> DataFrame:
    """Number rows 1, 2, 3 … per group in ``order``, however the order's values are spread.

    Rows are range-sorted by group and order, and made durable so that positions are stable. A
    row's number is its position in its partition plus what earlier partitions hold of its group.
    So a group whose rows share a minute, or have no time at all, is still many tasks; only equal
    rows need one. Costs a sort of whole rows, so :func:`number_rows` is for usual groups.
    """
    shared_folder(df.sparkSession)
    group, place = list(group), F.monotonically_increasing_id()
    laid = df.orderBy(*group, *order).withColumn("_place", place).checkpoint()
    laid = laid.withColumn("_part", F.shiftright("_place", 33))
    extents = laid.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1
    bases = extents.select(
        base.alias("_base"), F.col("_part").alias("_of_part"), *[F.col(g).alias(f"_of_{g}") for g in group]
    )
    same = F.col("_part") == F.col("_of_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return laid.join(bases, same).select(
        *df.columns, (F.col("_place") + F.col("_base")).cast("bigint").alias(name)
    )
