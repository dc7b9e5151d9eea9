"""Mixing of sources to target weights by Poisson replication.

A source of ``n`` documents with weight ``w`` gets the repetition rate ``total * w / n``, and each
of its documents is repeated a Poisson number of times with that mean: the distribution is
inverted at a number in [0, 1) that a hash of seed, id and text gives. So the counts are
independent of order and partitions, and expected sizes meet the weights. Copies are then
shuffled globally: a hash of seed, document and copy is their order. Only DataFrame functions
are used.

A rate above ``PART`` is split into equal parts, each drawn by itself, since a sum of Poisson
numbers is one too; so the table of the distribution stays short at any rate.

Defined cases: a null source is a source of its own; a source that ``weights`` doesn't name has
weight 1; null texts count as empty, null ids as the word "null"; repeated rows (same id and
text) are repeated alike; an empty table gives an empty result; further columns pass through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Largest rate drawn at once, and entries of the table of its distribution: less than one
#: part in 2**52 of it, the step of the hashed numbers, lies beyond them.
PART = 16
ENTRIES = 80
HEX_DIGITS = 13


def hashed(*parts: Column) -> Column:
    """A whole number below 2**52 from a hash of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("long")


def rates(
    documents: DataFrame, *, source: str, weights: dict[str, float] | None, total: float | None
) -> DataFrame:
    """Per source: ``parts`` and ``cdf``, the distribution of one part's count.

    ``total`` is the expected number of rows, by default as many as there are.
    """
    given = F.lit(1.0)
    for name, weight in (weights or {}).items():
        given = F.when(F.col("_source") == name, F.lit(float(weight))).otherwise(given)
    counts = documents.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("w", given)
    all_w, all_n = (counts.agg(F.sum(c)).scalar() for c in ("w", "n"))
    want = all_n if total is None else F.lit(float(total))
    mean = want * F.col("w") / all_w / F.col("n")
    table = (
        counts.withColumn("mean", mean)
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("mean") / PART)))
        .withColumn("rate", F.col("mean") / F.col("parts"))
    )
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(ENTRIES)),
        F.struct(
            F.exp(-F.col("rate")).alias("p"),
            F.exp(-F.col("rate")).alias("sum"),
            F.array(F.exp(-F.col("rate"))).alias("cdf"),
        ),
        lambda a, k: F.struct(
            (a["p"] * F.col("rate") / k).alias("p"),
            (a["sum"] + a["p"] * F.col("rate") / k).alias("sum"),
            F.concat(a["cdf"], F.array(a["sum"] + a["p"] * F.col("rate") / k)).alias("cdf"),
        ),
        lambda a: a["cdf"],
    )
    return table.select("_source", "mean", "parts", steps.alias("cdf"))


def replicated(
    documents: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    weights: dict[str, float] | None = None,
    total: float | None = None,
    seed: int = 7,
    carry: list[str] | None = None,
) -> DataFrame:
    """Every copy as ``_doc`` (all columns, or those named by ``carry``) with its number ``_copy``
    and ``_order``, its place in the global shuffle. Rows lie in that order, dealt by range."""
    given = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = documents.select(
        F.struct(*(carry or ["*"])).alias("_doc"),
        F.col(source).alias("_of"),
        F.concat_ws("|", F.lit(str(seed)), given, F.md5(text_of(text))).alias("_name"),
    )
    table = rates(documents, source=source, weights=weights, total=total)
    rows = rows.join(table, F.col("_of").eqNullSafe(F.col("_source")))
    draw = hashed(F.col("_name"), F.col("_part").cast("string")) / F.lit(float(1 << 4 * HEX_DIGITS))
    copies = (
        rows.select("*", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("_part"))
        .select("*", draw.alias("_u"))
        .select("*", F.size(F.filter("cdf", lambda c: c <= F.col("_u"))).alias("_times"))
        .filter("_times > 0")
        .select("*", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_k"))
    )
    number = (F.col("_part") - 1) * (ENTRIES + 1) + F.col("_k") - 1
    return (
        copies.select("_doc", "_name", number.cast("long").alias("_copy"))
        .select("_doc", "_copy", hashed(F.col("_name"), F.lit("copy"), F.col("_copy").cast("string")).alias("_order"))
        .repartitionByRange("_order", "_copy")
        .sortWithinPartitions("_order", "_copy")
    )


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The copies in their order, with the columns given."""
    return replicated(documents, **options).select("_doc.*")
