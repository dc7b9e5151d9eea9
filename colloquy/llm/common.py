"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.session import fresh_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z alone, so that every engine gives the same text. ASCII texts, where that is
    all there is to lower, take the faster function."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(text, "[ \\x09-\\x0D]+"), "")


_LOWER_BYTES = bytes.maketrans(
    f"{UPPER}{SPACES}".encode(), f"{UPPER.lower()}{' ' * len(SPACES)}".encode()
)


def lower_words(text: str | None) -> list[str]:
    """The words of a lower-cased (A-Z) text, in Python. No byte of a longer character is one
    of those replaced."""
    spaced = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER_BYTES)
    return [w for w in spaced.decode("utf-8", "surrogatepass").split(" ") if w]


def row_key(*columns: str) -> Column:
    """A key by content: equal for repeated rows, else different."""
    return F.xxhash64(*[F.col(c) for c in columns])


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind, else they stay until the driver happens
    to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written once as Parquet below the shared folder and read back, so that its
    lineage ends there and its readers take only their columns."""
    spark = df.sparkSession
    path = fresh_folder(spark, purpose)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(*tables: DataFrame) -> None:
    """Empties written tables, which no frame may read any more."""
    for rows in tables:
        if files := rows.inputFiles():
            none = rows.sparkSession.createDataFrame([], rows.schema)
            none.write.mode("overwrite").parquet(files[0].rpartition("/")[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: The lines between two removed ones as one slice each, so that the work is linear.
_REST = (
    "array_join(flatten(transform(sequence(0, size(_gone)), k -> slice(_lines, "
    "if(k = 0, 0, _gone[k - 1] + 1) + 1, "
    "if(k = size(_gone), size(_lines), _gone[k]) - if(k = 0, 0, _gone[k - 1] + 1)))), '\\n')"
)


def without_lines(rows: DataFrame, schema: StructType, text: str, chars: str) -> DataFrame:
    """Documents ``_doc`` without the lines ``_gone``, with the columns of ``schema``.

    ``_gone`` lists 0-based numbers of ``\\n``-split lines, ascending (null: none). In changed
    rows a column named ``chars`` is set to the new length.
    """
    changed = F.col("_gone").isNotNull()
    rows = rows.select(
        "_doc", "_gone", F.when(changed, F.split(f"_doc.{text}", "\n")).alias("_lines")
    )
    rows = rows.select("_doc", F.when(changed, F.expr(_REST)).alias("_new"))
    new = {text: F.col("_new"), chars: F.length("_new")}
    return rows.select(
        *[
            F.when(F.col("_new").isNotNull(), new[f.name].cast(f.dataType))
            .otherwise(F.col(f"_doc.`{f.name}`"))
            .alias(f.name)
            if f.name in new
            else F.col(f"_doc.`{f.name}`").alias(f.name)
            for f in schema
        ]
    )


#: Bits of a filter for each key, of which two are set, and bounds of its size.
BITS_PER_KEY, FEWEST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


def likely_in(keys: DataFrame, column: str, probe: Column) -> Column:
    """True for every key that ``keys`` holds, false for almost all others.

    A bitmap sized by the number of keys (up to ``MOST_BITS``, 32 MB; with more than 2 ** 24 keys
    it lets more rows pass), so that rows which a semi-join would drop needn't be shuffled; the
    join itself still has to follow. ``keys`` should be a written table, as it is counted first.

    Both bits of a key are in one word, so that the condition names the bitmap once: the driver
    makes it, and sends it with each stage's tasks, as often as it is named.
    """
    spark = keys.sparkSession
    bits = max(FEWEST_BITS, min(MOST_BITS, 1 << (BITS_PER_KEY * keys.count()).bit_length()))

    def place(key: Column) -> tuple[Column, Column]:
        """A key's word, and its bits there."""
        h = F.xxhash64(key, F.lit(1))
        first, second = [
            F.call_function(
                "shiftleft",
                F.lit(1).cast("long"),
                F.shiftrightunsigned(h, n).bitwiseAND(F.lit(63)).cast("int"),
            )
            for n in (40, 50)
        ]
        return h.bitwiseAND(F.lit(bits // 64 - 1)).cast("int"), first.bitwiseOR(second)

    at, mask = place(F.col(column))
    every = spark.range(bits // 64).select(F.col("id").cast("int"), F.lit(0).cast("long"))
    words = (
        keys.select(at.alias("w"), mask.alias("bits"))
        .unionAll(every)
        .groupBy("w")
        .agg(F.bit_or("bits").alias("bits"))
    )
    bitmap = words.agg(F.sort_array(F.collect_list(F.struct("w", "bits"))).alias("m"))
    at, mask = place(probe)
    return F.get(bitmap.select("m.bits").scalar(), at).bitwiseAND(mask) == mask


def greatest(rows: DataFrame, by: Column, most: int) -> DataFrame:
    """The rows with the greatest ``by``, ``most`` at most: those above a quantile, found by an
    aggregate, so that no task and no driver sorts more than it returns. Ties at the quantile
    are left out, and so may a few rows in ten thousand be."""
    rows = rows.withColumn("_by", by.cast("double"))
    n = rows.count()
    if n > most:
        cut = rows.agg(F.percentile_approx("_by", 1.0 - 0.999 * most / n, 10_000)).first()[0]
        rows = rows.filter(F.col("_by") > cut)
    return rows.drop("_by")
