"""Text views as line tables.

A view is a set of rows (view_id, ORDER columns, line); its text is the lines in ORDER,
joined by newlines. A line is the unit of work, so a view may be larger than any single
row or task. ``pages`` joins lines into texts of bounded size, ``write_text`` writes
them as sorted files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_sorted

# section: 0 header, 1 body, 2 footer. bucket_part and channel_part: 0 before, 1 inside,
# 2 after. part: 0 message, 1 replies, 2 after the replies.
ORDER = [
    "section",
    "bucket",
    "bucket_part",
    "channel_group",
    "channel_part",
    "item_no",
    "part",
    "reply_no",
    "line_no",
]


def some(condition: Column, *texts: Column) -> list[Column]:
    """The texts when the condition holds, else nulls, which are no lines."""
    return [F.when(condition, t) for t in texts]


def _places(order: dict[str, Column], skip: Sequence[str]) -> list[Column]:
    defaults = {
        "section": F.lit(1),
        "bucket": F.lit(""),
        "bucket_part": F.lit(1),
        "channel_group": F.lit(""),
        "channel_part": F.lit(1),
        "item_no": F.lit(0),
        "part": F.lit(0),
        "reply_no": F.lit(0),
    }
    places = {**defaults, **order}
    kinds = {"bucket": "string", "channel_group": "string", "item_no": "bigint", "reply_no": "bigint"}
    return [
        places[c].cast(kinds.get(c, "int")).alias(c) for c in ORDER if c != "line_no" and c not in skip
    ]


def emit(df: DataFrame, lines: Sequence[Column] | Column, **order: Column) -> DataFrame:
    """One row per non-null line; ``order`` sets ORDER columns that differ from the default."""
    listed = lines if isinstance(lines, Column) else F.array(*lines)
    filled = F.filter(listed, lambda x: x.isNotNull())
    return df.select("view_id", *_places(order, ()), F.posexplode(filled).alias("line_no", "line"))


def emit_parts(
    df: DataFrame, parts: Sequence[tuple[Column, int, Column]], **order: Column
) -> DataFrame:
    """Lines of several (condition, part, lines) in one pass over the rows."""

    def block(condition: Column, part: int, lines: Column) -> Column:
        filled = F.filter(lines, lambda x: x.isNotNull())
        rows = F.transform(
            filled, lambda x, i: F.struct(F.lit(part).alias("part"), i.alias("line_no"), x.alias("line"))
        )
        return F.when(condition, rows).otherwise(F.filter(rows, lambda r: F.lit(False)))

    rows = F.concat(*[block(*p) for p in parts])
    made = df.select("view_id", *_places(order, ("part",)), F.inline(rows))
    return made.select("view_id", *ORDER, "line")


def stack(*tables: DataFrame) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table, allowMissingColumns=True)
    return whole


def in_sequence(lines: DataFrame) -> DataFrame:
    """Adds ``seq``: 1, 2, 3 … per view in ORDER."""
    return number_sorted(lines, ["view_id"], ORDER, "seq").select("view_id", "seq", "line")


def pages(lines: DataFrame, page_lines: int = 5_000) -> DataFrame:
    """(view_id, page_no, lines, text) with at most ``page_lines`` lines per page.

    A view's text is its pages in order, joined by newlines; a view of normal size is one
    page.
    """
    page = F.floor((F.col("seq") - 1) / page_lines).cast("bigint")
    return (
        in_sequence(lines)
        .groupBy("view_id", page.alias("page_no"))
        .agg(
            F.count("*").alias("lines"),
            F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("_lines"),
        )
        .select(
            "view_id",
            "page_no",
            "lines",
            F.array_join(F.transform("_lines", lambda e: e["line"]), "\n").alias("text"),
        )
    )


def sizes(lines: DataFrame) -> DataFrame:
    """Lines and characters of each view's text, newlines between lines included."""
    return lines.groupBy("view_id").agg(
        F.count("*").alias("lines"),
        (F.sum(F.char_length("line")) + F.count("*") - 1).alias("characters"),
    )


def write_text(lines: DataFrame, path: str) -> None:
    """Text files per view; the files of a view in name order hold its lines in order."""
    (
        lines.orderBy("view_id", *ORDER)
        .select("view_id", "line")
        .write.mode("errorifexists")
        .partitionBy("view_id")
        .text(path)
    )
