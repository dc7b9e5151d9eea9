"""Quality rules for documents: text measures, and line frequency across documents.

A normalised line (A-Z lowered, runs of white space as one space, trimmed) that occurs in
many documents of one host is boilerplate: it is removed from its documents there, and a
document that loses too much of its words is rejected. Only DataFrame functions are used.

Defined cases: a null text is an empty one; a null host is a host of its own; equal texts of
one host count as one document, so a copied document doesn't turn its lines into boilerplate;
repeated rows (same id, host and text) each get the same result; an empty table gives an empty
result; further columns are passed through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, row_key, text_of, without_lines, words_of

#: A line is boilerplate where more than this share of a host's documents has it ...
MAX_SHARE = 0.10
#: ... and more than this number of them.
MIN_DOCS = 10
#: A document is depleted when boilerplate holds more than this share of its word characters.
MAX_REMOVED = 0.5
#: Base rules: fewest words, and most words in repeated windows, in per cent.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOLS = "#*$%&|<>"
#: Up to so many different repeated windows are looked up one by one, more are found by
#: sorting. Both ways give the same figure; the first is quicker for usual texts, the second
#: keeps long texts of repeats from taking quadratic time.
LOOKED_UP = 16

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the five measures and ``base_failed`` in one struct column ``_m``.

    ``n_repeat_words`` counts the words in 3-word windows which the text has twice or more:
    equal windows are neighbours in the sorted list of window hashes, and each word counts
    once however many repeated windows hold it.
    """
    kept = [F.col(c) for c in df.columns]
    df = df.select(*kept, text.alias("_t"), words_of(text).alias("_w"))
    df = df.select(
        *kept,
        "_t",
        F.size("_w").alias("_n"),
        F.expr(
            "CASE WHEN size(_w) >= 4 THEN transform(sequence(0, size(_w) - 3), "
            "i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END"
        ).alias("_h"),
    )
    df = df.select("*", F.sort_array("_h").alias("_s"))
    df = df.select(
        *kept,
        "_t",
        "_n",
        "_h",
        F.expr("array_distinct(filter(_s, (x, i) -> i > 0 AND x = _s[i - 1]))").alias("_r"),
    )
    df = df.select(
        "*",
        F.expr(
            f"CASE WHEN size(_r) > {LOOKED_UP} THEN "
            "sort_array(transform(_h, (h, i) -> struct(h AS h, i AS i))) END"
        ).alias("_z"),
    )
    df = df.select(
        *kept,
        "_t",
        "_n",
        F.expr(
            "CASE WHEN _r IS NULL OR size(_r) = 0 THEN NULL "
            f"WHEN size(_r) <= {LOOKED_UP} THEN "
            "filter(sequence(0, size(_h) - 1), i -> array_contains(_r, _h[i])) "
            "ELSE sort_array(transform(filter(_z, (x, k) -> (k > 0 AND _z[k - 1].h = x.h) OR "
            "(k + 1 < size(_z) AND _z[k + 1].h = x.h)), x -> x.i)) END"
        ).alias("_p"),
        F.expr(
            "filter(split(_t, '\\n'), x -> length(translate(x, ' \\t\\x0b\\f\\r', '')) > 0)"
            .replace("\\x0b", "\\u000b")
        ).alias("_l"),
    )
    symbols = F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))
    spaces = F.length(F.translate("_t", " \t\n\x0b\x0c\r", ""))
    repeated = F.expr(
        "coalesce(aggregate(_p, struct(-3 AS last, 0 AS n), "
        "(a, i) -> struct(i AS last, a.n + least(3, i - a.last) AS n), a -> a.n), 0)"
    )
    figures = [
        F.col("_n"),
        spaces,
        symbols,
        F.size("_l") - F.size(F.array_distinct("_l")),
        repeated,
    ]
    df = df.select(
        *kept,
        F.struct(*[x.cast("long").alias(c) for c, x in zip(MEASURES, figures, strict=True)]).alias(
            "_m"
        ),
    )
    failed = (F.col("_m.n_words") < MIN_WORDS) | (
        100 * F.col("_m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_m.n_words")
    )
    return df.withColumn("_m", F.col("_m").withField("base_failed", failed))


def boilerplate(
    documents: DataFrame,
    *,
    text: str = "text",
    host: str = "source",
    key: str = "doc_id",
    max_share: float = MAX_SHARE,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """Per document that has any: its boilerplate lines.

    Returns ``_key``, ``_row`` (a hash of the row's content), ``_gone`` (0-based numbers of the
    ``\\n``-split lines, ascending) and ``_gone_chars`` (word characters in them). Lines travel
    as hashes; equal lines of a document, then of equal texts, merge before they are counted,
    and counts merge before the shuffle, so a line in a third of all documents is no hot key.
    """
    docs = documents.select(
        F.col(key).alias("_key"),
        F.col(host).alias("_host"),
        row_key(key, host, text).alias("_row"),
        F.xxhash64(text_of(text)).alias("_same"),
        lower_az(
            F.regexp_replace(F.translate(text_of(text), "\t\x0b\x0c\r", " " * 4), " {2,}", " ")
        ).alias("_t"),
    )
    lines = (
        docs.select("*", F.posexplode(F.split("_t", "\n")).alias("_pos", "_line"))
        .select(
            "_key",
            "_row",
            "_host",
            "_same",
            "_pos",
            F.xxhash64(F.trim("_line")).alias("_hash"),
            F.length(F.translate("_line", " ", "")).alias("_chars"),
        )
        .filter(F.col("_chars") > 0)
    )
    totals = (
        docs.select("_host", "_same")
        .distinct()
        .groupBy("_host")
        .agg((F.count("*") * F.lit(max_share)).alias("_limit"))
        .withColumnRenamed("_host", "_of")
    )
    frequent = (
        lines.select("_host", "_hash", "_same")
        .distinct()
        .groupBy("_host", "_hash")
        .agg(F.count("*").alias("_docs"))
        .filter(F.col("_docs") > min_docs)
        .join(totals, F.col("_host").eqNullSafe(F.col("_of")))
        .filter(F.col("_docs") > F.col("_limit"))
        .select(F.col("_host").alias("_at"), F.col("_hash").alias("_known"))
    )
    return (
        lines.join(
            frequent,
            (F.col("_hash") == F.col("_known")) & F.col("_host").eqNullSafe(F.col("_at")),
        )
        .select("_key", "_row", "_pos", "_chars")
        .distinct()
        .groupBy("_key", "_row")
        .agg(
            F.sort_array(F.collect_list("_pos")).alias("_gone"),
            F.sum("_chars").alias("_gone_chars"),
        )
    )


def judged(
    documents: DataFrame,
    *,
    text: str = "text",
    host: str = "source",
    key: str = "doc_id",
    carry: list[str] | None = None,
    max_removed: float = MAX_REMOVED,
    **limits,
) -> DataFrame:
    """Each row of ``documents`` as struct ``_doc`` with its verdict.

    ``carry`` names the columns that ``_doc`` holds (all, if not given). Adds ``_m`` (see
    :func:`measures`), ``_gone`` (boilerplate lines, null if none), ``_gone_chars``, ``_kept``.
    """
    found = boilerplate(documents, text=text, host=host, key=key, **limits).select(
        F.col("_key").alias("_k2"), F.col("_row").alias("_r2"), "_gone", "_gone_chars"
    )
    rows = documents.select(
        F.struct(*(carry or ["*"])).alias("_doc"),
        F.col(key).alias("_key"),
        row_key(key, host, text).alias("_row"),
        text_of(text).alias("_given"),
    )
    rows = measures(rows, F.col("_given")).drop("_given")
    out = rows.join(
        found, (F.col("_row") == F.col("_r2")) & F.col("_key").eqNullSafe(F.col("_k2")), "left"
    )
    gone = F.coalesce("_gone_chars", F.lit(0))
    depleted = gone > F.col("_m.word_chars") * F.lit(max_removed)
    # one sum over both sides of the join: a filter on a plain conjunction would be pushed into
    # the measures, and their inner steps computed anew for each word
    faults = F.col("_m.base_failed").cast("int") + depleted.cast("int")
    return out.select(
        "_doc",
        "_m",
        "_gone",
        gone.alias("_gone_chars"),
        (faults == 0).alias("_kept"),
    )


def cleaned(
    documents: DataFrame, *, text: str = "text", chars: str = "n_chars", **options
) -> DataFrame:
    """The documents that stay, without their boilerplate lines; same columns as given.

    In changed rows a column named ``chars`` is set to the new length.
    """
    rows = judged(documents, text=text, **options).filter("_kept")
    return without_lines(rows, documents.schema, text, chars)
