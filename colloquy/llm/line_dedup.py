"""Near-duplicate lines across documents, by an exact set-similarity join.

A line is the set of its lower-cased (A-Z) words. A line is removed if an earlier line, in the
order of (document id, line number), is similar to it: intersection over union at or above the
threshold. Only DataFrame functions are used.

1. Words are ordered by rarity: counts over all documents, in a table of fixed size.
2. Lines with equal sets form one class; all but its first line are later matches. Sets so
   small that they match only when equal take no part in the steps below.
3. Each class puts the rarest words of its set, its prefix, in an index. Two sets can only be
   similar if they share a prefix word (of the smaller set the first
   ``n - ceil(2t/(1+t) n) + 1`` do, of the larger one ``n - ceil(t n) + 1``), their sizes are
   close, the places of that word leave room for the overlap, and bit patterns of the sets
   differ in no more bits than the sets may differ in words. What passes is verified.
4. A class needs one earlier match only, so the index is searched in rounds: each class that
   isn't settled is held against the next few earliest classes of its words' lists, matches are
   verified and settle it, and the next round takes the following ones, ``GROWTH`` times as
   many, until no such class has earlier ones left. Nothing is passed over, and a large group of
   near copies, which the first rounds settle, doesn't emit its pairs.
5. Words are dealt into ``PARTS`` parts. The index is sorted and searched part by part, so that
   the disk holds one part's shuffle at a time; a round's pairs are verified together.

Defined cases: null texts have no lines; lines of fewer than ``min_words`` different words are
left alone and match nothing; a null id comes first; repeated rows (same id and text) are one
document; rows of one id with different texts are ordered by line number; an empty table gives
an empty result; further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import deleted, likely_in, lower_az, row_key, text_of, without_lines, words_of, written

#: Least Jaccard similarity in per cent, and fewest different words of a line.
PERCENT = 80
MIN_WORDS = 1
#: Earlier classes of a word's list that the first round takes, and by what later rounds take more.
FIRST, GROWTH = 4, 8
#: Parts of the index, and the fewest of its entries that are dealt into so many.
PARTS, FEWEST_ENTRIES = 4, 500_000
#: Entries of the table of word counts. Words that meet in an entry have one rarity; the order
#: stays one and the same for all lines, so results don't depend on this.
RARITY_BUCKETS = 1 << 20
#: Sets of so many words have a second bit pattern, of so many longs: with more words than that,
#: 64 bits fill up and tell few sets apart.
LONG_SET, WIDE = 64, 4
#: Low bits of a word's token, which identify it; the bits above hold its rarity.
_HASH_BITS = 57


def _rarities(texts: DataFrame) -> Column:
    """An array literal: for each bucket of words a rarity class from 0 (rare) to 63."""
    spark = texts.sparkSession
    counts = (
        texts.select(F.explode(words_of(F.col("_t"))).alias("w"))
        .select(F.pmod(F.xxhash64("w"), F.lit(RARITY_BUCKETS)).alias("b"))
        .groupBy("b")
        .agg(F.count("*").alias("c"))
    )
    level = F.least(F.lit(63), F.floor(4 * F.log2(F.coalesce("c", F.lit(0)) + 1))).cast("int")
    every = spark.range(RARITY_BUCKETS).withColumnRenamed("id", "b").join(counts, "b", "left")
    return (
        every.select(F.struct(F.col("b").cast("int").alias("b"), level.alias("l")).alias("x"))
        .agg(F.sort_array(F.collect_list("x")).alias("m"))
        .select("m.l")
        .scalar()
    )


def _least_overlap(na: str, nb: str, percent: int) -> Column:
    """Words that sets of these sizes have in common if they are similar."""
    return F.expr(f"({percent} * ({na} + {nb}) + {99 + percent}) DIV {100 + percent}")


def _with_sets(lines: DataFrame, rarities: Column) -> DataFrame:
    """Adds ``set``: the distinct words of ``line`` as longs, the rarest first."""
    mask = (1 << _HASH_BITS) - 1

    def token(w: Column) -> Column:
        h = F.xxhash64(w)
        rarity = F.get("_m", F.pmod(h, F.lit(RARITY_BUCKETS)).cast("int")).cast("long")
        return F.shiftleft(rarity, _HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit(mask)))

    columns = lines.columns
    words = F.transform(words_of(F.col("line")), token)
    lines = lines.withColumn("_m", rarities).select(*columns, words.alias("_words"))
    return lines.select(*columns, F.sort_array(F.array_distinct("_words")).alias("set"))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("key", "row", F.posexplode(F.split("_t", "\n")).alias("pos", "line"))


def _may_match(a: str, b: str, percent: int) -> Column:
    """Filters for two classes, given as structs ``a`` and ``b``, that share a word."""
    na, nb = f"{a}.n", f"{b}.n"
    need = _least_overlap(na, nb, percent)
    # whether the word is in the shorter prefix, and the words the two may share from there on
    short = [
        F.col(f"{s}.i") <= F.col(f"{s}.n") - _least_overlap(f"{s}.n", f"{s}.n", percent) for s in (a, b)
    ]
    room = F.least(F.col(na) - F.col(f"{a}.i"), F.col(nb) - F.col(f"{b}.i"))
    differ = F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits")))
    return (
        (F.col(f"{a}.c") != F.col(f"{b}.c"))  # two words of a set may have one short form
        & (percent * F.greatest(na, nb) <= 100 * F.least(na, nb))
        & (differ <= F.col(na) + F.col(nb) - 2 * need)
        & F.when(F.col(na) <= F.col(nb), short[0]).otherwise(short[1])
        & (room >= need)
    )


def _wide(of: str) -> Column:
    """The second bit pattern of a set, for long ones."""
    longs = [
        F.expr(
            f"aggregate({of}, 0L, (s, x) -> "
            f"if((x >> 6) & {WIDE - 1}L = {k}L, s ^ shiftleft(1L, int((x >> 8) & 63L)), s))"
        )
        for k in range(WIDE)
    ]
    return F.when(F.size(of) >= LONG_SET, F.array(*longs))


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(c1, c2)`` without those of long sets whose second patterns differ in more bits
    than the sets may differ in words."""
    long = classes.filter(F.col("wide").isNotNull()).select("c", "n", "wide")
    for s in "12":
        own = long.select(F.col("c").alias(f"c{s}"), F.col("n").alias(f"n{s}"), F.col("wide").alias(f"w{s}"))
        pairs = pairs.join(own.hint("merge"), f"c{s}", "left")
    bits = F.zip_with("w1", "w2", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(bits, F.lit(0), lambda n, v: n + v)
    may = differ <= F.col("n1") + F.col("n2") - 2 * _least_overlap("n1", "n2", percent)
    return pairs.filter(F.coalesce(may, F.lit(True))).select("c1", "c2")


def _whole_sets(classes: DataFrame, docs: DataFrame, rarities: Column) -> DataFrame:
    """``(c, set)`` of the classes ``(c, row, pos)``: their lines are read again, those alone."""
    places = classes.select("c", "row", "pos", F.xxhash64("row", "pos").alias("at"))
    lines = _lines(docs.filter(likely_in(places, "row", F.col("row"))))
    at = F.xxhash64("row", "pos")
    lines = lines.filter(likely_in(places, "at", at)).join(places.drop("at"), ["row", "pos"])
    return _with_sets(lines.dropDuplicates(["c"]), rarities).select("c", "set")


def _verified(
    pairs: DataFrame, classes: DataFrame, docs: DataFrame, rarities: Column, percent: int
) -> DataFrame:
    """``c`` of the pairs' later classes ``c2`` that are similar to their ``c1``. Only the lines of
    the pairs' classes are read again."""
    near = pairs = written(_close(pairs, classes, percent), "pairs")
    wanted = pairs.select(F.explode(F.array("c1", "c2")).alias("c")).distinct()
    places = written(classes.join(wanted, "c", "left_semi").select("c", "row", "pos"), "places")
    sets = written(_whole_sets(places, docs, rarities), "sets")
    for s in "12":
        pairs = pairs.join(sets.select(F.col("c").alias(f"c{s}"), F.col("set").alias(f"s{s}")), f"c{s}")
    similar = (
        pairs.select(
            F.col("c2").alias("c"),
            F.size(F.array_intersect("s1", "s2")).alias("both"),
            (F.size("s1") + F.size("s2")).alias("sum"),
        )
        .filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both")))
        .select("c")
        .distinct()
    )
    similar = written(similar, "similar")
    deleted(near, places, sets)
    return similar


def _index(entries: DataFrame, percent: int) -> DataFrame:
    """For each word ``t`` the classes whose prefix has it, as structs ``of`` (c, n, bits, and the
    place i of the word), ranked from 1 by their order. ``first`` lists, of the first ``FIRST``
    classes of the word, earlier ones that may match: the first round's pairs, without a join.
    """
    order = Window.partitionBy("t").orderBy("key", "pos", "c", "i")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.struct("c", "n", "bits", "i")
    rows = entries.select(
        "t",
        own.alias("of"),
        F.row_number().over(order).alias("rank"),
        F.lead("c").over(order).alias("_next"),
        *[F.nth_value(own, k).over(so_far).alias(f"_h{k}") for k in range(1, FIRST + 1)],
    ).filter((F.col("rank") > 1) | F.col("_next").isNotNull())
    found = [
        F.when((F.col("rank") > k) & _may_match(f"_h{k}", "of", percent), F.col(f"_h{k}.c"))
        for k in range(1, FIRST + 1)
    ]
    return rows.select("t", "of", "rank", F.array_compact(F.array(*found)).alias("first"))


def _in_parts(entries: DataFrame, classes: DataFrame, percent: int) -> list[DataFrame]:
    """The index of the entries, one table for each part of the words."""
    total = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    n = PARTS if total >= FEWEST_ENTRIES else 1
    parts = [entries.filter(F.pmod("t", F.lit(n)) == k) for k in range(n)]
    return [written(_index(part, percent), "index") for part in parts]


def _round(index: DataFrame, settled: DataFrame, done: int, width: int, percent: int) -> DataFrame:
    """Pairs ``(c1, c2)`` that may match of a class that isn't settled and one of the ``width``
    classes behind the first ``done`` of a word's list."""
    still = index.filter(F.col("rank") > done + 1).select(
        F.col("of.c").alias("c"), "t", F.col("rank").alias("rank2"), F.col("of").alias("b")
    )
    still = still.join(settled, "c", "left_anti").drop("c")
    earlier = index.filter(F.col("rank").between(done + 1, done + width)).select(
        "t", F.col("rank").alias("rank1"), F.col("of").alias("a")
    )
    return (
        earlier.join(still, "t")
        .filter((F.col("rank1") < F.col("rank2")) & _may_match("a", "b", percent))
        .select(F.col("a.c").alias("c1"), F.col("b.c").alias("c2"))
        .distinct()
    )


def _together(tables: list[DataFrame]) -> DataFrame:
    """The distinct pairs of all parts as one table; the parts' own go."""
    if len(tables) == 1:
        return tables[0]
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    whole = written(whole.distinct(), "pairs")
    deleted(*tables)
    return whole


def _settled(parts: list[DataFrame], percent: int, verified) -> DataFrame:
    """The classes of the index that an earlier one is similar to, as ``verified`` finds out for
    pairs ``(c1, c2)`` of an earlier and a later class. The index goes."""
    pairs = [
        written(x.select(F.explode("first").alias("c1"), F.col("of.c").alias("c2")).distinct(), "pairs")
        for x in parts
    ]
    pairs = _together(pairs)
    settled = verified(pairs)
    deleted(pairs)
    done, width = FIRST, FIRST * GROWTH
    longest = [x.agg(F.max("rank")).first()[0] or 0 for x in parts]
    while done + 1 < max(longest):
        left = [x for x, most in zip(parts, longest, strict=True) if done + 1 < most]
        pairs = _together([written(_round(x, settled, done, width, percent), "pairs") for x in left])
        if not pairs.isEmpty():
            similar = verified(pairs)
            before, settled = settled, written(settled.unionByName(similar), "settled")
            deleted(before, similar)
        deleted(pairs)
        done, width = done + width, width * GROWTH
    deleted(*parts)
    return settled


def later_matches(documents: DataFrame, **options) -> DataFrame:
    """Each line of ``min_words`` different words or more: ``key``, ``row`` (a hash of the
    document's id and text), ``pos`` (0-based line number), ``chars`` and ``removed``."""
    return _matches(documents, **options)[0]


def _matches(
    documents: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
) -> tuple[DataFrame, list[DataFrame]]:
    """The lines as ``later_matches`` gives them, and the written tables that they are read from."""
    docs = documents.select(
        F.col(key).alias("key"),
        row_key(key, text).alias("row"),
        lower_az(text_of(text)).alias("_t"),
    )
    rarities = _rarities(docs)
    once = written(docs.sparkSession.range(1).select(rarities.alias("m")), "rarities")
    rarities = once.select("m").scalar()
    lines = _with_sets(_lines(docs), rarities).withColumn("chars", F.length("line"))
    keep = F.expr(f"size(set) - ({percent} * size(set) + 99) DIV 100 + 1")
    lines = written(
        lines.filter(F.size("set") >= min_words).select(
            "key",
            "row",
            "pos",
            "chars",
            F.xxhash64("set").alias("c"),
            F.size("set").alias("n"),
            F.expr("aggregate(set, 0L, (s, x) -> s ^ shiftleft(1L, int(x & 63L)))").alias("bits"),
            _wide("set").alias("wide"),
            F.transform(
                F.slice("set", F.lit(1), keep), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
            ).alias("prefix"),
        ),
        "lines",
    )
    classes = written(
        lines.groupBy("c")
        .agg(
            F.min(F.struct("key", "pos", "row")).alias("at"),
            F.first(F.struct("n", "bits", "wide", "prefix")).alias("of"),
        )
        .select("c", "at.*", "of.*"),
        "classes",
    )
    # smaller sets are similar only if equal (of n words, at best n of n + 1 are shared), and
    # equal ones are one class already
    joined = classes.filter(100 * F.col("n") >= percent * (F.col("n") + 1))

    entries = joined.select("c", "key", "pos", "n", "bits", F.posexplode("prefix").alias("i", "t"))
    index = _in_parts(entries, joined, percent)
    near = _settled(index, percent, lambda pairs: _verified(pairs, classes, docs, rarities, percent))
    first = classes.select("c", F.struct("key", "pos", "row").alias("at")).join(
        near.withColumn("near", F.lit(True)), "c", "left"
    )
    found = lines.join(first, "c").select(
        "key",
        "row",
        "pos",
        "chars",
        (
            F.col("near").isNotNull() | ~F.struct("key", "pos", "row").eqNullSafe(F.col("at"))
        ).alias("removed"),
    )
    return found, [once, lines, classes, near]


def deduplicated(
    documents: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    chars: str = "n_chars",
    most_removed: float = 1.0,
    **options,
) -> DataFrame:
    """The documents without their removed lines, same columns; those left wordless go.

    So do those that lose more than ``most_removed`` of their characters, line ends not counted:
    of a near copy of an earlier document little is left but the places where it was changed.
    """
    matches, tables = _matches(documents, text=text, key=key, **options)
    found = (
        matches.filter("removed")
        .select("key", "row", "pos", "chars")
        .distinct()
        .groupBy("key", "row")
        .agg(F.sort_array(F.collect_list("pos")).alias("_gone"), F.sum("chars").alias("_lost"))
        .select(F.col("key").alias("_k"), F.col("row").alias("_r"), "_gone", "_lost")
    )
    # all that is left of the lines, so that their tables needn't outlive this stage
    found = written(found, "gone")
    deleted(*tables)
    rows = documents.select(
        F.struct("*").alias("_doc"), F.col(key).alias("_key"), row_key(key, text).alias("_row")
    ).join(found, (F.col("_row") == F.col("_r")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
    whole = F.length(F.translate(text_of(f"_doc.{text}"), "\n", ""))
    rows = rows.filter(F.coalesce(F.col("_lost") <= F.lit(most_removed) * whole, F.lit(True)))
    out = without_lines(rows, documents.schema, text, chars)
    # behind a generator, so that the filter isn't pushed into the making of the texts
    out = out.select(F.explode(F.array_repeat(F.struct("*"), 1)).alias("_doc"))
    wordless = F.translate(text_of(f"_doc.{text}"), " \t\n\x0b\x0c\r", "") == ""
    return out.filter(~wordless).select("_doc.*")
