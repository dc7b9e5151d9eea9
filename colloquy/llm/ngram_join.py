"""Exact n-gram Jaccard join of documents, filtered under several global orders.

A document is its set of word shingles, each as a 64-bit hash. Documents with equal sets form
one class, and only classes are joined. For a pair at or above the threshold,

* the first ``|set| - need + k`` shingles of both under one global order (the hash) have at
  least ``k`` in common, where ``need`` is the overlap the set's size asks for;
* so, among those, the ``size - k + 1`` rarest by their exact counts have one in common: the
  index holds these. A shingle that only one class has needs no entry, and a passage that very
  many documents share is passed over for rarer ones;
* the prefixes under two more orders (other mixes of the hash) have one in common too: both
  filters must agree before two sets are compared;
* parity sketches (a bit for each bucket of hashes, set where the set has an odd number there)
  differ in no more bits than the two sets may differ in shingles.

Lists of the index longer than ``LONG_LIST`` are those of large groups of near copies. There
every class is first held against ``HUBS`` classes of the list; the links found give components,
and then only pairs of different components are tested. No link between components is lost,
and a group of linked classes doesn't emit all its pairs. Entries of long lists carry a short
parity sketch, so that pairs too far apart aren't made at all.

Defined cases: null or wordless texts have empty sets and link with nothing; a row with a
null id links with nothing and has a null component; rows of one id are one document;
repeated rows each get their row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import deleted, likely_in, lower_words, written
from .components import components

#: Words in a shingle, and least Jaccard similarity in per cent.
WIDTH = 5
PERCENT = 80
#: Shingles that two similar documents share among the first ones, from which the rarest count.
SHARED = 16
#: Longer lists are joined by component, not pair by pair.
LONG_LIST = 16
#: Classes of a long list that all others are held against first.
HUBS = 8
#: Longs of the short parity sketch, and of the one for pairs that it can't tell apart: it is
#: full for sets of some hundred shingles, the other one for sets of some thousand.
SHORT_SKETCH, MEDIUM_SKETCH = 8, 64
#: Word hashes a worker remembers; then it begins anew. No effect on results.
REMEMBERED = 400_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = {2: np.uint64(0x2545F4914F6CDD1D), 3: np.uint64(0xD1342543DE82EF95)}


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; shorter texts are one shingle."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h[:width]), np.uint64)
    for i in range(min(width, len(h))):
        out = _mixed(out * _STEP + h[i : i + n])
    return np.unique(out.view(np.int64))


def needed(n, percent: int):
    """Fewest shingles that a set of n has in common with any set similar to it."""
    return (percent * n + 99) // 100


def _order(found: np.ndarray, seed: int, size: int) -> np.ndarray:
    """The first ``size`` values of the set under the order of that number."""
    other = _mixed(found.view(np.uint64) + _SEEDS[seed]).view(np.int64)
    return np.sort(np.partition(other, size - 1)[:size] if size < len(other) else other)


def _odd(found: np.ndarray, longs: int | None = None) -> np.ndarray:
    """The parity sketch of a set: of so many longs, or of at least four bits a shingle (sizes
    are powers of two)."""
    bits = 64 * longs if longs else max(64, 1 << (4 * len(found) - 1).bit_length())
    at = (_mixed(found.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _folded(sketch: np.ndarray) -> np.ndarray:
    """The sketch of half the size."""
    half = len(sketch) // 2
    return sketch[:half] ^ sketch[half:] if half else sketch


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int64)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, pa.int64()))


def _batches(batches: Iterator[pa.RecordBatch], width: int):
    hashes = _WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(t, width, hashes) for t in part.column(1).to_pylist()]
            yield part.column(0), sets


def _heads(width: int, percent: int):
    """Id, set size, signature, and the first shingles under the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _batches(batches, width):
            firsts, marks = [], []
            for s in sets:
                need = needed(len(s), percent)
                firsts.append(s[: len(s) - need + min(SHARED, need)])
                u = s.view(np.uint64)
                marks.append((int(u.sum(dtype=np.uint64).view(np.int64)),
                              int(_mixed(u).sum(dtype=np.uint64).view(np.int64))))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([m[0] for m in marks], pa.int64()),
                    pa.array([m[1] for m in marks], pa.int64()),
                    _lists(firsts),
                    _lists([_odd(s, SHORT_SKETCH) for s in sets]),
                ],
                names=["id", "n", "s1", "s2", "firsts", "sketch"],
            )

    return run


def _sketches(width: int, percent: int):
    """Id, set size, prefixes under the second and third order, and parity sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _batches(batches, width):
            sizes = [len(s) - needed(len(s), percent) + 1 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(s) for s in sets], pa.int64()),
                    _lists([_order(s, 2, p) for s, p in zip(sets, sizes, strict=True)]),
                    _lists([_order(s, 3, p) for s, p in zip(sets, sizes, strict=True)]),
                    _lists(odd := [_odd(s) for s in sets]),
                    _lists([_folded(x) for x in odd]),
                    _lists([_odd(s, SHORT_SKETCH) for s in sets]),
                    _lists([_odd(s, MEDIUM_SKETCH) for s in sets]),
                ],
                names=["id", "n", "p2", "p3", "odd", "folded", "short", "medium"],
            )

    return run


def _wholes(width: int):
    """Id, set size and the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _batches(batches, width):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), _lists(sets)],
                names=["id", "n", "set"],
            )

    return run


def _read_again(pairs: DataFrame, docs: DataFrame, run, columns: str) -> DataFrame:
    """What ``run`` makes of the documents of the pairs, written."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    rows = docs.filter(likely_in(ids, "id", F.col("id"))).join(ids, "id", "left_semi")
    found = written(rows.mapInArrow(run, f"id long, n long, {columns}"), "sets")
    deleted(ids)
    return found


def _with_both(pairs: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """The pairs with these columns of ``a`` and of ``b``.

    Pairs grow with the input, so they are merged by a shuffle at every size.
    """
    out = pairs.select("a", "b")
    for s in "ab":
        own = [F.col(c).alias(f"{c}_{s}") for c in ("n", *columns)]
        out = out.hint("merge").join(found.select(F.col("id").alias(s), *own), s)
    return out


def _differing(a: str, b: str) -> Column:
    """Bits in which two short sketches differ."""
    return sum(
        F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SHORT_SKETCH)
    )


def similar(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the candidate pairs ``(a, b)`` that reach the threshold, written.

    Filters see short columns of the pairs' documents; whole sets are made only for the
    documents of pairs that pass them.
    """
    sketches = _read_again(
        pairs,
        docs,
        _sketches(width, percent),
        "p2 array<long>, p3 array<long>, odd array<long>, folded array<long>, short array<long>, medium array<long>",
    )
    sizes = F.col("n_a") + F.col("n_b")
    differ = _differing("short_a", "short_b")
    pairs = _with_both(pairs, sketches, "short").filter(
        (100 + percent) * differ <= (100 - percent) * sizes
    )
    pairs = written(pairs.select("a", "b"), "pairs")
    used = [sketches, pairs]
    x, y = [
        F.when(F.size(f"odd_{s}") > F.size(f"odd_{o}"), F.col(f"folded_{s}")).otherwise(
            F.col(f"odd_{s}")
        )
        for s, o in ("ab", "ba")
    ]

    def apart(x: Column, y: Column) -> Column:
        bits = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        return F.aggregate(bits, F.lit(0), lambda n, v: n + v)

    # whole sketches of long sets are long, so few pairs should carry them
    for columns, differ in (
        (["medium"], apart(F.col("medium_a"), F.col("medium_b"))),
        (["odd", "folded"], apart(x, y)),
    ):
        passed = _with_both(pairs, sketches, *columns).filter(
            (100 + percent) * differ <= (100 - percent) * sizes
        )
        pairs = written(passed.select("a", "b"), "pairs")
        used.append(pairs)
    passed = _with_both(pairs, sketches, "p2", "p3").filter(
        F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")
    )
    passed = written(passed.select("a", "b"), "pairs")
    deleted(*used)
    sets = _read_again(passed, docs, _wholes(width), "set array<long>")
    common = F.size(F.array_intersect("set_a", "set_b")).alias("c")
    found = (
        _with_both(passed, sets, "set")
        .select("a", "b", common, (F.col("n_a") + F.col("n_b")).alias("both"))
        .filter(100 * F.col("c") >= percent * (F.col("both") - F.col("c")))
        .select("a", "b")
    )
    found = written(found, "found")
    deleted(passed, sets)
    return found


def groups(
    documents: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    width: int = WIDTH,
    percent: int = PERCENT,
) -> DataFrame:
    """``(id, n_shingles, component)`` for each row of the documents."""
    return _groups(documents, text=text, key=key, width=width, percent=percent)[0]


def _groups(
    documents: DataFrame, *, text: str, key: str, width: int = WIDTH, percent: int = PERCENT
) -> tuple[DataFrame, list[DataFrame]]:
    """The rows as ``groups`` gives them, and the written tables that they are read from."""
    docs = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    heads = written(
        docs.mapInArrow(
            _heads(width, percent),
            "id long, n long, s1 long, s2 long, firsts array<long>, sketch array<long>",
        ),
        "heads",
    )
    linked = F.col("id").isNotNull() & (F.col("n") > 0)
    classes = (
        heads.filter(linked)
        .groupBy("n", "s1", "s2")
        .agg(F.min("id").alias("node"), F.first("firsts").alias("firsts"))
    )
    entries = classes.select(
        "node", "n", F.size("firsts").alias("size"), F.explode("firsts").alias("t")
    )
    counts = entries.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1")
    need = F.expr(f"({percent} * n + 99) DIV 100")
    inner = Window.partitionBy("node", "n", "size")
    index = (
        entries.join(counts, "t")
        .withColumn("rank", F.row_number().over(inner.orderBy("df", "t")))
        .withColumn("single", F.col("size") - F.count("*").over(inner))
        .filter(
            F.col("single") + F.col("rank") <= F.col("size") - F.least(F.lit(SHARED), need) + 1
        )
        .select("t", "node", "n")
    )
    index = written(index, "index")
    lists = index.groupBy("t").agg(
        F.count("*").alias("length"), F.min(F.struct("node", "n")).alias("hub")
    )
    entries, index = index, written(index.join(lists.filter("length > 1"), "t"), "index")
    deleted(entries)
    short = index.filter(F.col("length") <= LONG_LIST)
    left, right = [
        short.select("t", F.col("node").alias(s), F.col("n").alias(f"n{s}")) for s in "ab"
    ]
    fits = percent * F.greatest("na", "nb") <= 100 * F.least("na", "nb")
    within = left.join(right, "t").filter((F.col("a") < F.col("b")) & fits).select("a", "b")

    # long lists: every class against the hubs
    sketches = heads.filter(linked).groupBy("n", "s1", "s2").agg(
        F.min("id").alias("node"), F.first("sketch").alias("sketch")
    )
    long = index.filter(F.col("length") > LONG_LIST).select("t", "node", "n")
    long = long_lists = written(long.join(sketches.select("node", "sketch"), "node"), "index")
    close = fits & (
        (100 + percent) * _differing("ska", "skb")
        <= (100 - percent) * (F.col("na") + F.col("nb"))
    )
    pair = (F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def side(rows: DataFrame, node: str, s: str, *more: str) -> DataFrame:
        renamed = (F.col(c).alias(to) for c, to in (("node", node), ("n", f"n{s}"), ("sketch", f"sk{s}")))
        return rows.select("t", *renamed, *more)

    # hubs are picked by hashes of their ids alone; their sketches are looked up behind that
    hubs = long.groupBy("t").agg(
        F.array(
            *[
                F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node"))
                for i in range(HUBS)
            ]
        ).alias("hubs")
    )
    hubs = hubs.select(
        "t", F.explode(F.array_distinct(F.transform("hubs", lambda h: h["node"]))).alias("node")
    )
    around = (
        side(long, "x", "a")
        .join(side(long.join(hubs, ["t", "node"], "left_semi"), "y", "b"), "t")
        .filter((F.col("x") != F.col("y")) & close)
        .select(*pair)
    )
    pairs = written(within.unionByName(around).distinct(), "pairs")
    deleted(index)
    links = similar(pairs, docs, width, percent)
    found = components(links)
    deleted(links)

    # in long lists, pairs of different components are left
    long = long.join(found, "node", "left").withColumn("part", F.coalesce("component", "node"))
    parts = long.groupBy("t", "part").agg(F.count("*").alias("size"))
    main = parts.groupBy("t").agg(
        F.max_by("part", F.struct("size", "part")).alias("main"), F.count("*").alias("parts")
    )
    long = long.join(main.filter("parts > 1"), "t")
    minor = side(long.filter(F.col("part") != F.col("main")), "x", "a", F.col("part").alias("px"))
    across = written(
        minor.join(side(long, "y", "b", F.col("part").alias("py")), "t")
        .filter((F.col("px") != F.col("py")) & close)
        .select(*pair)
        .distinct()
        .join(pairs, ["a", "b"], "left_anti"),
        "pairs",
    )
    deleted(long_lists, pairs)
    if not across.isEmpty():
        more = similar(across, docs, width, percent)
        found = components(
            found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        )

    # a document's component is that of its class
    smallest = heads.filter(linked).groupBy("n", "s1", "s2").agg(F.min("id").alias("node"))
    of_class = smallest.join(found, "node", "left").select(
        "n", "s1", "s2", F.coalesce("component", "node").alias("component")
    )
    rows = heads.join(of_class, ["n", "s1", "s2"], "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.when(linked, F.col("component")).otherwise(F.col("id")).alias("component"),
    )
    return rows, [heads, found]


def one_of_each(
    documents: DataFrame, *, text: str = "text", key: str = "doc_id", **options
) -> DataFrame:
    """The document with the smallest id of each group, and those without an id."""
    found, tables = _groups(documents, text=text, key=key, **options)
    kept = found.filter(F.col("id") == F.col("component")).select(F.col("id").alias("_id"))
    # all that is left of the groups, so that their tables needn't outlive this stage
    kept = written(kept.distinct(), "kept")
    deleted(*tables)
    rows = documents.select(F.struct("*").alias("_doc"), F.col(key).cast("long").alias("_id"))
    named = rows.join(kept, "_id", "left_semi").dropDuplicates(["_id"])
    return named.unionByName(rows.filter(F.col("_id").isNull())).select("_doc.*")
