"""Packing of documents into sequences of at most ``size`` tokens.

A document's ids (with the end id) are cut into pieces of ``size`` and a rest. The pieces'
lengths are counted, and the histogram is packed shortest-pack-first: lengths are placed longest
first, each into the emptiest packs that have room, and what is kept is how many sequences there
are of each pattern of lengths. Then pieces and patterns meet by rank: the n-th piece of a
length takes the n-th place for that length.

The histogram has ``size`` rows at most and the patterns are bounded by it, so both pass through
the driver whatever the number of documents. Ranks come from numbers within hashed slices of
each length plus the sizes of the slices before, so that one length of a third of all pieces is
spread over tasks.

Defined cases: null and empty texts are the end id alone; a null document id is an id like
others; repeated rows are packed each; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import kept_encoder

SIZE = 1024
#: Pieces numbered in one task, about.
SLICE_ROWS = 100_000

Pattern = tuple[int, ...]


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, Pattern]]:
    """(number of sequences, lengths in a sequence) for counts by length."""
    by_fill: dict[int, list[tuple[int, Pattern]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            fill = min((f for f, packs in by_fill.items() if packs and f + length <= size), default=None)
            if fill is None:
                # new packs; one by one they would take as many of this length as they can
                most = size // length
                for times, count in ((most, left // most), (left % most, 1)):
                    if times and count:
                        by_fill[times * length].append((count, (length,) * times))
                break
            count, pattern = by_fill[fill].pop()
            used = min(count, left)
            by_fill[fill + length].append((used, (*pattern, length)))
            if count > used:
                by_fill[fill].append((count - used, pattern))
            left -= used
    return [pack for fill in sorted(by_fill, reverse=True) for pack in by_fill[fill]]


def places(patterns: list[tuple[int, Pattern]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), ascending by rank."""
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    base = 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            rows[length].append((ranks[length], base, offset))
            ranks[length] += count
            offset += length
        base += count
    return {length: np.array(x, np.int64) for length, x in rows.items()}


def _cut(tokenizer: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc, same, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encoder.ids(text).astype("<u4")
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    out.append((doc, same, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "same", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def pieces(
    documents: DataFrame, tokenizer: str, *, text: str, key: str, size: int
) -> DataFrame:
    rows = documents.select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), F.col(text)
    )
    return rows.mapInArrow(
        _cut(tokenizer, size),
        "doc_id long, same long, start long, length long, ids_crc32 long, doc_tokens long",
    )


def _placed(by_length: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for value in np.unique(length):
                own = length == value
                table = by_length[int(value)]
                at = np.searchsorted(table[:, 0], rank[own], side="right") - 1
                sequence[own] = table[at, 1] + rank[own] - table[at, 0]
                offset[own] = table[at, 2]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    return run


def packed(
    documents: DataFrame,
    tokenizer: str,
    *,
    text: str = "text",
    key: str = "doc_id",
    size: int = SIZE,
) -> DataFrame:
    """Every piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and its place,
    ``sequence_id`` and ``offset``."""
    cut = written(pieces(documents, tokenizer, text=text, key=key, size=size), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    by_length = places(shortest_pack_first(histogram, size))

    slices = 1 << (sum(histogram.values()) // SLICE_ROWS).bit_length()
    order = ("doc_id", "same", "start")
    cut = cut.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    sizes = cut.groupBy("length", "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = sizes.select(
        F.col("length").alias("l"),
        F.col("slice").alias("s"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
    )
    number = F.row_number().over(Window.partitionBy("length", "slice").orderBy(*order)) - 1
    ranked = (
        cut.withColumn("number", number)
        .join(before, (F.col("length") == F.col("l")) & (F.col("slice") == F.col("s")))
        .select(
            "doc_id",
            "start",
            "length",
            "ids_crc32",
            "doc_tokens",
            (F.col("before") + F.col("number")).cast("long").alias("rank"),
        )
    )
    return ranked.mapInArrow(
        _placed(by_length),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long",
    )
