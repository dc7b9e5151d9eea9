"""Simple-8b word-aligned coding of token ids, and tables of coded documents.

A 64-bit word holds a selector in its top four bits and, below, as many ids of one width as fit;
the first id is lowest. Ids come in blocks of ``BLOCK``; no word crosses a block's end, and the
offsets of the blocks' first words let all blocks be coded and decoded side by side. An id of
more than 60 bits is an escape: its word holds its place in a list behind the words.

A shard, little-endian: magic ``S8B1`` and block size (4 bytes each), numbers of ids, words and
escapes (8 each), the blocks' word offsets (8 each, and the end), the words, the escapes.

Shards lie in a Parquet table, one row each, written by Spark: ``part``, ``shard`` (order),
``ids``, ``doc_ids``, ``lengths`` (of the documents in order) and ``payload``. Each task streams,
so it holds one shard and one batch of texts at most, besides the longest document.

Defined cases: null and empty texts are the end id alone; null document ids come first; rows of
one id are ordered by their texts' hashes, and each is a document; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_folder
from .tokens import kept_encoder

BLOCK = 4096
SHARD_IDS = 1 << 20
MAGIC = b"S8B1"
_HEAD = struct.Struct("<4sIQQQ")

#: Fixed values of the coding: (ids, bits each) by selector. Selector 0 is the escape.
SELECTORS = (
    (1, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
_COUNTS = np.array([c for c, _ in SELECTORS], np.int64)


#: Bits of every number of up to 16 bits.
_SMALL = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    if not ids.size or ids.max() < len(_SMALL):
        return _SMALL[ids.astype(np.uint16)]
    high = (ids >> np.uint64(32)).astype(np.uint32)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low).astype(np.uint8)


def _choices(widths: np.ndarray) -> np.ndarray:
    """For each place the selector that packs most ids from there on. ``widths`` is a table of
    blocks, with zeros behind each block's end."""
    n = widths.shape[1] - 128
    chosen = np.zeros(widths.shape, np.uint8)
    widest, size = widths, 1
    for k in range(len(SELECTORS) - 1, 0, -1):
        count, bits = SELECTORS[k]
        while size < count:
            step = min(size, count - size)
            grown = widest.copy()
            np.maximum(widest[:, :-step], widest[:, step:], out=grown[:, :-step])
            widest, size = grown, size + step
        np.copyto(chosen, np.uint8(k), where=widest <= bits)
    return chosen[:, :n]


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The shard of some unsigned ids of up to 64 bits."""
    ids = np.ascontiguousarray(ids, np.uint64)
    blocks = -(-len(ids) // block)
    table = np.zeros((blocks, block + 128), np.uint64)
    table[:, :block].flat[: len(ids)] = ids
    ends = np.full(blocks, block)
    if blocks:
        ends[-1] = len(ids) - (blocks - 1) * block
    chosen = _choices(_widths(table)) if blocks else np.zeros((0, block), np.uint8)
    flat, base = chosen.ravel(), np.arange(blocks) * block
    at, steps = np.zeros(blocks, np.int64), []
    while (at < ends).any():
        steps.append(at)
        at = at + _COUNTS[flat[base + np.minimum(at, block - 1)]]
    # a row for each block: the places where its words begin
    starts = np.array(steps, np.int64).reshape(len(steps), blocks).T
    row, step = np.nonzero(starts < ends[:, None])
    start = starts[row, step]
    selector = flat[base[row] + start] if blocks else np.empty(0, np.uint8)
    first, values = row * (block + 128) + start, table.ravel()
    words = selector.astype(np.uint64) << np.uint64(60)
    for k in range(2, len(SELECTORS)):
        count, bits = SELECTORS[k]
        own = np.flatnonzero(selector == k)
        if len(own):
            word, place = words[own], first[own]
            for j in range(count):
                word |= values[place + j] << np.uint64(bits * j)
            words[own] = word
    escaped = np.flatnonzero(selector == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    offsets = np.searchsorted(row, np.arange(blocks + 1)).astype("<u8")
    head = _HEAD.pack(MAGIC, block, len(ids), len(words), len(escaped))
    escapes = values[first[escaped]]
    return b"".join(
        (head, offsets.tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes())
    )


def decode(payload: bytes) -> np.ndarray:
    """The ids of a shard."""
    magic, block, n, n_words, n_escapes = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a shard of coded ids")
    blocks = -(-n // block)
    offsets = np.frombuffer(payload, "<u8", blocks + 1, _HEAD.size).astype(np.int64)
    words = np.frombuffer(payload, "<u8", n_words, _HEAD.size + 8 * (blocks + 1))
    escapes = np.frombuffer(payload, "<u8", n_escapes, len(payload) - 8 * n_escapes)
    selector = (words >> np.uint64(60)).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(_COUNTS[selector])))
    of = np.repeat(np.arange(blocks), np.diff(offsets))
    start = before[:-1] - before[offsets[of]] + of * block
    end = np.minimum((of + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for k in range(2, len(SELECTORS)):
        count, bits = SELECTORS[k]
        own = np.flatnonzero(selector == k)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count if len(own) else 0):
            there = own[start[own] + j < end[own]] if j else own
            out[start[there] + j] = (words[there] >> np.uint64(bits * j)) & mask
    own = np.flatnonzero(selector == 0)
    out[start[own]] = escapes[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


_SHARDS = (
    "part long, shard long, ids long, doc_ids array<long>, lengths array<long>, payload binary"
)


def _write_shards(tokenizer: str, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = kept_encoder(tokenizer), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            row = {
                "part": part,
                "shard": shard,
                "ids": size,
                "doc_ids": docs,
                "lengths": [len(x) for x in ids],
                "payload": encode(np.concatenate(ids)),
            }
            kinds = {"doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64())}
            kinds |= {"payload": pa.binary()}
            return pa.RecordBatch.from_arrays(
                [pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()], names=[*row]
            )

        for batch in batches:
            for i in range(batch.num_rows):
                docs.append(batch.column(0)[i].as_py())
                ids.append(encoder.ids(batch.column(1)[i].as_py()))
                size += len(ids[-1])
                if size >= shard_ids:
                    yield flushed()
                    docs, ids, size, shard = [], [], 0, shard + 1
        if docs:
            yield flushed()

    return run


def write_ids(
    documents: DataFrame,
    path: str,
    tokenizer: str,
    *,
    text: str = "text",
    key: str = "doc_id",
    shard_ids: int = SHARD_IDS,
) -> None:
    """Writes the ids of all texts, each with the end id behind it, in ascending order of ids."""
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", tie)
    ordered.mapInArrow(_write_shards(tokenizer, shard_ids), _SHARDS).write.parquet(path)


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode(row["payload"]).astype("<u4")
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
            n = len(sums)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * n, pa.int64()),
                    pa.array([row["shard"]] * n, pa.int64()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_documents(spark, path: str) -> DataFrame:
    """Each document of a table of shards: ``doc_id``, ``start`` (ids of all before it),
    ``n_tokens`` and ``ids_crc32``.

    Offsets are summed in two steps, over the parts and over the shards of each part; both see
    a row for each shard at most.
    """
    table = spark.read.schema(_SHARDS).parquet(path)
    before = (Window.unboundedPreceding, -1)
    parts = table.groupBy("part").agg(F.sum("ids").alias("n"))
    parts = parts.select(
        "part",
        F.coalesce(
            F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)
        ).alias("base"),
    )
    shards = (
        table.select("part", "shard", "ids")
        .join(parts, "part")
        .select(
            "part",
            "shard",
            (
                F.col("base")
                + F.coalesce(
                    F.sum("ids").over(
                        Window.partitionBy("part").orderBy("shard").rowsBetween(*before)
                    ),
                    F.lit(0),
                )
            ).alias("base"),
        )
    )
    docs = table.mapInArrow(
        _read_shards,
        "part long, shard long, doc_id long, at long, n_tokens long, ids_crc32 long",
    )
    return docs.join(shards, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def coded(documents: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the documents' ids to a new table in the shared folder and reads them back."""
    spark = documents.sparkSession
    path = fresh_folder(spark, "ids")
    write_ids(documents, path, tokenizer, **options)
    return read_documents(spark, path)
