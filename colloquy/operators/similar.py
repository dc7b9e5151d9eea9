"""Near-duplicate vectors across channels: random hyperplanes, banded, checked exactly.

Equal vectors are one class with its members counted. Each class is signed by the sides of random
hyperplanes it lies on; ``bits`` sides make a band's key, and two classes are compared where they
share a band. The first sides also serve as a sketch of bounded size, which every band's entry
carries: pairs whose sketches differ by more than a threshold's worth aren't looked at further.
What is left is checked by its exact cosine.

``bits`` follows the number of classes, so that a usual bucket holds few of them, and the number
of bands follows from ``bits`` and the recall asked for at the threshold itself (closer pairs are
found more surely). Vectors are signed a few at a time, so that a task holds ``ENTRIES`` entries at
once however many bands there are. Buckets over ``BLOCK`` classes are cut into blocks, and each pair of blocks is
one task's work; nothing is left out, and a task holds two blocks at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_folder
from .keys import ROWS_PER_TASK
from .related import DUPLICATE_SCORE, clusters, cosine

BLOCK = 2_048
RECALL = 0.98
#: Sketches may differ by this many standard deviations more than expected at the threshold.
SLACK = 4.0
#: Sides in a sketch, and entries of bands that are made at once.
SKETCH, ENTRIES = 512, 1 << 16
FEWEST_BITS, MOST_BITS = 8, 20
SEED = 5


def vector_classes(
    vectors: DataFrame, channel: Column | str, vector: str = "embedding", key: str = "vec_id"
) -> DataFrame:
    """``(class_id, vector, members, channels, channel)``: one row for each different vector.

    ``class_id`` is the smallest member. ``channels`` counts the members' channels and
    ``channel`` is one of them, which is all that a class of one channel has. Vectors that are
    null, zero or hold null or non-finite entries take no part.
    """
    fine = F.forall(
        "vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    ) & F.exists("vector", lambda v: v != 0)
    channel = F.col(channel) if isinstance(channel, str) else channel
    rows = vectors.select(
        F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"), channel.alias("channel")
    )
    per_channel = (
        rows.filter(F.col("vector").isNotNull() & fine)
        .groupBy("vector", "channel")
        .agg(F.min("id").alias("id"), F.count("*").alias("n"))
    )
    return per_channel.groupBy("vector").agg(
        F.min("id").alias("class_id"),
        F.sum("n").alias("members"),
        F.count("*").alias("channels"),
        F.min("channel").alias("channel"),
    ).select("class_id", "vector", "members", "channels", "channel")


class Plan:
    """How many hyperplanes, dealt to how many bands, for a number of classes."""

    def __init__(self, classes: int, above: float, recall: float = RECALL):
        self.side = math.acos(max(-1.0, min(1.0, above))) / math.pi
        self.bits = max(FEWEST_BITS, min(MOST_BITS, math.ceil(math.log2(max(2, classes)))))
        shared = (1 - self.side) ** self.bits
        self.bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(shared, 1 - 1e-9))))
        self.planes = self.bits * self.bands
        self.sketch = min(self.planes, SKETCH)
        spread = math.sqrt(self.sketch * self.side * (1 - self.side))
        self.differ = min(self.sketch, math.ceil(self.sketch * self.side + SLACK * spread))

    def normals(self, d: int) -> np.ndarray:
        return np.random.default_rng(SEED).normal(size=(d, self.planes))


def _signed(plan: Plan, whole: bool = True):
    """An entry for each vector and band; without ``whole`` its bucket alone."""
    at_once = max(1, ENTRIES // plan.bands)
    weights = np.int64(1) << np.arange(plan.bits, dtype=np.int64)

    def entries(x: np.ndarray, ids: pa.Array, planes: np.ndarray) -> pa.RecordBatch:
        sides = x @ planes > 0
        keys = sides.reshape(len(x), plan.bands, plan.bits) @ weights
        columns = {
            "band": pa.array(np.tile(np.arange(plan.bands, dtype=np.int32), len(x))),
            "key": pa.array((keys << np.int64(16) | np.int64(x.shape[1])).ravel()),
        }
        if whole:
            sketch = np.repeat(np.packbits(sides[:, : plan.sketch], axis=1), plan.bands, axis=0)
            ends = np.arange(len(sketch) + 1, dtype=np.int32) * np.int32(sketch.shape[1])
            parts = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(sketch))]
            columns["id"] = ids.take(pa.array(np.repeat(np.arange(len(x)), plan.bands)))
            columns["sketch"] = pa.Array.from_buffers(pa.binary(), len(sketch), parts)
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            for d in np.unique(sizes):  # vectors of another length are a space of their own
                if d not in planes:
                    planes[d] = plan.normals(d)
                of_size = np.flatnonzero(sizes == d)
                for k in range(0, len(of_size), at_once):
                    at = pa.array(of_size[k : k + at_once])
                    x = column.take(at).flatten().to_numpy().reshape(-1, d)
                    yield entries(x, ids.take(at), planes[d])

    return run


def _compared(differ: int):
    """Pairs of a bucket (or of two of its blocks) whose sketches are close. Rows come sorted by
    bucket; each is held against those behind it."""

    def pairs(group: np.ndarray, block: np.ndarray, both: np.ndarray, ids: np.ndarray, words: np.ndarray):
        left, right = [], []
        live, step = np.arange(len(ids)), 1
        while True:
            live = live[live + step < len(ids)]
            live = live[group[live] == group[live + step]]
            if not len(live):
                break
            # two blocks meet here only to be held against each other
            use = live[~both[live] | (block[live] != block[live + step])]
            apart = np.bitwise_count(words[use] ^ words[use + step]).sum(axis=1)
            hit = use[apart <= differ]
            left.append(ids[hit])
            right.append(ids[hit + step])
            step += 1
        return (np.concatenate(left), np.concatenate(right)) if left else (ids[:0], ids[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def found(rows: pa.Table) -> pa.RecordBatch:
            columns = [rows.column(k).combine_chunks() for k in range(7)]
            parts = [c.to_numpy() for c in columns[:4]]
            change = np.zeros(rows.num_rows, bool)
            for p in parts:
                change[1:] |= p[1:] != p[:-1]
            sketch = columns[6].cast(pa.binary())
            _, ends, data = sketch.buffers()
            ends = np.frombuffer(ends, np.int32)[sketch.offset :][: rows.num_rows + 1]
            sides = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(rows.num_rows, -1)
            padded = np.zeros((rows.num_rows, -(-sides.shape[1] // 8) * 8), np.uint8)
            padded[:, : sides.shape[1]] = sides
            a, b = pairs(
                np.cumsum(change), columns[4].to_numpy(), parts[2] != parts[3],
                columns[5].to_numpy(), padded.view(np.uint64),
            )
            low, high = np.minimum(a, b), np.maximum(a, b)
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch])
            keys = [rows.column(k).to_numpy() for k in range(4)]
            same = np.ones(rows.num_rows, bool)
            for k in keys:
                same &= k == k[-1]
            last = rows.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield found(rows.slice(0, last))
            held = rows.slice(last).combine_chunks().to_batches()[0]
        if held is not None:
            yield found(pa.Table.from_batches([held]))

    return run


def near_pairs(
    classes: DataFrame, above: float = DUPLICATE_SCORE, block: int = BLOCK, recall: float = RECALL
) -> DataFrame:
    """``(a, b, score)``: pairs ``a < b`` of classes with a cosine over ``above``."""
    plan = Plan(classes.count(), above, recall)
    vectors, bucket = classes.select("class_id", "vector"), ["band", "key"]
    # buckets of several blocks are few: entries / block at most, which bounds the broadcast
    counted = vectors.mapInArrow(_signed(plan, False), "band int, key long").groupBy(*bucket)
    large = counted.agg(F.count("*").alias("n")).filter(F.col("n") > block)
    large = large.select(*bucket, F.ceil(F.col("n") / block).cast("int").alias("_blocks"))
    entries = vectors.mapInArrow(_signed(plan), "band int, key long, id long, sketch binary")
    entries = entries.join(F.broadcast(large), bucket, "left").withColumn(
        "blocks", F.coalesce("_blocks", F.lit(1))
    )
    entries = entries.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = entries.select("*", other).select(
        *bucket,
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        "own", "id", "sketch",
    )
    task = [*bucket, "low", "high"]
    close = (
        dealt.repartition(*task)
        .sortWithinPartitions(*task, "id")
        .mapInArrow(_compared(plan.differ), "a long, b long")
        .distinct()
    )
    one, two = (
        classes.select(F.col("class_id").alias(k), F.col("vector").alias(f"_{k}")) for k in "ab"
    )
    scored = close.join(one, "a").join(two, "b").withColumn("score", cosine(F.col("_a"), F.col("_b")))
    return scored.filter(F.col("score") > above).select("a", "b", "score")


def duplicates_across_channels(
    vectors: DataFrame, channel: Column | str, above: float = DUPLICATE_SCORE, **options
) -> DataFrame:
    """Near-duplicates whose members lie in different channels, as pairs of classes.

    ``a, b, score, a_members, b_members``. A class whose equal vectors lie in several channels is a
    row of its own with ``a = b`` and score 1; pairs wholly within one channel are left out.
    """
    path = fresh_folder(vectors.sparkSession, "vector-classes")
    vector_classes(vectors, channel).write.parquet(path)
    classes = vectors.sparkSession.read.parquet(path)
    facts = classes.select("class_id", "members", "channels", "channel")
    one, two = (facts.select(*[F.col(c).alias(f"{k}_{c}") for c in facts.columns]) for k in "ab")
    pairs = near_pairs(classes, above, **options)
    pairs = pairs.join(one, F.col("a") == F.col("a_class_id")).join(two, F.col("b") == F.col("b_class_id"))
    across = (
        (F.col("a_channels") > 1)
        | (F.col("b_channels") > 1)
        | ~F.col("a_channel").eqNullSafe(F.col("b_channel"))
    )
    columns = ["a", "b", "score", "a_members", "b_members"]
    within = classes.filter("channels > 1").select(
        F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(1.0).alias("score"),
        F.col("members").alias("a_members"), F.col("members").alias("b_members"),
    )
    return pairs.filter(across).select(*columns).unionByName(within)


def duplicate_groups(
    vectors: DataFrame, channel: Column | str, above: float = DUPLICATE_SCORE,
    rows_per_task: int = ROWS_PER_TASK, **options,
) -> DataFrame:
    """Groups of near-duplicates that links across channels join: ``group_id`` (smallest class),
    its classes and all their members."""
    pairs = duplicates_across_channels(vectors, channel, above, **options)
    path = fresh_folder(vectors.sparkSession, "near-pairs")
    pairs.write.parquet(path)
    pairs = vectors.sparkSession.read.parquet(path)
    joined = clusters(pairs.select("a", "b", "score"), above, rows_per_task)
    alone = pairs.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("cluster"))
    groups = joined.unionByName(alone).groupBy("node").agg(F.min("cluster").alias("group_id"))
    ends = pairs.select(F.col("a").alias("node"), F.col("a_members").alias("members")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b_members").alias("members"))
    )
    return (
        groups.join(ends.distinct(), "node")
        .groupBy("group_id")
        .agg(F.count("*").alias("classes"), F.sum("members").alias("members"))
    )
