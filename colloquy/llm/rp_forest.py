"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the largest inner product. Vectors are first lifted to a sphere (one more component,
so that all have the largest length), where the largest inner product is the smallest distance.
Trees are grown on the driver from a bounded sample of ``SAMPLE`` vectors: a node's plane lies
between two random points of it, and cuts at the median. Every vector is then routed to a leaf of
each tree. A query walks all trees by one priority queue: the next leaf is the one that the
query misses by least, until the leaves hold ``SHARE`` of all vectors (``LEAST`` at least).
Leaves are scored exactly in double precision, and the nearest of all leaves are kept.

Equal vectors are one class in index and queries; for a class only the ``k + 1`` smallest ids
matter. Leaves larger than ``CHUNK`` are dealt to several tasks, and each of their chunks is
searched whole.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
with null ids, take no part; of the lengths that vectors have, the most frequent takes part (the
longest if several are); rows of one id count as the smallest of their vectors; ties go to the
smaller id; fewer candidates than ``k`` are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TREES = 10
SAMPLE = 20_000
#: Sampled vectors in a leaf.
LEAF = 200
#: Rows in the leaves that a query visits, over all trees: a share of all vectors, and fewest.
SHARE = 1.2
LEAST = 4_000
#: Vectors, and queries, that one task holds against each other at once.
CHUNK = 4_096


@dataclass
class Tree:
    """Node i has a plane and two children; a child below 0 is leaf -1 - child."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray

    def leaves(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64) if len(self.normals) else np.full(len(points), -1)
        while len(live := np.flatnonzero(at >= 0)):
            node = at[live]
            side = np.einsum("ij,ij->i", points[live], self.normals[node]) > self.offsets[node]
            at[live] = self.children[node, side.astype(np.int64)]
        return -1 - at


def grown(points: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    normals, offsets, children = [], [], []
    leaves = 0

    def add(own: np.ndarray) -> int:
        nonlocal leaves
        if len(own) > leaf:
            for _ in range(5):
                a, b = points[rng.choice(own, 2, replace=False)]
                normal = a - b
                length = np.linalg.norm(normal)
                if length == 0:
                    continue
                normal = normal / length
                along = points[own] @ normal
                offset = float(np.median(along))
                right = along > offset
                if right.any() and not right.all():
                    node = len(normals)
                    normals.append(normal)
                    offsets.append(offset)
                    children.append([0, 0])
                    children[node] = [add(own[~right]), add(own[right])]
                    return node
        leaves += 1
        return -leaves

    add(np.arange(len(points)))
    d = points.shape[1]
    return Tree(
        np.array(normals).reshape(-1, d), np.array(offsets), np.array(children, np.int64).reshape(-1, 2)
    )


def nearest_leaves(
    trees: list[Tree], sizes: list[np.ndarray], query: np.ndarray, want: int
) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue, until ``want`` rows are in them."""
    margins = [t.normals @ query - t.offsets for t in trees]
    heap = [(0.0, k, 0 if len(t.normals) else -1) for k, t in enumerate(trees)]
    found, held = [], 0
    while heap and held < want:
        missed, k, node = heapq.heappop(heap)
        while node >= 0:
            margin, children = margins[k][node], trees[k].children[node]
            near = int(margin > 0)
            heapq.heappush(heap, (max(missed, abs(margin)), k, int(children[1 - near])))
            node = int(children[near])
        leaf = -1 - node
        if sizes[k][leaf]:
            found.append((k, leaf))
            held += int(sizes[k][leaf])
    return found


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(vec_id, vector)`` of the rows that take part, one row for each id."""
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
    )
    fine = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists("vector", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & fine)
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("d")).count()
    usual = lengths.agg(F.max_by("d", F.struct("count", "d")).alias("d")).scalar()
    return rows.filter(F.size("vector") == usual)


def _points(column, most: float) -> np.ndarray:
    """Vectors with the component that lifts them to the sphere."""
    x = np.stack(column.to_numpy())
    rest = np.sqrt(np.maximum(0.0, most * most - np.einsum("ij,ij->i", x, x)))
    return np.column_stack([x, rest])


def _routed(trees: list[Tree], most: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                points = _points(rows["vector"], most)
                for k, tree in enumerate(trees):
                    yield rows.assign(tree=k, leaf=tree.leaves(points))

    return run


def _visits(trees: list[Tree], sizes: list[np.ndarray], want: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for one in rows.itertuples():
                query = np.append(one.vector, 0.0)
                found = nearest_leaves(trees, sizes, query, want)
                yield pd.DataFrame(
                    {
                        "cid": one.cid,
                        "vector": [one.vector] * len(found),
                        "tree": [k for k, _ in found],
                        "leaf": [leaf for _, leaf in found],
                    }
                )

    return run


def _scored(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            x, ids = np.stack(index["vector"].to_numpy()), index["cid"].to_numpy()
            q, names = np.stack(queries["vector"].to_numpy()), queries["cid"].to_numpy()
            for at in range(0, len(q), 256):
                rough = q[at : at + 256] @ x.T
                best = (
                    np.argpartition(-rough, k - 1, axis=1)[:, :k]
                    if k < len(x)
                    else np.tile(np.arange(len(x)), (len(rough), 1))
                )
                exact = np.sum(x[best] * q[at : at + 256, None, :], axis=2)
                out.append(
                    pd.DataFrame(
                        {
                            "qid": np.repeat(names[at : at + 256], best.shape[1]),
                            "cid": ids[best].ravel(),
                            "score": exact.ravel(),
                        }
                    )
                )
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "cid": [], "score": []})

    return run


def nearest(
    vectors: DataFrame,
    queries,
    *,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    trees: int = TREES,
    sample: int = SAMPLE,
    share: float = SHARE,
    least: int = LEAST,
    seed: int = 5,
) -> DataFrame:
    """The ``k`` nearest found for each vector whose id fulfils the condition ``queries`` (a
    column over ``vec_id``): ``query_id``, ``rank`` from 1, ``vec_id``, ``score``."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, key, vector), "vectors")
    ids = rows.withColumn(
        "n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    ).filter(F.col("n") <= k + 1)
    classes = written(
        ids.groupBy("vector").agg(
            F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids")
        ),
        "classes",
    )
    total, most = classes.agg(
        F.count("*"),
        F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))),
    ).first()
    columns = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], columns)
    picked = classes.orderBy(F.xxhash64("cid", F.lit(seed))).limit(sample).select("vector")
    points = _points(picked.toPandas()["vector"], most)
    rng = np.random.default_rng(seed)
    forest = [grown(points, LEAF, rng) for _ in range(trees)]

    shape = "cid long, vector array<double>, tree int, leaf int"
    own = classes.select("cid", "vector")
    index = written(own.mapInPandas(_routed(forest, most), shape), "leaves")

    def by_leaf(df: DataFrame) -> dict[tuple[int, int], int]:
        # a row for each leaf of the forest at most
        return {(r["tree"], r["leaf"]): r["count"] for r in df.groupBy("tree", "leaf").count().collect()}

    held = by_leaf(index)
    sizes = [np.zeros(len(t.children) + 1, np.int64) for t in forest]
    for (tree, leaf), n in held.items():
        sizes[tree][leaf] = n
    asking = rows.filter(queries).select(F.col("vec_id").alias("query_id"), "vector")
    asked = asking.select("vector").distinct().join(own, "vector")
    want = max(int(share * total), least)
    # queries are spread over tasks before the walk
    visits = written(
        asked.repartition("cid").mapInPandas(_visits(forest, sizes, want), shape), "visits"
    )
    asked_of = by_leaf(visits)
    parts = spark.createDataFrame(
        [(t, leaf, -(-n // CHUNK), -(-asked_of.get((t, leaf), 0) // CHUNK)) for (t, leaf), n in held.items()],
        "tree int, leaf int, xs int, qs int",
    )

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        here = F.pmod(F.xxhash64("cid"), F.col(mine)).cast("int").alias(mine[0])
        there = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[0])
        return df.join(parts.filter("qs > 0"), ["tree", "leaf"]).select(
            "cid", "vector", "tree", "leaf", here, there
        )

    block = ("tree", "leaf", "x", "q")
    found = (
        dealt(index, "xs", "qs")
        .groupBy(*block)
        .cogroup(dealt(visits, "qs", "xs").groupBy(*block))
        .applyInPandas(_scored(k + 1), "qid long, cid long, score double")
    )
    found = found.groupBy("qid", "cid").agg(F.max("score").alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    # members of the classes, nearest first
    found = found.join(classes.select("cid", "ids"), "cid").select(
        "qid", F.explode("ids").alias("vec_id"), "score"
    )
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    lists = found.groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found")
    )
    of_class = lists.join(own, F.col("qid") == F.col("cid")).select("vector", "found")
    out = asking.join(of_class, "vector").select(
        "query_id",
        F.posexplode(
            F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
        ).alias("at", "x"),
    )
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
