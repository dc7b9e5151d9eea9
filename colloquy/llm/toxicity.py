"""Toxicity of texts by class-conditional Kneser-Ney models.

Words are spelled by character n-grams that don't cross word ends. For toxic and for ordinary
texts a model of its own gives the probability of a character behind the ``ORDER - 1`` before it:
counts of the class, less a discount, the rest going to a backoff distribution. The backoff is one
for both classes: a Kneser-Ney distribution of the lower orders, from continuation counts over
both. So an expression that a class has hardly seen is as likely in either model, and says nothing.

A word of a toxic text is taken to come from the toxic model with probability ``RATE`` and from the
ordinary one else. The two log-likelihoods of a text, per word, are compared; that difference and
the one over the whole text go through a logistic curve fitted on labelled texts that the counts
don't hold.

All counts are Spark aggregates over the labelled training rows, of which up to ``LABELLED`` (by a
hash of the id) are used; that bound alone bounds the model. Every n-gram that a class has seen more
often than the discount has a row in it. Any other n-gram has no count of its own left in either
class: both models give it their context's share of the backoff, so its ratio is that of the two
shares, and a context without such an n-gram gives all to the backoff and says nothing. The model
is held as sorted 64-bit hashes with their values, 12 bytes a row. Scoring reads whole texts of all
rows.

Defined cases: null and empty texts have no words and score what the curve gives for that; labels
other than 0 and 1, and null ids, don't teach; several labels of an id teach the largest; without
labels of both classes every score is the share of toxic labels (0 if there are none); repeated
rows each get their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import likely_in, written

#: Characters in an n-gram; what each seen n-gram gives to the backoff, in the classes' counts
#: and in the continuation counts.
ORDER = 8
DISCOUNT = 2.0
LOWER_DISCOUNT = 0.75
#: Share of toxic words in toxic texts.
RATE = 0.003
#: Bound of the labelled rows, a quarter of which is for the curve.
LABELLED = 100_000
THRESHOLD = 0.3
#: Longest words that a worker remembers, and how many.
LONGEST, REMEMBERED = 40, 500_000
#: Texts whose words are looked up together.
TOGETHER = 64

START, END = "\x02", "\x03"


def grams(word: str, order: int = ORDER) -> list[str]:
    padded = START * (order - 1) + word + END
    return [padded[i : i + order] for i in range(len(word) + 1)]


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _rolled(columns) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams given by their characters' columns, and of all but their last ones."""
    h = context = np.uint64(0)
    for points in columns:
        context = h
        h = (h + points) * _STEP
        h = h ^ (h >> np.uint64(29))
    return (h * _MIX).view(np.int64), (context * _MIX).view(np.int64)


def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all n-grams of the words, in order: their hashes, those of their contexts (all but the
    last character), and where each word's begin."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    points = _points("".join([START * (ORDER - 1) + w + END for w in words]))
    # a word's first n-gram begins where its padding does
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(words)) * (ORDER - 1), sizes)
    return *_rolled(points[at + k] for k in range(ORDER)), np.cumsum(sizes) - sizes


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by class, merged within a batch."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[label].update(_words(text))
        for label in (0, 1):
            sums: Counter[str] = Counter()
            for word, n in counts[label].items():
                for g in grams(word):
                    sums[g] += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sums.keys(), pa.string()),
                    pa.array([label] * len(sums), pa.int32()),
                    pa.array(sums.values(), pa.int64()),
                ],
                names=["g", "label", "n"],
            )


def backoff(top: DataFrame) -> DataFrame:
    """``(g, p)``: the shared probability of the last character of each (ORDER - 1)-gram ``g``.

    ``top`` has each n-gram seen, once. A gram's continuation count is the number of different
    characters seen before it; probabilities are built from the shortest grams up.
    """
    levels = {ORDER: top.select("g")}
    for k in range(ORDER - 1, 0, -1):
        longer = levels[k + 1].select(F.substring("g", 2, k).alias("g"))
        levels[k] = longer.groupBy("g").agg(F.count("*").alias("c"))
        if k == ORDER - 1:
            levels[k] = written(levels[k], "continuations")
    total = levels[1].agg(F.sum("c")).scalar()
    kinds = levels[1].agg(F.count("*")).scalar()
    found = levels[1].select(
        "g",
        (
            F.greatest(F.col("c") - LOWER_DISCOUNT, F.lit(0.0)) / total
            + LOWER_DISCOUNT * kinds / total / (kinds + 1)
        ).alias("p"),
    )
    for k in range(2, ORDER):
        context = F.substring("g", 1, k - 1)
        sums = levels[k].groupBy(context.alias("h")).agg(
            F.sum("c").alias("all"), F.count("*").alias("kinds")
        )
        shorter = found.select(F.col("g").alias("s"), F.col("p").alias("below"))
        found = (
            levels[k]
            .select("g", "c", context.alias("h"), F.substring("g", 2, k - 1).alias("s"))
            .join(sums, "h")
            .join(shorter, "s")
            .select(
                "g",
                (
                    F.greatest(F.col("c") - LOWER_DISCOUNT, F.lit(0.0)) / F.col("all")
                    + LOWER_DISCOUNT * F.col("kinds") / F.col("all") * F.col("below")
                ).alias("p"),
            )
        )
    return found


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows' n-grams and their contexts as hashes."""
    for batch in batches:
        g, h = _rolled(_points("".join(batch.column("g").to_pylist())).reshape(-1, ORDER).T)
        yield pa.RecordBatch.from_arrays(
            [pa.array(g), pa.array(h), batch.column("v"), batch.column("w")], names=["g", "h", "v", "w"]
        )


def learned(texts: DataFrame) -> Scorer:
    """From labelled texts ``(text, label)``: the log ratio of the classes' probabilities for each
    n-gram with a count of its own, and for other characters behind a known context."""
    counts = written(
        texts.select("text", F.col("label").cast("int"))
        .mapInArrow(_counted, "g string, label int, n long")
        .groupBy("g")
        .agg(*[F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]),
        "grams",
    )
    context = F.substring("g", 1, ORDER - 1).alias("h")
    # what a context's n-grams give away goes to the backoff, by class
    sums = counts.groupBy(context).agg(
        *[F.sum(f"n{c}").alias(f"all{c}") for c in (0, 1)],
        *[F.sum(F.least(f"n{c}", F.lit(DISCOUNT))).alias(f"rest{c}") for c in (0, 1)],
        F.max(F.greatest("n0", "n1")).alias("most"),
    )
    sums = sums.filter(F.col("most") > DISCOUNT)
    share = [
        F.when(F.col(f"all{c}") > 0, F.col(f"rest{c}") / F.col(f"all{c}")).otherwise(1.0)
        for c in (0, 1)
    ]
    own = [
        F.when(
            F.col(f"all{c}") > 0,
            F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"all{c}"),
        ).otherwise(0.0)
        for c in (0, 1)
    ]
    lower = backoff(counts).select(F.col("g").alias("s"), "p")
    likely = (
        counts.filter(F.greatest("n0", "n1") > DISCOUNT)
        .select("g", "n0", "n1", context, F.substring("g", 2, ORDER - 1).alias("s"))
        .join(sums, "h")
        .join(lower, "s")
        .select(
            "g",
            "h",
            F.log((own[1] + share[1] * F.col("p")) / (own[0] + share[0] * F.col("p"))).alias("v"),
            F.log(share[1] / share[0]).alias("w"),
        )
    )
    rows = likely.mapInArrow(_hashed, "g long, h long, v double, w double").toArrow()
    g, h, v, w = (c.to_numpy() for c in rows.columns)
    return Scorer(*_sorted(g, v), *_sorted(h, w))


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, first = np.unique(keys, return_index=True)
    return found, values[first].astype(np.float32)


class Scorer:
    """Per word the log ratio of a toxic text's probability to an ordinary one's."""

    def __init__(
        self, grams: np.ndarray, ratios: np.ndarray, contexts: np.ndarray, weights: np.ndarray
    ):
        self.grams, self.ratios, self.contexts, self.weights = grams, ratios, contexts, weights
        self.known: dict[str, float] = {}

    def of_words(self, words: list[str]) -> np.ndarray:
        """The ratios of words, all at once."""
        own, context, starts = hashes(words)
        sums = np.zeros(len(own))
        for keys, table, values in (
            (context, self.contexts, self.weights),
            (own, self.grams, self.ratios),  # which count where there are any
        ):
            if len(table):
                place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
                hit = table[place] == keys
                sums[hit] = values[place[hit]]
        whole = np.add.reduceat(sums, starts) if len(starts) else sums
        return np.log1p(RATE * np.expm1(np.minimum(whole, 50.0)))

    def learn(self, words: set[str]) -> dict[str, float]:
        """The ratios of a batch's words; short ones are remembered for later batches."""
        new = [w for w in words if w not in self.known]
        found = dict(zip(new, self.of_words(new).tolist(), strict=True))
        if len(self.known) + len(found) > REMEMBERED:
            self.known = {}
        self.known.update((w, v) for w, v in found.items() if len(w) <= LONGEST)
        return found

    def features(self, texts: list[str | None]) -> list[tuple[float, float]]:
        """For each text the difference of the log-likelihoods per word, and that of the whole."""
        split = [_words(t) for t in texts]
        before = self.known
        found = self.learn(set().union(*split))
        out = []
        for words in split:
            whole = sum(v if (v := found.get(w)) is not None else before[w] for w in words)
            out.append((whole / max(1, len(words)), whole))
        return out


def _features(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.value
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, TOGETHER):
                found += scorer.features(batch.column("text").slice(at, TOGETHER).to_pylist())
            others = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in others],
                    pa.array([x[0] for x in found], pa.float64()),
                    pa.array([x[1] for x in found], pa.float64()),
                ],
                names=[*others, "mean", "whole"],
            )

    return run


def _scaled(mean: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.column_stack([np.arcsinh(300 * mean), np.arcsinh(whole), np.ones(len(mean))])


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, lightly held back."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(bend, x.T @ (y - p) - 1e-2 * w)
    return w


def scored(
    documents: DataFrame,
    labels: DataFrame,
    teaches: Column,
    *,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
) -> DataFrame:
    """``(id, score, predicted)`` of every document. ``teaches`` is a condition over the column
    ``id``: only labels of such rows are used."""
    spark = documents.sparkSession
    docs = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"))
    known = (
        known.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & teaches)
        .groupBy("id")
        .agg(F.max("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("id"))
        .limit(LABELLED)
    )
    # a quarter of them is for the curve
    for_curve = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0
    known = written(known.withColumn("curve", for_curve), "labels")
    taught = docs.filter(likely_in(known, "id", F.col("id"))).join(known, "id")
    taught = written(taught, "labelled")
    n, toxic, counted = taught.agg(
        F.count("*"), F.sum("label"), F.sum(F.when(~F.col("curve"), F.col("label")))
    ).first()
    if not toxic or toxic == n or not counted:
        share = float(toxic or 0) / max(1, n)
        return docs.select(
            "id", F.lit(share).alias("score"), F.lit(int(share >= THRESHOLD)).alias("predicted")
        )
    model = spark.sparkContext.broadcast(learned(taught.filter(~F.col("curve"))))
    sample = (
        taught.filter("curve")
        .select("label", "text")
        .mapInArrow(_features(model), "label int, mean double, whole double")
        .toPandas()
    )
    x = _scaled(sample["mean"].to_numpy(), sample["whole"].to_numpy())
    a, b, c = (float(v) for v in fitted(x, sample["label"].to_numpy(float)))
    found = docs.mapInArrow(_features(model), "id long, mean double, whole double")
    line = a * F.asinh(300 * F.col("mean")) + b * F.asinh("whole") + c
    score = 1 / (1 + F.exp(-line))
    return found.select("id", score.alias("score")).select(
        "id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
