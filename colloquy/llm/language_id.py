"""Language of texts: sparse multinomial logistic regression on TF-IDF of character n-grams.

A text's letters are lower-cased and everything else becomes one space between words. N-grams of
one to ``LONGEST`` characters within words, their edges included, are hashed to ``FEATURES``
places. A place weighs ``(1 + log tf) * idf``, and a text's vector has length one. Document
frequencies come from all texts that teach.

The weights learn by follow-the-regularised-leader (per-coordinate steps, McMahan et al. 2013)
with L1 and L2 penalties, in small batches over a bounded sample: each language gives
``PER_LANGUAGE`` texts at most in expectation, all together ``LABELLED``, picked by a hash of id
and text. A quarter of the sample stays out and calibrates one temperature for the probabilities.
The model is a table of places x languages, of which the L1 penalty leaves few; the driver holds
it and the sample's vectors, nothing else.

Defined cases: a text that is null or has no letter is ``und`` with score 0; null ids and null
languages don't teach, nor do texts without letters; with one language taught every text with
letters has it, with score 1; with none every text is ``und``, score 0; texts of any length are
read whole, in stretches; ties go to the language that sorts first; repeated rows each get their
row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
LONGEST, FEATURES = 3, 1 << 17
#: Bounds of the sample that teaches the weights.
LABELLED, PER_LANGUAGE = 8_000, 2_000
#: Of the follow-the-regularised-leader steps: rate, and what it starts from; the penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-3
EPOCHS, BATCH = 4, 16
#: Characters taken at once.
STRETCH = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SHIFT = np.uint64(64 - (FEATURES.bit_length() - 1))


@cache
def _letters() -> np.ndarray:
    """For each code point: itself if a letter, else a space."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], np.uint32)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, runs of others as one space; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _letters()[points]
    space = points == 32
    if space.all():
        return points[:0]
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return points[keep]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's n-grams, ascending, and how often each occurs."""
    sums = None
    for at in range(0, len(text or ""), STRETCH):
        points = letters(text[at : at + STRETCH])
        if not len(points):
            continue
        # a space at either end; words cut by a stretch give an n-gram or two of their halves
        line = np.full(len(points) + 2, 32, np.uint64)
        line[1:-1] = points
        found, h = [], np.zeros(len(line), np.uint64)
        for n in range(LONGEST):
            h = (h[: len(line) - n] * _MIX[0] + line[n:] + np.uint64(n)) * _MIX[1]
            whole = h
            if n == 0:
                whole = h[line != 32]
            elif n == 2:  # no n-gram across words
                whole = h[line[1:-1] != 32]
            found.append(((whole ^ (whole >> np.uint64(29))) * _MIX[2] >> _SHIFT).astype(np.int64))
        part = np.bincount(np.concatenate(found), minlength=FEATURES)
        sums = part if sums is None else sums + part
    if sums is None:
        return np.zeros(0, np.int64), np.zeros(0)
    places = np.flatnonzero(sums)
    return places, sums[places]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's texts have each place; their number stands at place -1."""
    sums, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            places, _ = counts(text.as_py())
            sums[places] += 1
            n += len(places) > 0
    places = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(places, -1), pa.int32()), pa.array(np.append(sums[places], n), pa.int64())],
        names=["place", "n"],
    )


def weighed(places: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(tf)) * idf[places]
    return x / max(1e-12, float(np.sqrt(x @ x)))


def _vectors(idf: np.ndarray):
    """``lang, places, weights`` of texts with letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places, tf = counts(text)
                if len(places):
                    rows.append((lang, places.astype(np.int32), weighed(places, tf, idf).astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[2] for r in rows], pa.list_(pa.float32())),
                ],
                names=["lang", "places", "weights"],
            )

    return run


class Leader:
    """Weights that follow the regularised leader: sums ``z`` and squared slopes ``n``."""

    def __init__(self, places: int, classes: int):
        self.z, self.n = np.zeros((places, classes)), np.zeros((places, classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def step(self, at: np.ndarray, w: np.ndarray, slope: np.ndarray) -> None:
        """One step of the different places ``at``, whose weights are ``w``."""
        n = self.n[at]
        more = n + slope * slope
        self.z[at] += slope - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more


def probabilities(lines: np.ndarray) -> np.ndarray:
    e = np.exp(lines - lines.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


Rows = list[tuple[np.ndarray, np.ndarray]]


def trained(rows: Rows, y: np.ndarray, classes: int, seed: int = 11) -> np.ndarray:
    """Weights (places x classes; the last row is the constant) of labelled vectors."""
    rng, leader = np.random.default_rng(seed), Leader(FEATURES + 1, classes)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            own = order[start : start + BATCH]
            sizes = [len(rows[i][0]) for i in own]
            row = np.repeat(np.arange(len(own)), sizes)
            at, back = np.unique(np.concatenate([rows[i][0] for i in own]), return_inverse=True)
            x = np.zeros((len(own), len(at) + 1))
            x[row, back] = np.concatenate([rows[i][1] for i in own])
            x[:, -1] = 0.1  # the constant
            at = np.append(at, FEATURES)
            w = leader.weights(at)
            p = probabilities(x @ w)
            p[np.arange(len(own)), y[own]] -= 1.0
            leader.step(at, w, x.T @ p)
    return leader.weights()


@dataclass
class Model:
    """Weights of the places that have any, the constant last, with the temperature applied."""

    languages: list[str]
    idf: np.ndarray
    row: np.ndarray  # place -> row of weights, the last but one (zeros) for places without
    weights: np.ndarray

    @classmethod
    def of(cls, languages: list[str], idf: np.ndarray, weights: np.ndarray) -> Model:
        kept = np.flatnonzero(np.any(weights[:-1] != 0, axis=1))
        row = np.full(FEATURES, len(kept), np.int32)
        row[kept] = np.arange(len(kept), dtype=np.int32)
        zeros = np.zeros((1, len(languages)))
        return cls(languages, idf, row, np.vstack([weights[kept], zeros, weights[-1:]]))

    def line(self, places: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[self.row[places]] + 0.1 * self.weights[-1]

    def predicted(self, text: str | None) -> tuple[str, float]:
        places, tf = counts(text)
        if not len(places):
            return UNKNOWN, 0.0
        p = probabilities(self.line(places, weighed(places, tf, self.idf))[None])[0]
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, p[best]))


def temperature(lines: np.ndarray, y: np.ndarray) -> float:
    """The divisor of ``lines`` that makes the labels likeliest: golden sections of its log."""

    def loss(log_t: float) -> float:
        p = probabilities(lines / np.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean())

    ratio = (np.sqrt(5) - 1) / 2
    low, high = np.log(0.02), np.log(20.0)
    while high - low > 1e-4:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learned(taught: DataFrame) -> Model | None:
    """A model from ``id, text, lang`` (no nulls in id and lang); None without any."""
    sizes = {r.lang: r["count"] for r in taught.groupBy("lang").count().collect()}
    sums = taught.select("text").mapInArrow(_frequencies, "place int, n long").groupBy("place")
    found = sums.agg(F.sum("n").alias("n")).toArrow()
    places, n = found.column("place").to_numpy(), found.column("n").to_numpy()
    texts = int(n[places < 0].sum())
    if not texts:
        return None
    df = np.zeros(FEATURES)
    df[places[places >= 0]] = n[places >= 0]
    idf = np.log((1 + texts) / (1 + df)) + 1
    each = min(PER_LANGUAGE, LABELLED / len(sizes))
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rate = F.lit(0.0)
    for lang, size in sizes.items():
        rate = F.when(F.col("lang") == lang, min(1.0, each / size)).otherwise(rate)
    rows = taught.filter(draw < rate).select("lang", "text").mapInArrow(
        _vectors(idf), "lang string, places array<int>, weights array<float>"
    ).toArrow()
    langs = rows.column("lang").to_pylist()
    languages = sorted(set(langs))
    vectors = [
        (p.values.to_numpy(), w.values.to_numpy().astype(float))
        for p, w in zip(rows.column("places"), rows.column("weights"), strict=True)
    ]
    y = np.array([languages.index(v) for v in langs])
    # the same order whatever task gave a row
    order = sorted(range(len(y)), key=lambda i: (y[i], vectors[i][0].tobytes(), vectors[i][1].tobytes()))
    vectors, y = [vectors[i] for i in order], y[order]
    aside = np.arange(len(y)) % 4 == 3
    fit = np.flatnonzero(~aside)
    weights = trained([vectors[i] for i in fit], y[fit], len(languages))
    model = Model.of(languages, idf, weights)
    if aside.any():
        lines = np.array([model.line(*vectors[i]) for i in np.flatnonzero(aside)])
        model.weights /= temperature(lines, y[aside])
    return model


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            found = [own.predicted(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["id", "lang_pred", "score"],
            )

    return run


def identified(
    documents: DataFrame, teaches: Column, *, text: str = "text", key: str = "doc_id", lang: str = "lang"
) -> DataFrame:
    """``(id, lang_pred, score)`` of every document. ``teaches`` is a condition over the column
    ``id``: only text and language of such rows are learned from."""
    docs = documents.select(
        F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    model = learned(docs.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & teaches))
    docs = docs.select("id", "text")
    if model is None:
        return docs.select("id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predicted(shared), "id long, lang_pred string, score double")
