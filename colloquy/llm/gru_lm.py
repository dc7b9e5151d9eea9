"""Log-likelihood of texts under a gated recurrent language model with a class-factored softmax.

Words fall into classes. The ``WORDS`` most frequent ones, and the end of a text, have classes of
``PER_CLASS`` by frequency; every other word, known or not, has a class by its spelling. A word's
probability is that of its class, a softmax over the hidden state, times its own within the
class: a softmax over the hidden state for frequent words, and (count + 0.5) / (class count +
0.5 (class types + 1)) for others, which leaves half a count for words never seen.

All counts are Spark aggregates over all training texts. The weights are numpy arrays of fixed
size: they start at the counts' distribution, and each of ``ROUNDS`` rounds trains a copy of them
in every task; the mean of the copies, by tokens, goes on. The rounds share out the training texts
by a hash, and together are one pass over every token of every training text, by backpropagation
truncated to windows of ``WINDOW`` tokens (of more, where few texts are left). In training as in scoring the state is carried from
window to window, from a text's first token to its end.

Tasks hold the counts of the ``COUNTED`` most frequent words. Counts of other words meet the texts
in a join, so no table of all words is sent around.

Defined cases: null and empty texts are the end token alone; rows with a null id don't teach;
repeated rows each get their row; without training texts all words are unknown and the weights
stay as they start; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import greatest, lower_words, written

WORDS = 1023
PER_CLASS = 32
SPELLED = 32
HIDDEN = 24
COUNTED = 100_000
#: Training: rounds, tokens of a window, texts side by side, fewest tokens of a step, step size.
ROUNDS = 2
WINDOW = 16
SIDE_BY_SIDE = 256
FEWEST = 512
STEP = 0.01
#: Scoring: texts side by side, and tokens of a window.
SLOTS = 512
SPAN = 64

#: The end of a text; no word holds white space.
END = "\n"
_CLASSES = (WORDS + 1) // PER_CLASS


def spelled(word: str) -> int:
    """The class of a word that isn't frequent: by its last letters."""
    return zlib.crc32(word.rstrip(".,;:!?")[-2:].encode("utf-8", "surrogatepass")) % SPELLED


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


class Vocabulary(dict):
    """Input ids of words: frequent ones by rank, others behind them by spelling."""

    def __init__(self, frequent: list[str]):
        super().__init__({w: i for i, w in enumerate(frequent)})
        self.fixed = frozenset(frequent)

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            for w in [w for w in self if w not in self.fixed]:
                del self[w]
        found = self[word] = WORDS + 1 + spelled(word)
        return found


class Known(dict):
    """Places of the words whose counts are at hand; others give -1 and are noted."""

    def __init__(self, found: list[str]):
        super().__init__({w: i for i, w in enumerate(found)})
        self.rest: list[str] = []

    def __missing__(self, word: str) -> int:
        self.rest.append(word)
        return -1


def start(frequent: np.ndarray, others: np.ndarray) -> dict[str, np.ndarray]:
    """Weights that give the counts' distribution whatever the state."""
    rng = np.random.default_rng(3)
    h, ids = HIDDEN, WORDS + 1 + SPELLED
    by_class = np.zeros((_CLASSES, PER_CLASS))
    by_class.flat[: len(frequent)] = frequent
    total = np.concatenate([by_class.sum(axis=1), others])
    return {
        k: v.astype(np.float32)
        for k, v in {
            "x": rng.normal(0, 0.3, (ids, 3 * h)),
            "u": rng.normal(0, 1 / math.sqrt(h), (h, 3 * h)),
            "wc": np.zeros((h, len(total))),
            "bc": np.log(total + 0.5),
            "wf": np.zeros((_CLASSES, h, PER_CLASS)),
            "bf": np.log(by_class + 0.5),
        }.items()
    }


def _run(p: dict, h: np.ndarray, ids: np.ndarray, fresh: np.ndarray, keep: dict | None = None):
    """States before each token of ``ids`` (time, slot), and the last one. ``fresh`` marks tokens
    that begin a text: their state is zero.

    Arrays inside are (time, unit, slot), so that a step works on long rows of slots; ``keep``
    takes those that the gradients need.
    """
    n, kind = HIDDEN, p["u"].dtype
    inputs, across = np.ascontiguousarray(p["x"].T), np.ascontiguousarray(p["u"].T)
    h, begins = np.ascontiguousarray(h.T, kind), fresh.any(axis=1)
    out = np.empty((len(ids), n, ids.shape[1]), kind)
    if keep is not None:
        keep.update({k: np.empty_like(out) for k in ("z", "r", "c", "passed")}, states=out)
    for t in range(len(ids)):
        if begins[t]:
            h = h * ~fresh[t]
        out[t] = h
        a, b = np.take(inputs, ids[t], axis=1), across @ h
        zr, c = a[: 2 * n], a[2 * n :]
        zr += b[: 2 * n]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        if keep is not None:
            keep["z"][t], keep["r"][t], keep["passed"][t] = zr[:n], zr[n:], b[2 * n :]
        c += zr[n:] * b[2 * n :]
        np.tanh(c, out=c)
        if keep is not None:
            keep["c"][t] = c
        h = h - c
        h *= zr[:n]
        h += c
    return out.transpose(0, 2, 1), h.T


def _by_unit(steps: np.ndarray) -> np.ndarray:
    """An array (time, unit, slot) as (unit, token)."""
    return np.ascontiguousarray(steps.transpose(1, 0, 2)).reshape(steps.shape[1], -1)


def _log_share(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log-softmax of one entry of each column."""
    x -= x.max(axis=0)
    one = x[chosen, np.arange(x.shape[1])].astype(float)
    np.exp(x, out=x)
    return one - np.log(x.sum(axis=0))


def _error(x: np.ndarray, chosen: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted gradients of the columns' logits: their softmax less the entry to be found."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x *= weight / x.sum(axis=0)
    x[chosen, np.arange(x.shape[1])] -= weight
    return x


def _class_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids <= WORDS, ids // PER_CLASS, ids - WORDS - 1 + _CLASSES).astype(np.int16)


def _by_class(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Places of the frequent words' tokens, class by class, and each class's range of them."""
    order = np.argsort(classes, kind="stable")
    ends = np.searchsorted(classes[order], np.arange(_CLASSES + 1))
    spans = [(c, slice(ends[c], ends[c + 1])) for c in range(_CLASSES) if ends[c] < ends[c + 1]]
    return order[: ends[-1]], spans


def _classes(p: dict, states: np.ndarray) -> np.ndarray:
    """Logits of the classes, a column for each token."""
    x = p["wc"].T @ states
    x += p["bc"][:, None]
    return x


def _within(p: dict, states: np.ndarray, spans: list[tuple[int, slice]]) -> np.ndarray:
    """Logits of the words within their classes, a column for each token."""
    x = np.empty((PER_CLASS, states.shape[1]), states.dtype)
    for c, span in spans:
        x[:, span] = p["wf"][c].T @ states[:, span] + p["bf"][c][:, None]
    return x


def log_likelihoods(p: dict, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of tokens given their states; of a word that isn't frequent,
    its class's."""
    return _logs(p, np.ascontiguousarray(states.T), ids)


def _logs(p: dict, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    classes = _class_of(ids)
    out = _log_share(_classes(p, states), classes)
    inside, spans = _by_class(classes)
    if len(inside):
        logits = _within(p, np.take(states, inside, axis=1), spans)
        out[inside] += _log_share(logits, ids[inside] % PER_CLASS)
    return out


def gradients(
    p: dict, h: np.ndarray, ids: np.ndarray, real: np.ndarray, fresh: np.ndarray | None = None
):
    """Gradients of the mean negative log-likelihood of a window, truncated at its start and
    where a text begins (``fresh``)."""
    keep: dict = {}
    if fresh is None:
        fresh = np.zeros(ids.shape, bool)
    _, last = _run(p, h, ids, fresh, keep)
    n, kind, g = HIDDEN, p["u"].dtype, {k: np.zeros_like(p[k]) for k in ("x", "wf", "bf")}
    flat, tokens = _by_unit(keep["states"]), ids.ravel()
    weight = (real.ravel() / max(1, real.sum())).astype(kind)
    classes = _class_of(tokens)
    d = _error(_classes(p, flat), classes, weight)
    g["wc"], g["bc"] = flat @ d.T, d.sum(axis=1)
    back = p["wc"] @ d
    inside, spans = _by_class(classes)
    if len(inside):
        own = np.take(flat, inside, axis=1)
        d = _error(_within(p, own, spans), tokens[inside] % PER_CLASS, weight[inside])
        into = np.empty_like(own)
        for c, span in spans:
            g["wf"][c], g["bf"][c] = own[:, span] @ d[:, span].T, d[:, span].sum(axis=1)
            into[:, span] = p["wf"][c] @ d[:, span]
        back[:, inside] += into
    back = back.reshape(n, *ids.shape)
    # what the steps' gradients are multiplied by on their way back, for all steps at once
    z, r, c = keep["z"], keep["r"], keep["c"]
    by_z = (keep["states"] - c) * z * (1 - z)
    by_c = (1 - z) * (1 - c * c)
    by_r = keep["passed"] * r * (1 - r)
    into = np.empty((len(ids), 3 * n, ids.shape[1]), kind)
    through = np.empty_like(into)
    begins, dh = fresh.any(axis=1), np.zeros((n, ids.shape[1]), kind)
    for t in range(len(ids) - 1, -1, -1):
        dc = into[t, 2 * n :]
        np.multiply(dh, by_c[t], out=dc)
        np.multiply(dh, by_z[t], out=into[t, :n])
        np.multiply(dc, by_r[t], out=into[t, n : 2 * n])
        through[t, : 2 * n] = into[t, : 2 * n]
        np.multiply(dc, r[t], out=through[t, 2 * n :])
        dh *= z[t]
        dh += p["u"] @ through[t]
        dh += back[:, t]
        if begins[t]:
            dh *= ~fresh[t]
    g["u"] = flat @ _by_unit(through).T
    order = np.argsort(tokens.astype(np.int16), kind="stable")
    starts = np.flatnonzero(np.diff(tokens[order], prepend=-1))
    rows = into.transpose(0, 2, 1).reshape(-1, 3 * n)[order]
    g["x"][tokens[order][starts]] = np.add.reduceat(rows, starts, axis=0)
    return {k: g[k] for k in p}, last


def _flat(arrays: dict) -> np.ndarray:
    return np.concatenate([v.ravel() for v in arrays.values()])


def _views(flat: np.ndarray, like: dict) -> dict[str, np.ndarray]:
    """Parts of ``flat`` with the names and shapes of ``like``."""
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


class _Adam:
    """Steps of all weights, which lie in one vector."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.m, self.v, self.n = flat, np.zeros_like(flat), np.zeros_like(flat), 0

    def update(self, g: np.ndarray) -> None:
        self.n += 1
        self.m *= 0.9
        self.m += 0.1 * g
        self.v *= 0.99
        step = g * g
        step *= 0.01
        self.v += step
        np.sqrt(self.v, out=step)
        step *= 1 / math.sqrt(1 - 0.99**self.n)
        step += 1e-6
        np.divide(self.m, step, out=step)
        step *= STEP / (1 - 0.9**self.n)
        self.flat -= step


def windows(texts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """All tokens of the texts, which run side by side in slots, one behind the other: the slots
    in use and, as (time, slot), the next tokens, which of them are real and which begin a text.
    When no more texts come, windows get longer as slots get fewer, so as to hold ``FEWEST``."""
    left = [np.zeros(0, np.int32)] * SIDE_BY_SIDE
    live, span = list(range(SIDE_BY_SIDE)), WINDOW
    while live:
        ids = np.zeros((len(live), span), np.int64)
        real, fresh = np.zeros(ids.shape, bool), np.zeros(ids.shape, bool)
        ended = False
        for i, s in enumerate(live):
            at, rest = 0, left[s]
            while at < span:
                if not len(rest):
                    rest = None if ended else next(texts, None)
                    if rest is None:
                        rest, ended = left[s][:0], True
                        break
                    fresh[i, at] = True
                n = min(span - at, len(rest))
                ids[i, at : at + n], real[i, at : at + n] = rest[:n], True
                at, rest = at + n, rest[n:]
            left[s] = rest
        used = np.flatnonzero(real[:, 0])
        if len(used):
            yield np.array(live)[used], ids[used].T, real[used].T, fresh[used].T
        if ended:
            live = [s for s in live if len(left[s])]
            span = max(WINDOW, -(-FEWEST // max(1, len(live))))


def _trained(shared):
    """Trains a copy of the weights on a partition's texts, once; a row of all weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = _flat(shared.value)
        p, adam, seen = _views(flat, shared.value), _Adam(flat), 0
        state = np.zeros((SIDE_BY_SIDE, HIDDEN), np.float32)
        texts = (x.values.to_numpy() for batch in batches for x in batch.column("ids"))
        held, tokens = None, 0
        for used, ids, real, fresh in windows(texts):
            g, state[used] = gradients(p, state[used], ids, real, fresh)
            g, n = _flat(g), int(real.sum())
            seen += n
            # near the end windows may hold few tokens: they make a step together
            if held is None and n >= FEWEST:
                adam.update(g)
                continue
            held, tokens = n * g + (0 if held is None else held), tokens + n
            if tokens >= FEWEST:
                adam.update(held / np.float32(tokens))
                held, tokens = None, 0
        if tokens:
            adam.update(held / np.float32(tokens))
        if seen:
            flat = flat.astype(float)
            for at in range(0, len(flat), 4096):
                values = flat[at : at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(at, at + len(values)), pa.int64()),
                        pa.array(values * seen),
                        pa.array([seen] * len(values), pa.int64()),
                    ],
                    names=["place", "value", "seen"],
                )

    return run


def _averaged(texts: DataFrame, p: dict) -> dict[str, np.ndarray]:
    """One round: the mean of the tasks' weights, by tokens seen. A row for each weight."""
    shared = texts.sparkSession.sparkContext.broadcast(p)
    rows = (
        texts.mapInArrow(_trained(shared), "place long, value double, seen long")
        .groupBy("place")
        .agg((F.sum("value") / F.sum("seen")).alias("value"))
        .toPandas()
        .sort_values("place")
    )
    if not len(rows):
        return p
    return _views(rows["value"].to_numpy(np.float32), p)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts, merged within a batch."""
    for batch in batches:
        sums: Counter[str] = Counter()
        for text in batch.column("text"):
            sums.update(lower_words(text.as_py()))
            sums[END] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())],
            names=["word", "n"],
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column("word").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("word"),
                batch.column("c"),
                pa.array([word_hash(w) for w in found], pa.int64()),
                pa.array([spelled(w) for w in found], pa.int32()),
            ],
            names=["word", "c", "h", "s"],
        )


def _coded(frequent: list[str]):
    """The input ids of all tokens of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(frequent)
        for batch in batches:
            texts = []
            for text in batch.column("text"):
                found = lower_words(text.as_py())
                found.append(END)
                texts.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
            ends = np.cumsum([0, *map(len, texts)])
            flat = np.concatenate(texts) if texts else np.zeros(0, np.int32)
            ids = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("round"), ids.cast(pa.list_(pa.int32()))], names=["round", "ids"]
            )

    return run


def _slots(lengths: np.ndarray) -> list[list[int]]:
    """Texts dealt to slots of about equal length, the longest first."""
    import heapq

    heap = [(0, s) for s in range(min(SLOTS, len(lengths)))]
    dealt: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-lengths, kind="stable"):
        held, s = heapq.heappop(heap)
        dealt[s].append(int(i))
        heapq.heappush(heap, (held + int(lengths[i]), s))
    return dealt


def texts_log_likelihood(p: dict, texts: list[np.ndarray]) -> np.ndarray:
    """The sum of each text's tokens' log-likelihoods; texts run side by side in slots, one
    behind the other, each from a state of zeros.

    The fullest slots come first, and a span of time runs only those that still have tokens. So
    work and memory follow the tokens, however long one text is beside the others.
    """
    lengths = np.array([len(x) for x in texts], np.int64)
    dealt = sorted(_slots(lengths), key=lambda d: -int(lengths[d].sum()))
    lines = [np.concatenate([texts[i] for i in d]) for d in dealt]
    # which text each of a slot's tokens belongs to, and which of them begin one
    owners = [np.repeat(np.array(d, np.int32), lengths[d]) for d in dealt]
    begins = [np.diff(own, prepend=-1) != 0 for own in owners]
    sizes = np.array([len(x) for x in lines], np.int64)
    sums = np.zeros(len(texts) + 1)
    h = np.zeros((len(dealt), HIDDEN), np.float32)
    for t in range(0, int(sizes.max(initial=0)), SPAN):
        live = int(np.searchsorted(-sizes, -t))
        part = np.zeros((live, SPAN), np.int32)
        of = np.full(part.shape, len(texts), np.int32)
        fresh = np.zeros(part.shape, bool)
        for s in range(live):
            n = min(SPAN, int(sizes[s]) - t)
            part[s, :n] = lines[s][t : t + n]
            of[s, :n] = owners[s][t : t + n]
            fresh[s, :n] = begins[s][t : t + n]
        used = min(SPAN, int(sizes[0]) - t)
        part, of, fresh = part.T[:used], of.T[:used], fresh.T[:used]
        states, h = _run(p, h[:live], part, fresh)
        found = _logs(p, _by_unit(states.transpose(0, 2, 1)), part.ravel())
        sums += np.bincount(of.ravel(), found, len(sums))
    return sums[:-1]


def _scored(shared):
    """Per text: sums over its tokens, and the words whose counts aren't at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, frequent, counts, others, part = *shared.value, TaskContext.get().partitionId()
        vocabulary, row, known = Vocabulary(frequent), part << 40, Known([*counts])
        # by place, with a row for the words that aren't at hand behind them
        logs = np.array([*(math.log10(c + 0.5) for c in counts.values()), 0.0])
        inputs = np.array([*(vocabulary[w] for w in counts), 0], np.int32)
        for batch in batches:
            texts, firsts = [], []
            for text in batch.column("text"):
                tokens = lower_words(text.as_py())
                tokens.append(END)
                known.rest = []
                places = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
                ids = inputs[places]
                ids[places < 0] = [vocabulary[w] for w in known.rest]
                inside = ids > WORDS
                found = logs[places]
                # words by spelling: their counts' logs at hand, less their classes'
                own = found[inside].sum() - others[ids[inside] - WORDS - 1].sum()
                texts.append(ids)
                firsts.append((len(tokens), found.sum(), own, Counter(known.rest)))
            found = texts_log_likelihood(p, texts) / math.log(10)
            columns = {
                "row": pa.array(range(row, row + len(texts)), pa.int64()),
                "id": batch.column("id"),
                "n_tokens": pa.array([x[0] for x in firsts], pa.int64()),
                "base": pa.array([float(x[1]) for x in firsts]),
                "score": pa.array(found + np.array([float(x[2]) for x in firsts])),
                "rest": pa.array(
                    [[{"h": word_hash(w), "n": n} for w, n in x[3].items()] for x in firsts],
                    pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])),
                ),
            }
            row += len(texts)
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    return run


def scored(
    documents: DataFrame, teaches: Column, *, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every
    document. ``teaches`` is a condition over the column ``id``: such rows are learned from."""
    spark = documents.sparkSession
    docs = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    training = docs.filter(F.col("id").isNotNull() & teaches).select("text")
    counts = (
        training.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))
    )
    counts = written(counts.mapInArrow(_hashed, "word string, c long, h long, s int"), "words")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = greatest(counts, F.col("c"), COUNTED).select("word", "c").toPandas()
    top = top.sort_values(["c", "word"], ascending=[False, True])
    known = dict(zip(top["word"], map(int, top["c"]), strict=True))
    frequent = [w for w in known if w != END][:WORDS] + [END]
    # the sums of the spelling classes, without the frequent words
    sums = {r["s"]: r for r in counts.groupBy("s").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    tokens = np.array([sums[s]["c"] if s in sums else 0 for s in range(SPELLED)], float)
    types = np.array([sums[s]["n"] if s in sums else 0 for s in range(SPELLED)], float)
    for w in frequent:
        if w in known:
            tokens[spelled(w)] -= known[w]
            types[spelled(w)] -= 1
    frequent_counts = np.array([known.get(w, 0) for w in frequent], float)

    padded = frequent[:-1] + [f"\n{i}" for i in range(WORDS + 1 - len(frequent))] + [END]
    own = np.zeros(WORDS + 1)
    own[: len(frequent) - 1], own[-1] = frequent_counts[:-1], frequent_counts[-1]
    weights = start(own, tokens)
    dealt = training.select(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)).cast("int").alias("round"), "text")
    coded = written(dealt.mapInArrow(_coded(padded), "round int, ids array<int>"), "coded")
    for k in range(ROUNDS):
        weights = _averaged(coded.filter(F.col("round") == k).select("ids"), weights)
    others = np.log10(tokens + 0.5 * (types + 1))
    shared = spark.sparkContext.broadcast((weights, padded, known, others))
    found = written(
        docs.mapInArrow(
            _scored(shared),
            "row long, id long, n_tokens long, base double, score double, "
            "rest array<struct<h: long, n: long>>",
        ),
        "scores",
    )
    rest = (
        found.select("row", F.explode("rest").alias("x"))
        .select("row", "x.h", "x.n")
        .join(counts.select("h", "c"), "h", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"),
            F.sum(F.when(F.col("c").isNull(), F.col("n")).otherwise(0)).alias("unknown"),
        )
    )
    logs = F.coalesce("logs", F.lit(0.0))
    spread = math.log10(total + 0.5 * (kinds + 1))
    return found.drop("rest").join(rest, "row", "left").select(
        "id",
        "n_tokens",
        (F.col("n_tokens") - F.coalesce("unknown", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
