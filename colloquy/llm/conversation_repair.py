"""Cheapest repair of damaged conversations, by a run-length dynamic programme.

A conversation's rows, by turn, become symbols of role and fault. ``s`` is a system row, ``u`` a
user row, ``a`` an assistant row; a good conversation reads ``(s?(ua)+)?``. Each row is kept (K,
0), given role user or assistant (R, 1) or deleted (D, 2; a must for blank and duplicate rows),
empty user or assistant rows may be inserted anywhere (I, 5), and a truncated row that stays costs
5 more. Of the cheapest sequences of edits the least in ASCII order is taken.

A row's symbol is a matrix over the states *nothing yet, after s, after u, after a*, whose entries
are the cheapest ``(cost, edits)``; matrices multiply by min-plus, edits by joining. Insertions
belong to the row behind them, so edits for the same number of rows never begin each other and
the order of sums stays that of their parts. Equal consecutive symbols are one run, which is
crossed by cached binary powers of its matrix: backwards with costs alone, then forwards to unroll
the edits.

Spark finds faults and deals out the work: texts are narrowed to digests for the search of earlier
equal rows (an aggregate that merges before its shuffle), and each text is shuffled once, as a row
that follows its conversation's narrow rows in one sorted stream. A task holds runs and edits of
one conversation and one text at a time, so a conversation of any length passes through bounded
memory besides its own audit; SHA-256 of its text is one sequential stream by definition.

Defined cases: nulls in role and text are one space, as are null ids and turns where they are
spelled for the checksum; null ids are one conversation; rows of one turn (or without one) are
taken by role, then text; repeated rows are duplicates; roles other than those three, the empty
one included, can't be kept unless they begin alike; a gap count that no long can hold is the
largest long; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import SPACES, likely_in

EVERY = 20
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, S, U, A = range(4)
NEXT = (U, U, A, U)
ROLE = {U: "user", A: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Longest power of a matrix that is remembered, in rows; longer runs take it again and again.
LONGEST = 4_096
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

Best = tuple[int, str] | None
#: A symbol: first character of the role, must go, truncated.
Symbol = tuple[str, bool, bool]


def _least(options: list[tuple[int, int, str]]) -> list[Best]:
    out: list[Best] = [None] * 4
    for to, cost, edits in options:
        if out[to] is None or (cost, edits) < out[to]:
            out[to] = (cost, edits)
    return out


def _row_edits(symbol: Symbol, state: int) -> list[tuple[int, int, str]]:
    """(state behind, cost, edit) of what can be done with one row."""
    initial, must_go, truncated = symbol
    found = [(state, DELETE, "D")]
    if not must_go:
        extra = TRUNCATED if truncated else 0
        found.append((NEXT[state], REROLE + extra, "R"))
        if initial == "s" and state == START:
            found.append((S, extra, "K"))
        if initial == "u" and NEXT[state] == U or initial == "a" and NEXT[state] == A:
            found.append((NEXT[state], extra, "K"))
    return found


def _joined(a: list[list[Best]], b: list[list[Best]]) -> list[list[Best]]:
    return [
        _least(
            [
                (to, x[0] + y[0], x[1] + y[1])
                for x, row in zip(line, b, strict=True)
                if x is not None
                for to, y in enumerate(row)
                if y is not None
            ]
        )
        for line in a
    ]


@cache
def power(symbol: Symbol, k: int) -> list[list[Best]]:
    """The matrix of 2 ** k equal rows."""
    if k:
        return _joined(power(symbol, k - 1), power(symbol, k - 1))
    return [
        _least(
            _row_edits(symbol, state)
            + [
                (to, INSERT + cost, "I" + edit)
                for to, cost, edit in _row_edits(symbol, NEXT[state])
            ]
        )
        for state in range(4)
    ]


def _parts(length: int) -> Iterator[int]:
    """Exponents of the powers of two that a run is made of."""
    top = LONGEST.bit_length() - 1
    while length >= LONGEST:
        yield top
        length -= LONGEST
    for k in range(top - 1, -1, -1):
        if length >> k & 1:
            yield k


def repair(runs: list[tuple[Symbol, int]]) -> tuple[int, list[str]]:
    """Cost and edits (joined: the audit) of the cheapest repair."""
    never = float("inf")
    rest = [0, 2 * INSERT, INSERT, 0]
    behind = [rest]
    for symbol, length in reversed(runs):
        for k in _parts(length):
            rest = [
                min((x[0] + r for x, r in zip(row, rest, strict=True) if x is not None), default=never)
                for row in power(symbol, k)
            ]
        behind.append(rest)
    state, cost, edits = START, int(rest[START]), []
    for (symbol, length), rest in zip(runs, behind[-2::-1], strict=True):
        at: list[list[Best]] = [[(0, "") if s == state else None for s in range(4)]]
        for k in _parts(length):
            at = _joined(at, power(symbol, k))
        _, found, state = min(
            (x[0] + r, x[1], to) for to, (x, r) in enumerate(zip(at[0], rest, strict=True)) if x
        )
        edits.append(found)
    edits.append({START: "", S: "II", U: "I", A: ""}[state])
    return cost, edits


class Conversation:
    """One conversation of the sorted stream: narrow rows first, texts behind them."""

    def __init__(self):
        self.counts = dict.fromkeys(COUNTS, 0)
        self.runs: list[list] = []
        self.copies, self.blanks = array("q"), bytearray()
        self.last: tuple | None = None
        self.initial: str | None = None
        self.first_turn = self.last_turn = None
        self.turns = 0
        self.hash, self.empty = hashlib.sha256(), True
        self.edits: Iterator[str] | None = None

    def _symbol(self, symbol: Symbol, length: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += length
        elif length:
            self.runs.append([symbol, length])

    def narrow(self, turn, role: str, blank: bool, cut: bool, later: bool, n: int) -> None:
        """``n`` equal rows, in order."""
        if not n:
            return
        counts, initial = self.counts, role[:1]
        if turn is not None and (self.last_turn is None or turn != self.last_turn):
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.initial is not None:
            counts["illegal"] += self.initial + initial not in LEGAL
        counts["illegal"] += (n - 1) * (initial + initial not in LEGAL)
        self.initial = initial
        copies = n - 1
        if blank:
            counts["blank"] += n
        else:
            counts["duplicate"] += n if later else copies
            counts["truncated"] += cut and not later
        if blank or later:
            self._symbol(("", True, False), n)
        else:
            self._symbol((initial if initial in "sua" else "", False, cut), 1)
            self._symbol(("", True, False), copies)
        self.copies.append(n)
        self.blanks.append(blank)

    def repaired(self) -> None:
        """Ends the narrow rows: finds the edits."""
        cost, edits = repair([tuple(r) for r in self.runs])
        self.counts["cost"] = cost
        if self.turns:
            gaps = self.last_turn - self.first_turn + 1 - self.turns
            self.counts["gaps"] = min(gaps, (1 << 63) - 1)
        self.audit = "".join(edits)
        self.edits, self.state, self.at = iter(self.audit), START, 0

    def _line(self, role: str, text: str) -> None:
        self.hash.update((f"{role}:{text}" if self.empty else f"\n{role}:{text}").encode())
        self.empty = False

    def _take(self, role: str = "", text: str = "") -> None:
        """Follows the edits of one row."""
        for edit in self.edits:
            if edit == "D":
                return
            keep_system = edit == "K" and role[:1] == "s"
            self.state = S if keep_system else NEXT[self.state]
            if edit == "I":
                self._line(ROLE[self.state], "")
                continue
            self._line(role if edit == "K" else ROLE[self.state], text)
            return

    def _skip(self) -> None:
        while self.at < len(self.copies) and self.blanks[self.at]:
            for _ in range(self.copies[self.at]):
                self._take()
            self.at += 1

    def text(self, key: tuple, role: str, text: str) -> None:
        """The next row that isn't blank; its copies follow it and are passed over."""
        if self.edits is None:
            self.repaired()
        if key == self.last:
            return
        self.last = key
        self._skip()
        self._take(role, text)
        for _ in range(self.copies[self.at] - 1):
            self._take()
        self.at += 1

    def result(self) -> tuple:
        if self.edits is None:
            self.repaired()
        self._skip()
        self._take()  # insertions at the end
        return (*self.counts.values(), self.audit, self.hash.hexdigest())


def _repaired(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, kind = None, None, pa.int64()
        done: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            kind = batch.column(0).type
            lists = [c.to_pylist() for c in batch.columns]
            for own, rows in groupby(zip(*lists, strict=True), key=lambda r: r[0]):
                if now is None or own != conv:
                    if now is not None:
                        done.append((conv, *now.result()))
                    now, conv = Conversation(), own
                for _, phase, turn, role, _, digest, blank, cut, later, n, text in rows:
                    if phase == 0:
                        now.narrow(turn, role, blank, cut, later, n)
                    else:
                        now.text((turn, role, digest), role, text)
            if done:
                yield batch_of()
        if now is not None:
            done.append((conv, *now.result()))
            yield batch_of()

    return run


def damaged(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text, copies``: each row with what happened to it (0 copies: dropped)."""
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)]
    at = F.crc32(F.concat_ws(":", *spelled)) % EVERY
    given = F.coalesce(F.col(text), F.lit(" "))
    return conversations.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.when(at == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" "))).alias("role"),
        F.when(at == 1, "").when(at == 2, F.translate(given, ".!?", "")).otherwise(given).alias("text"),
        F.when(at == 0, 0).when(at == 3, 2).otherwise(1).alias("copies"),
    )


def _blank(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")) == 0


def repaired(
    rows: DataFrame, *, conv: str = "conv", turn: str = "turn", role: str = "role", text: str = "text",
    copies: str = "copies",
) -> DataFrame:
    """``conv_id``, the counts, ``audit`` and ``repaired_sha256`` of every conversation in ``rows``.

    ``copies`` says how many times a row stands there; conversations of rows with 0 copies appear.
    """
    spark = rows.sparkSession
    rows = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
        F.col(text).alias("text"), F.col(copies).cast("long").alias("n"),
    )
    # texts order rows of one turn only, and go along only there
    at = F.xxhash64("conv", "turn")
    shared = rows.filter("n > 0").groupBy(at.alias("at")).count().filter("count > 1")
    tie = F.when(likely_in(shared, "at", at), F.col("text"))
    rows = rows.select("*", tie.alias("tie"), F.unhex(F.md5("text")).alias("digest"), _blank(F.col("text")).alias("blank"))
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    narrow = (
        rows.select("conv", "turn", "role", "tie", "digest", "blank", (~last.isin(*".!?")).alias("cut"), "n")
        .groupBy("conv", "turn", "role", "tie", "digest", "blank", "cut")
        .agg(F.sum("n").alias("n"))
    )
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"))
    repeated = (
        narrow.filter("n > 0 AND NOT blank")
        .groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
        .agg(F.min(place).alias("first"), F.count("*").alias("places"))
        .filter("places > 1")
    )
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    narrow = narrow.join(repeated, same, "left").select(
        "conv", F.lit(0).alias("phase"), "turn", "role", "tie", "digest", "blank", "cut",
        F.coalesce(place > F.col("first"), F.lit(False)).alias("later"), "n", F.lit(None).cast("string").alias("text"),
    )
    texts = rows.filter("n > 0 AND NOT blank").select(
        "conv", F.lit(1).alias("phase"), "turn", "role", "tie", "digest", "blank", F.lit(False).alias("cut"),
        F.lit(False).alias("later"), "n", "text",
    )
    stream = (
        narrow.unionByName(texts)
        .repartition("conv")
        .sortWithinPartitions("conv", "phase", F.asc_nulls_first("turn"), "role", "tie", "digest")
    )
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    schema = StructType(
        [StructField("conv_id", rows.schema["conv"].dataType)]
        + [StructField(c, LongType()) for c in COUNTS]
        + [StructField(c, StringType()) for c in names[-2:]]
    )
    return stream.mapInArrow(_repaired(names), schema)
