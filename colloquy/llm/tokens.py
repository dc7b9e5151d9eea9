"""Token ids of texts by a public tokenizer, inside Spark's tasks."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

END_ID = 0
#: Words whose ids a worker remembers, twice; then it forgets those not used of late. No
#: effect on results.
REMEMBERED = 600_000

#: White space other than spaces and line ends, and what Python or the tokenizer may take for it.
_ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")


#: The byte-level tokenizer's spelling: printable Latin-1 bytes are themselves, the others in
#: order the characters from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELLING = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_MARKS = "!#$%&()*+,-./:;=?@[]^_{}~"


def _spelt(word: str) -> str:
    return word if word.isascii() and word != " " else (
        word.encode().decode("latin-1").translate(_SPELLING)
    )


class _Ids(dict):
    """Ids of words with a leading space, or without, as bytes of 32-bit integers."""

    def __init__(self, tokenizer, lead: str, marks: _Ids | None = None):
        super().__init__()
        self.lead, self.older = lead, {}
        self.whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.merged, self.spelt_lead = tokenizer.model.tokenize, _spelt(lead)
        self.marks = self if marks is None else marks

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            # letters are merged by themselves, and the marks behind them apart
            if word.isalpha():
                ids = array("I", [x.id for x in self.merged(self.spelt_lead + _spelt(word))]).tobytes()
            elif (letters := word.rstrip(_MARKS)) != word and letters.isalpha():
                ids = self[letters] + self.marks[word[len(letters) :]]
            else:
                ids = array("I", self.whole(self.lead + word)).tobytes()
        self[word] = ids
        return ids


class Encoder:
    """Encodes texts as the tokenizer of a file does, without special tokens added.

    The byte-level tokenizer splits a text at white space before it merges, and a single space
    goes with the word behind it. So each word of an evenly spaced text is encoded by itself
    and remembered; other texts go to the tokenizer whole. Ids are the tokenizer's either way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.bare = _Ids(tokenizer, "")
        self.spaced = _Ids(tokenizer, " ", self.bare)
        self.whole = self.bare.whole
        self.line_end, self.end = (array("I", x).tobytes() for x in (self.whole("\n"), [END_ID]))

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text (null: empty) as unsigned 32-bit integers, with the end id."""
        if not text:
            return np.array([END_ID], np.uint32)
        uneven = (
            text[0] in " \n"
            or text[-1] in " \n"
            or any(x in text for x in ("  ", " \n", "\n ", "\n\n", "<|"))
            or _ODD.search(text)
        )
        if uneven:
            return np.array([*self.whole(text), END_ID], np.uint32)
        parts = []
        for line in text.split("\n"):
            first, *others = line.split(" ")
            parts.append(self.bare[first])
            parts.extend(map(self.spaced.__getitem__, others))
            parts.append(self.line_end)
        parts[-1] = self.end
        return np.frombuffer(b"".join(parts), np.uint32)


@lru_cache(maxsize=1)
def kept_encoder(path: str) -> Encoder:
    """The encoder of a file, kept by its Python worker: Spark runs tasks one after another in
    the same worker, and each finds the words remembered that earlier ones met."""
    return Encoder(path)


def public_path(name: str) -> str:
    """The file of a public tokenizer by its name, where that package is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
