"""Token ids of whole texts, through the tokenizers library with word caches.

Byte-pair merging of rare words dominates the cost of tokenizing, and most
words are common.  Neither tokenizer used here merges across the start of a
white-space delimited word, so a text's ids are its words' ids one after
another, and each task process remembers the ids of words it has met.  A word
of Latin letters with punctuation behind it is remembered by its two parts,
which are never merged either.  Texts with unusual white space, for which this
does not hold, go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import cache

#: Words, and parts of words, after which those go that were not met again since the last time; some 200 bytes each,
#: and at most twice as many are held.
REMEMBERED, PARTS = 400_000, 400_000
#: Latin letters that lower-case one to one, then punctuation that starts no contraction.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85]")
PLAIN_WORD = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,!?;:|#$%&*]*)")


@cache
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: printable ones are themselves, the rest follow from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)}


BYTE_LETTERS = _byte_letters()


class Remembered(dict):
    """What ``learn`` says of a key, asked when the key is first met and not while it is remembered."""

    def __init__(self, learn: Callable[[str], bytes | None]) -> None:
        self.learn = learn
        self.before: dict[str, bytes | None] = {}

    def __missing__(self, key: str) -> bytes | None:
        ids = self[key] = self.before[key] if key in self.before else self.learn(key)
        return ids

    def forget(self, most: int) -> None:
        """If there are more than ``most``, drop what was not met since the last time."""
        if len(self) > most:
            self.before = dict(self)
            self.clear()


class Encoder:
    """Little-endian unsigned 32-bit ids of texts.

    A ``spaced`` tokenizer keeps case and the space before a word as part of it;
    the other kind drops white space and case.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        self.path, self.spaced = path, spaced
        self.model = _library(path).model
        #: None for words that tell of white space over which ids may join.
        self.words = Remembered(self._word)
        self.parts = Remembered(self._part)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in _library(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def _part(self, part: str) -> bytes:
        letters = part.replace(" ", BYTE_LETTERS[32]) if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes | None:
        if plain := PLAIN_WORD.fullmatch(word):
            letters, behind = plain.groups()
            ids = self.parts[letters if self.spaced else letters.lower()]
            return ids + self.parts[behind] if behind else ids
        if ODD_SPACE.search(word):
            return None
        # A line's end stands by itself, as the lines beside it neither end nor begin with white space that is no word's.
        if self.spaced and word != "\n" and (not word.strip(" ") or word[1:2].isspace() or word[-1].isspace()):
            return None
        return self.whole([word])[0]

    def _split(self, text: str) -> list[str]:
        if not self.spaced:
            return ["\x1c"] if ODD_SPACE.search(text) else text.split()
        # The mark between words is odd space itself.
        return ["\x1c"] if "\x1d" in text else text.replace(" ", "\x1d ").replace("\n", "\x1d\n\x1d").split("\x1d")

    def encode(self, texts: list[str]) -> list[bytes]:
        self.words.forget(REMEMBERED)
        self.parts.forget(PARTS)
        out: list[bytes | None] = []
        for text in texts:
            try:
                out.append(b"".join(map(self.words.__getitem__, self._split(text))))
            except TypeError:
                out.append(None)
        odd = iter(self.whole([t for t, ids in zip(texts, out, strict=True) if ids is None]))
        return [next(odd) if ids is None else ids for ids in out]


@cache
def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for each tokenizer and process, so that tasks share what it remembers."""
    return Encoder(path, spaced)
