"""Exact byte-level BPE encoding, one unit at a time.

The tokenizers library finds pre-tokens by a pattern none of whose matches
crosses from a character that isn't white space to one that is.  A text can
therefore be cut before a blank or line end that follows other than white
space: the ids of the pieces, one after the other, are those of the whole.
Such units recur all the time, so that each worker encodes a unit by the
library when it first meets it and looks it up from then on.
"""

from __future__ import annotations

import functools
import os
import re

from .common import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MAX_UNITS = 500_000        # units of a generation; at most two generations are held
_UNSAFE = re.compile(r"\s[ \n]")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_MARKS = ".,!?;:"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte as itself where Latin-1 prints it, and the
    others as the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(0x100 + i) for i, b in enumerate(rest)}}


class UnitEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, max_units: int = MAX_UNITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._units = _Units(self.tokenizer, max_units)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _UNSAFE.search(text):
            return b"".join([self._units.ids(u) for u in _CUT.split(text)])
        # blanks cut safely here, and line ends once a blank stands before them
        parts = text.replace("\n", " \n").split(" ")
        first = self._units.ids(parts[0]) if parts[0] else b""
        del parts[0]
        return first + b"".join(map(self._units.__getitem__, parts))

    @functools.cached_property
    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for."""
        back = {c: b for b, c in _byte_letters().items()}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        table = [b""] * self.tokenizer.get_vocab_size()
        for tok, i in self.tokenizer.get_vocab().items():
            table[i] = tok.encode() if tok in special else bytes(back[c] for c in tok)
        return table

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Units(dict):
    """Unit -> ids.  A unit stands without the blank before it; one that begins
    with a line end has none.  Two generations bound the memory: a full one
    becomes the old one, from which units that recur are taken over."""

    def __init__(self, tokenizer, max_units: int):
        self.tokenizer, self.model, self.max_units = tokenizer, tokenizer.model, max_units
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}      # runs of marks behind a word
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def ids(self, text: str) -> bytes:
        """Ids of a text by the library alone."""
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.max_units:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self._new(key)
        if len(key) <= 64:
            self[key] = found
        return found

    def _new(self, key: str) -> bytes:
        body = key.rstrip(_MARKS)
        if body and body[-1].isalpha() and body[-1] < "ɐ":
            # a pre-token ends between a letter and these marks
            if body != key:
                tail = key[len(body):]
                if (after := self.marks.get(tail)) is None:
                    after = self.ids(tail)
                    if len(tail) <= 4:
                        self.marks[tail] = after
                return self[body] + after
            if body.isalpha() and max(body) < "ɐ":
                word = " " + body
                return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(
                    word.encode().decode("latin-1").translate(self.letters))])
        return self.ids(key if key[:1] == "\n" else " " + key)


def unit_encoder(path: str, max_units: int = MAX_UNITS) -> UnitEncoder:
    """One encoder in each worker process."""
    return kept("bpe-units", (path, max_units), lambda: UnitEncoder(path, max_units))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file of this name is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
