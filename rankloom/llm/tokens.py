"""Token ids of whole texts with the tokenizers library, at the speed of a lookup per word.

Both tokenizers split a text into pieces and encode each piece by itself.  Texts of Latin letters
below U+0250 are split here by the same rule; the library's model encodes each new piece once per
Python worker.  Other texts, and texts that hold an added token of the vocabulary such as
``<|endoftext|>``, go to the library whole.  Tests hold both ways against each other.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
_BYTE_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
                          rf"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_WORD_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
#: Where NFC changes nothing, lower case is one character, and the classes above are complete.
_LATIN = re.compile("[\x00-\x1b\x20-ĩĲ-ɏ]*")
#: White space other than single blanks and line feeds between words.
_LOOSE = ("  ", "\n\n", " \n", "\n ", "\t", "\x0b", "\x0c", "\r", "\x85", "\xa0")

#: Entries that one worker keeps: whole words, and pieces.
MAX_WORDS, MAX_PIECES = 800_000, 700_000


def _byte_signs() -> dict[int, str]:
    """The visible sign that byte-level models use for each byte: itself where printable, else the next from U+0100 on."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


class _Kept(dict):
    """A dictionary that computes what it lacks and keeps it up to a bound."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) < self.most:
            self[key] = value
        return value


class Encoder:
    """Encodes whole texts to the library's ids as little-endian unsigned 16-bit numbers."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not t.normalized]
        self.normalizer = self.library.normalizer
        self.folded = [self._normal(t.content) for t in added if t.normalized]
        self.spaced = "Sequence" not in type(self.library.pre_tokenizer).__name__
        signs, model = _byte_signs(), self.library.model
        pieces = _BYTE_PIECES if self.spaced else _WORD_PIECES

        def piece(text: str) -> bytes:
            return np.array([t.id for t in model.tokenize(text.encode().decode("latin-1").translate(signs))], "<u2").tobytes()

        known = _Kept(piece, MAX_PIECES).__getitem__

        def unit(word: str) -> bytes:
            if not self.spaced:
                word = word.lower()
            elif word[:1] != "\n":
                word = " " + word
            return b"".join(map(known, pieces.findall(word)))

        self.unit = _Kept(unit, MAX_WORDS).__getitem__
        self.whole = lambda text: b"".join(map(known, pieces.findall(text)))

    def _normal(self, text: str) -> str:
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def _holds_added(self, text: str) -> bool:
        """Whether the library may find an added token: as it stands, or in the normalized text."""
        if any(token in text for token in self.added):
            return True
        return bool(self.folded) and any(map(self._normal(text).__contains__, self.folded))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not _LATIN.fullmatch(text) or self._holds_added(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if not self.spaced:
            return b"".join(map(self.unit, text.split()))
        if any(mark in text for mark in _LOOSE) or text[0] in " \n" or text[-1] in " \n":
            return self.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.whole(first) + b"".join(map(self.unit, rest))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker; ids must fit 16 bits."""
    made = Encoder(path)
    if made.library.get_vocab_size() > 1 << 16:
        raise ValueError("ids of this vocabulary need more than 16 bits")
    return made
