"""Token ids of whole texts, equal to the public tokenizer's, by a cache over pieces.

The tokenizer drops white space and never joins across it, so a text's ids are
its words' ids in order.  A text of plain printable characters is lower-cased
and split by the tokenizer's own pattern, and its pieces go to the BPE model
directly.  Where other characters stand in it, it is taken word by word, and
its words with such characters go through the tokenizer itself; so does a text
that names a special token.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np
import regex

from halyard.llm.shared import FORGOTTEN

#: The tokenizer's split pattern, as its file states it.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\x21-\x7eÀ-ſ]+")
#: What a plain text does not hold, and the pattern for lower-cased plain texts.
_OTHER = re.compile(r"[^\t-\r\x20-\x7eÀ-ſ]")
_PIECES = re.compile(r"[a-zß-öø-ſ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\sa-z0-9ß-öø-ſ]+")
#: Python splits at these, the tokenizer does not.
_ODD = regex.compile("[\x1c-\x1f]")
_MOST = 120_000
_PIECE = 1 << 20


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Recent(dict):
    """A memo of ``make`` that keeps what was used since the last but one time that it was full."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= _MOST:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words = _Recent(self._word)
        self.pieces = _Recent(self._model)

    def _model(self, piece: str) -> bytes:
        form = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        ids = [t.id for t in self.model.tokenize(form)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                return self.pieces[word.lower()]
            if not word.isprintable():
                return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        elif not _PLAIN.fullmatch(word):
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self.pieces[p] for p in _SPLIT.findall(word.lower())])

    def _piece(self, text: str) -> bytes:
        if _OTHER.search(text):
            return b"".join(map(self.words.__getitem__, text.split()))
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers; none for null."""
        if not text:
            return b""
        if _ODD.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > _PIECE:
                ends = [e for e in (text.find(c, at + _PIECE) for c in " \n") if e >= 0]
                end = min(ends, default=end)
            out.append(self._piece(text[at:end]))
            at = end
        return b"".join(out)


_LOADED: dict[str, WordTokenizer] = {}
FORGOTTEN.append(_LOADED.clear)


def tokenizer(path: str) -> WordTokenizer:
    """One for each process, kept between tasks that follow each other."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
