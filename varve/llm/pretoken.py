"""Exact pre-tokens of the word-BPE tokenizer, so that their encodings can be remembered.

The tokenizer normalises (NFC, white space, lower case), splits by one pattern, and encodes each
pre-token by itself. For texts made only of characters under U+0250 that these steps treat plainly, the
split is done here and each distinct pre-token is encoded once; any other text goes to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# U+0130 lowers to two characters, one of them a combining mark; controls are left to the library.
_PLAIN = [c for c in map(chr, [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)]) if c not in "İ­"]
_LETTERS = "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == "N")
_ODD_CHAR = re.compile("[^" + "".join(re.escape(c) for c in _PLAIN) + "]")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
_ASCII_ODD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer; each process reads the file once."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def special_strings(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def _byte_alphabet() -> dict[int, str]:
    """Byte-level tokenizers write bytes as characters: printable Latin-1 as itself, the others from U+0100 on in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTES = _byte_alphabet()


#: Characters of a pre-token that is remembered.
LONGEST = 48


class Memo(dict):
    """pre-token -> value(ids): a fixed first tier, then what this worker has met.

    The library's model encodes a pre-token by itself, without the steps around it. Two generations of up to ``bound``
    entries of at most LONGEST characters are remembered: when one is full it becomes the older, and entries that are met again
    move to the younger. Longer pre-tokens are encoded anew each time.
    """

    def __init__(self, path: str, value: Callable, first: dict | None = None, bound: int = 300_000):
        super().__init__()
        self.encode, self.value, self.older, self.first, self.bound = tokenizer(path).model.tokenize, value, {}, first or {}, bound

    def __missing__(self, word: str):
        out = self.older.get(word)
        if out is None:
            out = self.first.get(word)
        if out is None:
            out = self.value([t.id for t in self.encode(word.encode().decode("latin-1").translate(_BYTES))])
        if len(word) > LONGEST:
            return out
        if len(self) >= self.bound:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out


def split(text: str, specials: list[str]) -> list[str] | None:
    """The pre-tokens of ``text``; None where only the library can tell."""
    if text.isascii():
        if _ASCII_ODD.search(text) or any(s in text for s in specials):
            return None
        return _ASCII_SPLIT.findall(text.lower())
    if _ODD_CHAR.search(text) or any(s in text for s in specials):
        return None
    return _SPLIT.findall(text.lower())
