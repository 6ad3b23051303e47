"""Chunks and pieces of a text as the word-level BPE vocabulary file defines them.

The file's normaliser (NFC, white space to one blank, lower case) and its splitter never join
characters across white space, so a text is the sequence of its chunks between white space and each
chunk can be encoded by itself. Chunks repeat, so encoders keep what they found for them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from sys import getsizeof

import regex

# Fixed values of the vocabulary file: white space, splitter pattern, special strings.
WHITE_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
PIECE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE_SPACE}\p{{L}}\p{{N}}]+"

_SPACES = re.compile(f"[{WHITE_SPACE}]+")
_PIECES = regex.compile(PIECE_PATTERN)
_SIGNS = (".", ",", ";", ":", "!", "?")
# str.split() also cuts at these four, which the file does not count as white space.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")

# The last character that Python and the library treat alike. Beyond, their Unicode versions differ.
_LAST_PLAIN = "\u052f"

# Bytes that an encoder keeps before it starts anew. A worker that goes on to other work may be told to forget.
KEPT_BYTES = 120_000_000
#: What a dictionary needs for an entry besides key and value, about.
_ENTRY_BYTES = 100


def chunks(text: str) -> list[str]:
    """Stretches between white space."""
    if any(s in text for s in _SEPARATORS):
        return [c for c in _SPACES.split(text) if c]
    return text.split()


def plain(special: Iterable[str]) -> Callable[[str], bool]:
    """Whether a chunk can be split by ``pieces``: no special string, no character beyond ``_LAST_PLAIN``."""
    found = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)").search
    return lambda chunk: (chunk.isascii() or max(chunk) <= _LAST_PLAIN) and found(chunk) is None


def normalized(chunk: str) -> str:
    """NFC and lower case, character by character (a final capital sigma is no exception)."""
    if chunk.isascii():
        return chunk.lower()
    return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()


def pieces(chunk: str) -> list[str]:
    """What the splitter keeps of a chunk without special strings."""
    text = normalized(chunk)
    # The two commonest forms need no pattern: a word, and a word with a sign at its end.
    if text.isalpha():
        return [text]
    if text[-1:] in _SIGNS and text[:-1].isalpha():
        return [text[:-1], text[-1]]
    return _PIECES.findall(text)


class Kept(dict):
    """Results per key, made when first asked for; emptied when they hold ``most`` bytes."""

    def __init__(self, make: Callable, most: int = KEPT_BYTES):
        super().__init__()
        self._make = make
        self._most = most
        self._held = 0

    def __missing__(self, key):
        value = self._make(key)
        self._held += getsizeof(key) + getsizeof(value) + _ENTRY_BYTES
        if self._held >= self._most:
            self.clear()
            self._held = 0
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self._held = 0


def special_parts(chunk: str, special: dict[str, int]) -> Iterator[tuple[str, int | None]]:
    """Cuts a chunk at special strings: (text, None) and (string, id) in order."""
    if not special:
        yield chunk, None
        return
    for part in re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", chunk):
        if part:
            yield part, special.get(part)
