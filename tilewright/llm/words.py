"""Texts as sequences of comparable words: what writing, layout and scanning change is undone."""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np

# Letters of other alphabets that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ғ": "f", "н": "h", "г": "r", "ɡ": "g", "ı": "i", "ո": "n", "ս": "u",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# Characters that take no room.
INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣﻿͏؜᠎"

_OTHER = re.compile(r"[^\x00-\x7f]+")
_BREAK = re.compile(r"(?<=\w)-[ \t\r]*\n\s*(?=\w)")
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_HYPHENS = "‐‑¬"


@lru_cache(maxsize=1 << 16)
def _fold(run: str) -> str:
    """A run of characters beyond ASCII: letters without accents, look-alikes as what they look
    like, hyphens as '-', invisible characters and marks as nothing, all else as a blank."""
    out = []
    for c in run:
        if c in INVISIBLE:
            continue
        if c in _HYPHENS:
            out.append("-")
            continue
        for d in unicodedata.normalize("NFKD", LOOKALIKES.get(c, c)):
            if d.isalnum():
                out.append("ss" if d == "ß" else LOOKALIKES.get(d, d))
            elif not unicodedata.combining(d):
                out.append(" ")
    return "".join(out)


def plain(text: str) -> str:
    """The text in lower case without accents, look-alike letters, invisible characters and
    hyphens at line ends."""
    if not text.isascii():
        if "­" in text:
            text = text.replace("­\n", "")
        text = _OTHER.sub(lambda m: _fold(m[0]), text)
    if "-" in text and "\n" in text:
        text = _BREAK.sub("", text)
    return text.lower()


def words(text: str) -> list[bytes]:
    return _WORD.findall(plain(text).encode())


def codes(found: list[bytes]) -> np.ndarray:
    """A 64-bit code per word, the same on every machine."""
    c = np.fromiter(map(zlib.crc32, found), dtype=np.uint64, count=len(found))
    c = (c + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return c ^ (c >> np.uint64(29))


#: Words of a shingle.
K = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def shingles(c: np.ndarray) -> np.ndarray:
    """A 64-bit code per run of K words, from the words' codes."""
    n = len(c) - K + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = c[:n] * _ODD[0]
    for i in range(1, K):
        out += c[i : i + n] * _ODD[i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))
