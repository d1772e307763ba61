"""Hashed words and structure statistics of a text, for the classifiers.

Defined results: a null or empty text has no words and statistics of 0.  Texts are worked on whole, one at a
time, so a very long one needs some times its own size.  A text's features depend on the text alone: repeated
rows have the same, and no other column plays a part.
"""

from __future__ import annotations

import re

import numpy as np

from .minhash import Words

_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Byte classes: lower, upper, digit, blank, line end, letter beyond ASCII, pipe, end of sentence, other.
_CLASS = np.full(256, 8, np.uint8)
for _c, _members in enumerate([range(97, 123), range(65, 91), range(48, 58), (9, 11, 12, 13, 32), (10,), range(128, 256), (124,), (33, 46, 63)]):
    _CLASS[list(_members)] = _c
_WORDS = Words(100_000)
#: Names of the statistics, in order.
STATS = ("bytes", "words", "mean_word", "upper", "digit", "beyond_ascii", "pipe", "stop", "other", "blank", "different", "top_word", "twice_running", "lines", "same_lines", "mean_line", "capitals", "marked")


def tokens(raw: bytes) -> list[bytes]:
    return _TOKEN.findall(raw.lower())


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit word hashes and their counts."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(_WORDS.hashes(words), return_counts=True)


def statistics(raw: bytes, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One float for each of STATS; all are 0 for the empty text."""
    n = len(raw)
    if not n:
        return np.zeros(len(STATS))
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) / n
    words = raw.split()
    m = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    capitals = sum(map(bytes.isupper, words))
    marked = sum(1 for w in words if w[-1:] in b"!#$%&*@^~|<>{}[]=+\\/_")
    total = max(1, int(counts.sum()))
    return np.array([np.log2(1 + n), np.log2(1 + len(words)), sum(map(len, words)) / m, share[1], share[2], share[5], share[6], share[7], share[8], share[3] + share[4], len(hashes) / total, (counts.max() if len(counts) else 0) / total, again / m, np.log2(1 + len(lines)), 1 - len(set(lines)) / k, np.log2(1 + n / k), capitals / m, marked / m])
