"""Vectorised splitting of texts into pre-tokens, the pieces inside which a byte-level tokenizer works.

The boundaries are those of the public pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
computed from the class of each code point instead of by matching one piece after another.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[list(WHITE_SPACE)] = SPACE
    return out


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position at which each pre-token starts, index of the first pre-token of each text and their number).

    `data` has the UTF-8 bytes of the texts, text i being data[offsets[i]:offsets[i + 1]].
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    byte_of = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    kind = classes()[code]
    head = np.zeros(n + 1, dtype=bool)  # a text starts here
    head[np.searchsorted(byte_of, offsets)] = True
    run = head[:n].copy()  # a run of one class starts here
    run[1:] |= kind[1:] != kind[:-1]
    blank = code == 0x20
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~head[:n]
    space = kind == SPACE
    start = run & (space | ~after_blank)
    # the last white-space character before another character is a piece, or the start of one
    start[:-1] |= space[:-1] & ~space[1:] & ~head[1:n]
    # contractions: an apostrophe alone between a non-blank and one of the endings
    quote = np.flatnonzero((code == 0x27) & run & ~after_blank)
    quote = quote[quote + 1 < n]
    quote = quote[~head[quote + 1]]
    if len(quote):
        c1 = code[quote + 1]
        c2 = np.where((quote + 2 < n) & ~head[np.minimum(quote + 2, n)], code[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(c1, [ord(x) for x in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        length = np.where(one, 2, np.where(two, 3, 0))
        quote, length = quote[length > 0], length[length > 0]
        start[quote + 1] = False
        start[(quote + length)[quote + length < n]] = True
    at = byte_of[start]
    return at, np.searchsorted(at, offsets)
