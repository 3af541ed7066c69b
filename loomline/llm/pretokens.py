"""Splits texts as the byte-level BPE pattern does, for a whole block of texts at once.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Its matches cover the text without gaps, so they're given by where they begin, which
depends on the classes of neighbouring characters only:

* a match begins where the class (letter, number, space, other) changes, unless one
  space before takes the rest along;
* the last of several spaces is split from the others if text follows;
* a contraction that begins at an apostrophe ends after its letters.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: Characters of Unicode's White_Space.
_SPACES = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, chars):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = _OTHER
    out[_SPACES] = _SPACE
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts, byte ends, first match of each row) of the pattern's matches in UTF-8 rows."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n, kind = len(code), _classes()[code]
    row = np.zeros(n + 3, bool)
    row[np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])] = True
    row[n:] = True
    begin = row[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    after = np.flatnonzero((code[:-1] == 32) & ~space[1:] & ~row[1:n]) + 1
    begin[after] = False
    begin[:-1] |= space[:-1] & ~space[1:] & ~row[1:n]
    quote = np.flatnonzero(begin & (code == 39))
    wide = np.r_[code, np.zeros(3, np.uint32)]
    one, two = np.where(row[quote + 1], 0, wide[quote + 1]), np.where(row[quote + 1] | row[quote + 2], 0, wide[quote + 2])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    begin[quote[short | long] + 1] = False
    begin[quote[long] + 2] = False
    past = np.r_[quote[short] + 2, quote[long] + 3]
    begin[past[past < n]] = True
    starts = lead[np.flatnonzero(begin)]
    return starts, np.r_[starts[1:], len(data)], np.searchsorted(starts, offsets)
