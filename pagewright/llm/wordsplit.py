"""Vectorised pre-tokenisation: cuts many texts at once and dictionary-encodes the pieces.

The pieces tile the texts, so they are Arrow slices of one buffer; only the
distinct ones are ever looked at one by one.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)

#: The code points with the Unicode property White_Space.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


class Pieces(NamedTuple):
    """codes: index into words for every piece; bounds: per text the first piece and the one after its last."""

    codes: np.ndarray
    words: pa.StringArray
    first: np.ndarray
    last: np.ndarray


def _contractions(cps: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ' that open 's 't 'm 'd 're 've 'll, and the lengths; begins: where a match may start."""
    at = np.flatnonzero((cps == 0x27) & begins)
    one = cps[at + 1]
    two = cps[np.minimum(at + 2, len(cps) - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    return np.concatenate([at[short], at[long]]), np.concatenate([np.full(short.sum(), 2), np.full(long.sum(), 3)])


def split(texts: list[str], space_prefix: bool) -> Pieces:
    """Cut texts into pieces.

    space_prefix False: contractions, letter runs, single numbers, runs of other
    characters, and white-space runs.  True: contractions, then letter, number or
    other runs each with one leading blank if there is one, and white space so
    that its last character stays apart when something follows.
    """
    joined = "\0".join(texts) + "\0"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind = classes()[cps]
    kind[ends] = EDGE
    before = np.empty_like(kind)
    before[0] = EDGE
    before[1:] = kind[:-1]
    start = (kind != before) | (kind == EDGE)
    if space_prefix:
        blank = np.zeros(len(cps), bool)
        blank[1:] = (cps[:-1] == 0x20) & (before[1:] == SPACE)
        after = np.empty_like(kind)
        after[-1] = EDGE
        after[:-1] = kind[1:]
        start |= (kind == SPACE) & (after != SPACE) & (after != EDGE)
        start &= ~(blank & (kind < SPACE))
        begins = (before == LETTER) | (before == NUMBER) | (before == EDGE) | ((before == SPACE) & ~blank)
    else:
        start |= kind == NUMBER
        begins = before != OTHER
    at, n = _contractions(cps, begins)
    if len(at):
        start[at] = True
        start[at + 1] = False
        start[at + n] = True
    starts = np.flatnonzero(start)
    if len(joined) == len(data := joined.encode("utf-8", "surrogatepass")):
        offsets = np.append(starts, len(cps))
    else:
        width = 1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000)
        offsets = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[np.append(starts, len(cps))]
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    coded = pieces.dictionary_encode()
    last = np.searchsorted(starts, ends)
    first = np.concatenate([[0], last[:-1] + 1]) if len(texts) else last
    return Pieces(np.asarray(coded.indices), coded.dictionary, first, last)


def raw_bytes(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The strings' UTF-8 bytes end to end, and their n+1 offsets from 0."""
    _, offsets, data = words.buffers()
    off = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(words) else np.zeros(0, np.uint8)
    return flat, off - off[0]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... (counts[i] of them) for every i, end to end."""
    counts = counts.astype(np.int64)
    if not len(counts):
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return shift + np.arange(len(shift))
