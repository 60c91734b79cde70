"""Pre-tokens of whole batches of texts by array operations.

``cut`` splits texts as the pattern of byte-level vocabularies does (``PATTERN``), for all texts at once:
runs of letters, of digits, of other signs, each with one blank before it; the endings 's 't 're
've 'm 'll 'd on their own; white space up to the character before the next word.  Occurrences are
numbered by distinct pre-token, so an encoder looks at each distinct one once and ``expand`` deals its
ids to all occurrences.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Fixed value: the pattern that ``cut`` follows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_OTHER, _LETTER, _DIGIT, _BLANK = range(4)


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point, by the same properties as in the pattern."""
    import regex

    out = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    points = "".join(map(chr, range(sys.maxunicode + 1)))
    for kind, of in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_BLANK, r"\s+")):
        for m in regex.finditer(of, points):
            out[m.start():m.end()] = kind
    return out


@dataclass
class Cut:
    distinct: list[bytes]   #: distinct pre-tokens
    number: np.ndarray      #: index into ``distinct`` of every pre-token, in order
    ends: np.ndarray        #: pre-tokens up to the end of every text


def starts(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """True where a pre-token starts; ``firsts``: positions of the first characters of texts."""
    kind = classes()[codes]
    n = len(codes)
    begins = np.zeros(n + 1, bool)
    begins[firsts] = True
    begins[n] = True
    out = begins.copy()
    out[1:n] |= kind[1:] != kind[:-1]
    # white space before a word of the same text: its last character starts a pre-token, which a
    # plain blank shares with the word
    word = np.flatnonzero((kind[1:] != _BLANK) & (kind[:-1] == _BLANK) & ~begins[1:n]) + 1
    out[word - 1] = True
    out[word[codes[word - 1] == 32]] = False
    # an apostrophe that starts a pre-token takes one of the endings along
    mark = np.flatnonzero((codes == 39) & out[:n])
    if len(mark):
        end = np.flatnonzero(begins)
        room = end[np.searchsorted(end, mark, side="right")] - mark - 1  # characters of the text that follow
        one, two = codes[np.minimum(mark + 1, n - 1)], codes[np.minimum(mark + 2, n - 1)]
        short = (room >= 1) & np.isin(one, [ord(c) for c in "stmd"])
        long = (room >= 2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        out[mark[short | long] + 1] = False
        out[mark[short] + 2] = True
        out[mark[long] + 3] = True
    return out[:n]


def cut(texts: list[str]) -> Cut:
    """Pre-tokens of all texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    stops = np.cumsum(lengths)
    joined = "".join(texts)
    data = joined.encode("utf-8")
    if not joined:
        return Cut([], np.empty(0, np.int64), np.zeros(len(texts), np.int64))
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    at = np.flatnonzero(starts(codes, (stops - lengths)[lengths > 0]))
    ends = np.searchsorted(at, stops)
    if len(data) != len(codes):
        raw = np.frombuffer(data, np.uint8)
        at = np.flatnonzero((raw & 0xC0) != 0x80)[at]
    offsets = np.append(at, len(data)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return Cut(pieces.dictionary.to_pylist(), pieces.indices.to_numpy(zero_copy_only=False), ends)


def expand(found: Cut, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, ids up to the end of every text); ``ids``: the ids of every distinct
    pre-token as little-endian unsigned 32-bit integers."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
    first = np.cumsum(size) - size
    each = size[found.number]
    stops = np.cumsum(each)
    out = flat[np.repeat(first[found.number] - (stops - each), each) + np.arange(int(stops[-1]) if len(stops) else 0)]
    return out, np.append(0, stops)[found.ends]
