"""How two spellings differ, over whole Arrow batches of bytes.

What is compared is what is left of a text without some characters. Those are marked in a
batch's UTF-8 bytes at once, so no text is rewritten; linear in the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: White space of any script beyond ASCII: what may follow each first byte.
WIDE_SPACES = {0xC2: ((0x85,), (0xA0,)), 0xE1: ((0x9A, 0x80),), 0xE2: (*((0x80, b) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F)), 0xE3: ((0x80, 0x80),)}
_BYTE = np.arange(256)
_SPACE = ((_BYTE >= 9) & (_BYTE <= 13)) | ((_BYTE >= 28) & (_BYTE <= 32))
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_LOWER = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint8)
KINDS = ("spacing", "punctuation", "case", "disagrees")


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends); a null has none."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _spaces(data: np.ndarray) -> np.ndarray:
    out = _SPACE[data]
    for lead, rests in WIDE_SPACES.items():
        width = len(rests[0])
        at = np.flatnonzero(data[: len(data) - width] == lead) if len(data) > width else np.zeros(0, np.int64)
        for rest in rests if len(at) else ():
            hit = at[np.all([data[at + k] == b for k, b in enumerate(rest, 1)], axis=0)]
            for k in range(width + 1):
                out[hit + k] = True
    return out


def _left(data: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def _same(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which rows have equal bytes."""
    size = np.diff(a[1])
    same = size == np.diff(b[1])
    rows = np.flatnonzero(same & (size > 0))
    if len(rows):
        n = size[rows]
        begin = np.cumsum(n) - n
        own = np.arange(n.sum()) - np.repeat(begin, n)
        differs = a[0][own + np.repeat(a[1][rows], n)] != b[0][own + np.repeat(b[1][rows], n)]
        same[rows] = ~np.logical_or.reduceat(differs, begin)
    return same


def kinds(left: pa.Array, right: pa.Array) -> pa.Array:
    """KINDS of each pair: equal without white space, equal letters and digits, equal but for case, or none; nulls equal nothing."""
    a, b = _bytes(left), _bytes(right)
    x, y = _left(*a, _ALNUM[a[0]]), _left(*b, _ALNUM[b[0]])
    tests = (_same(_left(*a, ~_spaces(a[0])), _left(*b, ~_spaces(b[0]))), _same(x, y), _same((_LOWER[x[0]], x[1]), (_LOWER[y[0]], y[1])))
    place = np.select(tests, (0, 1, 2), 3)
    if left.null_count or right.null_count:
        place[~(np.array(left.is_valid()) & np.array(right.is_valid()))] = 3
    return pa.array(KINDS, pa.string()).take(pa.array(place))
