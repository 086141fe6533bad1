"""Hashes of a text's words."""

from __future__ import annotations

import numpy as np

from .common import mix64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, *range(9, 14)]] = True
BASE = 0x9E3779B97F4A7C15
#: Masks of the first 0 to 8 bytes of a block, the first byte being the lowest.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash, the length and the last byte of each word of a text, A-Z lower-cased.

    A word's blocks of eight bytes are taken up one after the other, mixed by products and shifts in
    between. So there is no family of words that are equal by their pattern, as under a polynomial
    modulo a power of two. Block k of all words that have it is taken at once.
    """
    b = LOWER[np.frombuffer(text.encode(), np.uint8)]
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    inside = np.concatenate([[False], ~BLANK[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    size = end - start
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(b) + 1, "<u8", padded, strides=(1,))  # the block that starts at each byte
    h = mix64(size.astype(np.uint64) + np.uint64(BASE))
    rows, at, left = np.arange(len(size)), start, size
    while len(rows):
        h[rows] = mix64(h[rows] ^ (blocks[at] & FIRST[np.minimum(left, 8)]))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return h, size, b[end - 1]
