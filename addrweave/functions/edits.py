"""Edit distances of all pairs of two lists of byte strings, as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a pattern that fit into one word of bits.
WORD = 64
#: Pairs that are computed at a time.
PAIRS = 1 << 16


def _bytes(values: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint8) for v in values.cast(pa.binary()).to_pylist()]


def _by_bits(patterns: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Columns of the distance table as bits of one word (Myers, Hyyro); patterns have 1 to ``WORD`` bytes."""
    size = np.array([len(x) for x in patterns])
    letters = np.concatenate(patterns)
    row = np.repeat(np.arange(len(patterns)), size)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
    used, code = np.unique(letters, return_inverse=True)
    slot = np.full(256, len(used))  # bytes of no pattern share the last slot
    slot[used] = np.arange(len(used))
    where = np.zeros((len(used) + 1, len(patterns)), np.uint64)
    np.bitwise_or.at(where, (code, row), np.uint64(1) << place.astype(np.uint64))
    one, last = np.uint64(1), (size - 1).astype(np.uint64)
    out = np.empty((len(texts), len(patterns)), np.int16)
    length = np.array([len(x) for x in texts])
    for n in np.unique(length):
        of = np.flatnonzero(length == n)
        step = max(1, PAIRS // len(patterns))
        for some in (of[k : k + step] for k in range(0, len(of), step)):
            each = slot[np.stack([texts[k] for k in some])]
            up = np.full((len(some), len(patterns)), ~np.uint64(0))
            down = np.zeros_like(up)
            score = np.repeat(size.astype(np.int16)[None, :], len(some), 0)
            for j in range(n):
                eq = where[each[:, j]]
                v = eq | down
                h = (((eq & up) + up) ^ up) | eq
                right, left = down | ~(h | up), up & h
                score += ((right >> last) & one).astype(np.int16)
                score -= ((left >> last) & one).astype(np.int16)
                right = (right << one) | one
                up = (left << one) | ~(v | right)
                down = right & v
            out[some] = score
    return out


def _by_rows(patterns: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Rows of the distance table, one text after the other."""
    out = np.empty((len(texts), len(patterns)), np.int16)
    size = np.array([len(x) for x in patterns])
    wide = np.zeros((len(patterns), size.max()), np.int16) - 1
    for k, x in enumerate(patterns):
        wide[k, : len(x)] = x
    steps = np.arange(wide.shape[1] + 1, dtype=np.int16)
    for t, text in enumerate(texts):
        row = np.repeat(steps[None, :], len(patterns), 0)
        for j, letter in enumerate(text):
            best = np.empty_like(row)
            best[:, 0] = j + 1
            best[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (wide != letter))
            row = np.minimum.accumulate(best - steps, axis=1) + steps
        out[t] = row[np.arange(len(patterns)), size]
    return out


def similarities(x: pa.Array, y: pa.Array) -> np.ndarray:
    """1 less the edit distance by the longer length of each pair, in bytes; 0 if either is empty."""
    a, b = _bytes(x), _bytes(y)
    la, lb = np.array([len(v) for v in a], np.int64), np.array([len(v) for v in b], np.int64)
    edits = np.zeros((len(a), len(b)), np.int16)
    short_a, short_b = (la > 0) & (la <= WORD), (lb > 0) & (lb <= WORD)
    for mine, theirs, by, turned in ((short_a, lb > 0, _by_bits, True), (la > WORD, short_b, _by_bits, False), (la > WORD, lb > WORD, _by_rows, True)):
        i, j = np.flatnonzero(mine), np.flatnonzero(theirs)
        if len(i) and len(j):
            p, t = [a[k] for k in i], [b[k] for k in j]
            edits[np.ix_(i, j)] = by(p, t).T if turned else by(t, p)
    longer = np.maximum(np.maximum(la[:, None], lb[None, :]), 1)
    return np.where((la[:, None] > 0) & (lb[None, :] > 0), np.maximum(1.0 - edits / longer, 0.0), 0.0)
