"""Arrow text columns as numpy arrays: bytes, word spans and word hashes.

Every helper works on a *block*: some rows of one Arrow batch whose texts hold
about ``BLOCK_BYTES`` together, so that the temporary arrays of a task stay
small whatever the batch or the table holds (one longer text is a block of its
own).  Nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}

#: Bytes that the words of the contracts are made of.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Lower-cases A-Z alone, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: A fixed permutation of the bytes, for a second hash of the same span.
SHUFFLED = np.random.default_rng(5).permutation(256).astype(np.uint8)


def blocks(batches, column: str = "text", size: int = BLOCK_BYTES):
    """Runs of rows of the batches, each with texts of about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        block = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a block's texts, end to end, and where each begins."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def spans(data: np.ndarray, at: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each text's first word (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = allowed[data]
    here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
    full = at[:-1] < at[1:]
    before[at[:-1][full]] = False
    after[at[1:][full] - 1] = False
    starts = np.flatnonzero(here & ~before)
    ends = np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def _power(base: int, n: int) -> np.ndarray:
    known = _powers[base]
    if len(known) < n:
        steps = np.full(max(n, 1 << 22), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one running sum over the block."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts])


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive word hashes (texts are not kept apart)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + words[k : len(words) - n + 1 + k]
    return mix(total)


def pairs(words: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of each word hash with the one ``apart`` places behind (texts are not kept apart)."""
    return mix(words[: max(0, len(words) - apart)] * np.uint64(_BASE) + words[apart:])


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys have their bit set."""
    bit = keys & np.uint64((len(bitmap) << 6) - 1)
    return np.flatnonzero(bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))


def owners(first: np.ndarray) -> np.ndarray:
    """Of each word, the row in the block that it stands in."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all stretches, one stretch after the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    n = len(values)
    if n < width:
        return values[:0]
    out, have = values.copy(), 1
    while have < width:
        more = min(have, width - have)
        n -= more
        np.minimum(out[:n], out[more : n + more], out=out[:n])
        have += more
    return out[:n]
