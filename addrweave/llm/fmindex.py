"""Substring deduplication with a compressed FM-index per shard.

A shard's segments are sequences of word numbers.  Their suffixes are sorted to
the depth of a window and the Burrows-Wheeler transform is kept in a wavelet
matrix of packed bits with block counts.  Backward search over it computes the
matching statistics of the shard's texts, streamed from right to left, one step
a word: at each word the length of the longest match, up to a window, and the
smallest doc_id in its interval.  Words whose match is a whole window with a
smaller doc_id than their own text's are reported, and the words under these
windows removed.

See ``repeats`` for the Spark jobs around the index and for nulls, empty texts
and repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .repeats import covered, keyed, marked

GRAM = 4
STRETCH = 64


def ordered(keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of keys from 0 to ``top``, and the keys in it.

    Numbers are sorted faster than their places, so a place is packed below its key where both fit into 63 bits.
    """
    bits = len(keys).bit_length()
    if int(top).bit_length() + bits > 63:
        order = np.argsort(keys)
        return order, keys[order]
    packed = np.sort(keys << bits | np.arange(len(keys)))
    return packed & ((1 << bits) - 1), packed >> bits


def sorted_suffixes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` symbols, and each one's rank.

    What follows the next symbol 0 is not compared.  As many symbols as fit into
    63 bits make the first order; from there the compared length doubles, up to
    exactly ``depth``, and only suffixes that equal another one so far are sorted
    again.  A rank is the first place of all suffixes that are equal.
    """
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n) + 1
    width = max(1, int(symbols.max(initial=0)).bit_length())
    key, have, most = symbols.astype(np.int64), 1, max(1, min(depth, 63 // width))
    while have < most:
        step = min(have, most - have)
        more = np.zeros(n, np.int64)
        more[: max(0, n - have)] = key[have:] >> width * (have - step)
        more *= left > have
        key = key << width * step | more
        have += step
    order, key = ordered(key, (1 << width * have) - 1)
    rank, groups = np.empty(n, np.int64), -1
    at = np.arange(n)  # open places of the order
    while len(at):
        new = np.append(True, key[1:] != key[:-1])
        first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[order[at]] = first
        if have >= depth or int(new.sum()) == groups:  # nothing was split: longer symbols split nothing either
            break
        some = ~(new & np.append(new[1:], True))
        at, first, groups = at[some], first[some], int((new & some).sum())
        step = min(have, depth - have)
        suffix = order[at]
        key = first * (n + 1) + np.where(left[suffix] > step, rank[np.minimum(suffix + step, n - 1)] + 1, 0)
        by, key = ordered(key, n * (n + 1) + n)
        order[at] = suffix[by]
        have += step
    return order, rank


class WaveletMatrix:
    """Ranks of symbols in a sequence, one packed bit vector a level."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        n = len(sequence)
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level) & 1
            packed, before = packed_bits(bit)
            self.bits.append(packed)
            self.counts.append(before)
            self.zeros.append(n - int(bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros(len(at), np.int64), at
        for level in range(self.levels):
            bit = (symbols >> (self.levels - 1 - level)) & 1 == 1
            a, b = (ones(self.bits[level], self.counts[level], x) for x in (low, high))
            low = np.where(bit, self.zeros[level] + a, low - a)
            high = np.where(bit, self.zeros[level] + b, high - b)
        return high - low


def packed_bits(bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bit vector in words of 64 bits, and the ones before each word."""
    packed = np.packbits(np.concatenate([bit.astype(np.uint8), np.zeros(-len(bit) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
    before = np.zeros(len(packed) + 1, np.int32)
    np.cumsum(np.bitwise_count(packed), out=before[1:])
    return packed, before


def ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ones before each place."""
    word = at >> 6
    below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return before[word] + np.bitwise_count(packed[word] & below)


class FMIndex:
    """Matching statistics against texts that end in symbol 0, by backward search.

    What stays after it is built: the wavelet matrix of the transform, a packed
    bit vector with the places where the first ``depth`` symbols of a suffix
    differ from those of the one before, the same for ``depth - 1`` symbols, and
    the smallest doc_id of each group of suffixes with ``depth`` equal symbols.
    Suffix order and ranks go.
    """

    def __init__(self, symbols: np.ndarray, docs: np.ndarray, depth: int):
        order, rank = sorted_suffixes(symbols, depth)
        self.depth = depth
        top = int(symbols.max(initial=0))
        self.matrix = WaveletMatrix(symbols[order - 1], top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        new = np.append(True, np.diff(rank[order]) != 0)
        self.groups = packed_bits(new)
        self.least = np.minimum.reduceat(docs[order], np.flatnonzero(new))
        _, shorter = sorted_suffixes(symbols, depth - 1)
        short = np.append(True, np.diff(shorter[order]) != 0)  # sorting deeper keeps the shallower order
        self.short = packed_bits(short)
        self.starts = np.append(np.flatnonzero(short), len(symbols)).astype(np.int32)

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Intervals of the suffixes that continue the given ones to the left."""
        base = self.before[symbols]
        both = self.matrix.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return base + both[: len(low)], base + both[len(low) :]

    def statistics(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest match (``depth`` at most) and smallest doc_id at each place.

        All stretches symbols[begin:end] are streamed side by side from right to
        left: each step puts one symbol before the match, and a match that has
        reached ``depth`` symbols drops its last one by widening its interval to
        that of ``depth - 1`` symbols.  The doc_id is that of a whole interval of
        matches of ``depth`` symbols (-1 below that).  A stretch that ends before
        its text does starts with the match that stands there.
        """
        length = np.zeros(len(symbols), np.int32)
        least = np.full(len(symbols), -1, np.int64)
        order = np.argsort(begin - end)
        begin, end = begin[order], end[order]  # longest first: those that end early leave from the back
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(symbols))
        have = np.zeros(len(begin), np.int32)
        size = end - begin
        for back in range(1, int(size.max(initial=0)) + 1):
            alive = int(np.searchsorted(-size, -back, "right"))
            low, high, have = low[:alive], high[:alive], have[:alive]
            at = end[:alive] - back
            full = have == self.depth
            if full.any():
                group = ones(*self.short, low[full] + 1) - 1
                low[full], high[full] = self.starts[group], self.starts[group + 1]
                have[full] -= 1
            low, high = self.step(symbols[at], low, high)
            have = np.where(low < high, have + 1, 0)
            lost = have == 0
            low[lost], high[lost] = 0, len(symbols)
            length[at] = have
            whole = have == self.depth
            least[at[whole]] = self.least[ones(*self.groups, low[whole] + 1) - 1]
        return length, least


def lowest(contents: pa.Array, docs: np.ndarray, window: int) -> pa.Array:
    """For each segment, the smallest doc_id of each of its windows.

    The segments are streamed past their own index in stretches of ``STRETCH``
    windows; windows are reported where a match is at least as long as they.
    """
    data, at = text.raw(contents)
    starts, ends, first = text.spans(data, at, text.SPACED)
    words = text.hashes(data, starts, ends)
    counts = np.diff(first)
    number = np.unique_inverse(words).inverse_indices
    owner = text.owners(first)
    of = np.repeat(np.arange(len(counts)), counts + 1)  # one separator after each segment
    symbols = np.zeros(len(words) + len(counts), np.int64)
    symbols[np.arange(len(words)) + owner] = number + 1
    index = FMIndex(symbols, docs[of], window)
    n = counts - window + 1
    parts = -(-n // STRETCH)
    row = np.repeat(np.arange(len(n)), parts)
    step = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * STRETCH
    begin = first[row] + row + step
    length, least = index.statistics(symbols, begin, begin + np.minimum(n[row] - step, STRETCH) + window - 1)
    cuts = np.cumsum([0, *n])
    place = np.repeat(first[:-1] + np.arange(len(n)) - cuts[:-1], n) + np.arange(cuts[-1])  # of each window
    found = least[place]
    if (length[place] < window).any():
        raise AssertionError("a window of the index was not found in it")
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found))


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Remove words under windows that also start in a document with a smaller id.

    Returns doc_id, n_words, n_removed and kept (the words left, joined by one
    space); with ``keep`` also all columns of ``docs`` (those with the three
    names of the results are replaced by them).
    """
    named = docs if keep else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids, texts = (id_col, text_col) if keep else ("doc_id", "text")
    made = keyed(named, ids, texts)
    found = marked(made, "word", window, GRAM, lambda contents, owners: lowest(contents, owners, window))
    rest = [c for c in named.columns if c not in ("n_words", "n_removed", "kept")]

    def remove(batches):
        for block in text.blocks(batches, "__body"):
            data, at = text.raw(block.column("__body"))
            starts, ends, first = text.spans(data, at, text.SPACED)
            gone = covered(first, block.column("__starts"), block.column("__copy"), window)
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(first[:-1], len(gone))) * (np.diff(first) > 0)
            flat = data.tobytes()
            kept = []
            for r in range(block.num_rows):
                a, b = first[r], first[r + 1]
                left = np.flatnonzero(~gone[a:b]) + a
                kept.append(b" ".join([flat[x:y] for x, y in zip(starts[left].tolist(), ends[left].tolist(), strict=True)]).decode())
            out = [block.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.diff(first)), pa.array(removed), pa.array(kept, pa.string())], [*rest, "n_words", "n_removed", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.select(*rest).schema.fields)
    return found.select(*rest, "__body", "__starts", "__copy").mapInArrow(remove, f"{schema}, n_words long, n_removed long, kept string")
