"""Language-model scores by logistic context mixing.

A text is a stream of bytes: its words with one space after each, and a newline
at its end.  The stream is predicted bit by bit.  Three contexts (the last three
bytes, across words; the word so far; the word before and the word so far) are
hashed to rows of tables of fixed size, one row for each half byte,
that count the half bytes which followed.  The counts are those of all training
texts: tasks count into arrays and Spark adds these up in parts.  The contexts'
stretched bit probabilities are combined by weights that a gate picks (position
of the bit, length of the word so far), and a map refines the result.  While a
text is scored, the mixture adapts to it: each context's weights have a factor of
the text's own, moved along the gradient of the bits' probabilities after
``FIRST_STEP`` bytes and whenever the text read has doubled, then every ``STEP``
bytes.

Tables of fixed size can't tell long contexts apart, so these are held in a
distributed table that grows with the corpus.  Texts are cut into *stretches*
(after words whose hash says so, at ``LONGEST`` words at most); the context of a
stretch is the one before it.  Of a context met n times in other training texts a
stretch has the share of these that it followed, and this is mixed with the
product of its bits by a weight gated by n: as often as stretches of training
texts, taken out in turn, were met elsewhere in such a context.  Of stretches, a
training text is scored by the counts of the other rows alone, so that a text that
stands in the corpus twice differs from one that stands there once.  Of half bytes,
each bit of a training text is scored without its own count (those of the same text's
other places stay, as does what the weights have seen of the text).

Weights and map of the bits are fitted on all training texts, each bit without its
own count: a pass counts, for each gate, how often a bit 0 or 1 followed each triple
of stretched probabilities (in ``LEVELS`` levels each).  Tasks' counts are added up by
Spark as those of half bytes are, and the regression over the triples is solved on the
driver; it has as many rows as there are triples, whatever the corpus holds.

A text's score is the sum over its stretches, so it is a probability of the
stream.  The columns of the base model come from a distributed table of all words.
Those met at least so often that ``FREQUENT`` of them are left at most are
broadcast; the others are joined by hash.

Nulls and empty texts are one end.  Rows with a null doc_id are scored (and
learned from: their split is 0).  Repeated rows get equal scores.  Without
training texts all contexts are empty.  Jobs run when the function is called; the
table of scores that the result reads stays in the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .common import bitmap, discard, per_block, remainder, stored
from .repeats import HELD, RANGE, keyed

FREQUENT = 1 << 18
ROW_BITS = (16, 17, 17)
CONTEXTS = len(ROW_BITS)
GATES = 8 * 4
LEVELS = 24
STEPS = 33
FINE = 4096
CHUNK = 16
PART = 1 << 13
TOGETHER = 1 << 27
TASKS = 24
FIRST_STEP = 256
STEP = 1 << 14
ADAPT = 0.5
TOGETHER_SCORED = 1 << 16
BLOCK = 1 << 19
CUT = 6
LONGEST = 64

_LIMIT = 8.0
_SCALE = 512  # of stretched probabilities, held in 16 bits; a level is 1 wide
_SALTS = [(0x9E37 + j) * 0x9E3779B97F4A7C15 % 2**64 for j in range(CONTEXTS)]
_SECOND = [np.random.default_rng(j).permutation(1 << bits)[:16].astype(np.int32) << 4 for j, bits in enumerate(ROW_BITS)]


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Stream:
    """A block's texts as bytes, with the hashed contexts of every byte."""

    def __init__(self, column: pa.Array):
        data, at = text.raw(column)
        data = text.LOWER[data]
        starts, ends, first = text.spans(data, at, text.SPACED)
        rows, n = np.arange(len(first) - 1), len(starts)
        self.place = np.arange(n) + text.owners(first)  # items: each text's words, then its end
        self.stop = first[1:] + rows
        length = ends - starts
        sizes = np.ones(n + len(rows), np.int64)
        sizes[self.place] += length
        self.items = np.cumsum(sizes) - sizes  # first byte of each item
        begin = self.items[self.place]
        self.bytes = np.full(int(sizes.sum()), 0x20, np.uint8)
        inside = np.ones(len(self.bytes), bool)
        inside[begin + length] = inside[self.items[self.stop]] = False
        self.bytes[inside] = data[text.SPACED.take(data)]  # words have all bytes that are allowed in one
        self.bytes[self.items[self.stop]] = 0x0A
        self.first = np.append(0, self.stop[:-1] + 1)[: len(rows)]  # first item of each text
        self.begin = self.items[self.first] if len(rows) else rows  # first byte of each text
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        value = self.bytes.astype(np.uint64)
        value += np.uint64(1)
        value *= text._power(text._BASE, len(self.bytes))
        np.cumsum(value, out=sums[1:])
        inverse = text._power(text._INVERSE, len(sums)).take(self.items)
        self.words, self.first_word = text.mix((sums[begin + length] - sums[begin]) * inverse[self.place]), first  # as ``text.hashes`` has them
        before = np.zeros(len(sizes) + 1, np.uint64)
        before[self.place + 1] = self.words
        before = text.mix(before + np.uint64(1))
        # contexts are 32 bits of such hashes
        so_far = sums[:-1].astype(np.uint32)
        so_far -= np.repeat(so_far.take(self.items), sizes)
        so_far *= np.repeat(inverse.astype(np.uint32), sizes)
        both = np.repeat(before[:-1].astype(np.uint32), sizes)
        both ^= so_far
        padded = np.concatenate([np.zeros(3, np.uint8), self.bytes])
        three = np.ndarray(len(self.bytes), np.uint32, padded, 0, (1,)) & np.uint32(0xFFFFFF)  # the three bytes before each
        for k in range(3):  # nothing of the text before
            place = self.begin + k
            place = place[place < len(three)]
            three[place] &= np.uint32(0xFFFFFF << 8 * (3 - k) & 0xFFFFFF)
        self.contexts = []
        for c, salt, bits in zip((three, so_far, both), _SALTS, ROW_BITS, strict=True):
            c += np.uint32(salt >> 32)
            c ^= c >> np.uint32(15)
            c *= np.uint32(0xD1342543)
            c >>= np.uint32(32 - bits)
            c <<= np.uint32(4)
            self.contexts.append(c.view(np.int32))
        self.gate = np.full(len(self.bytes), 3, np.uint8)
        for k in (2, 1, 0):
            self.gate[self.items[sizes > k] + k] = k

    def rows(self, j: int, half: int) -> np.ndarray:
        """First cell of the row of context j for the first or second half byte."""
        c = self.contexts[j]
        return c ^ _SECOND[j].take(self.bytes >> 4) if half else c

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every stretch of words: its first item, its text and its hash.

        Where one ends is told by its own words, so no stretch is the beginning of another.
        """
        n = len(self.items)
        hashed = np.full(n, 0x0A, np.uint64)
        hashed[self.place] = self.words
        new = np.zeros(n, bool)
        new[self.first] = True
        new[self.place[self.words % np.uint64(CUT) == 0] + 1] = True
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, n))
        parts = -(-size // LONGEST)
        begin = np.repeat(begin, parts) + (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST
        size = np.diff(np.append(begin, n))
        power = text._power(text._BASE, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(text.mix(hashed) * power[:n], out=total[1:])
        s = text.mix((total[begin + size] - total[begin]) * text._power(text._INVERSE, n + 1)[begin] + size.astype(np.uint64))
        return begin, np.searchsorted(self.first, begin, "right") - 1, s


def _added(docs: DataFrame, size: int, add) -> np.ndarray:
    """Sum of an array of ``size`` counts that ``add(counts, stream)`` fills, over all texts of ``docs``.

    Every task hands on an array of fixed size, so small partitions are taken
    together: there are as many tasks as cores (``TASKS`` at least), or one for
    ``TOGETHER`` bytes.
    """
    length = docs.agg(F.sum(F.octet_length("__body"))).first()[0] or 0
    docs = docs.coalesce(max(TASKS, docs.sparkSession.sparkContext.defaultParallelism, length // TOGETHER))

    def met(batches):
        counts = np.zeros(size, np.int32)
        for block in text.blocks(batches, "__body", BLOCK):
            add(counts, Stream(block.column("__body")))
        parts = counts.reshape(-1, PART)
        used = np.flatnonzero(parts.any(1))
        for k in range(0, len(used), 64):
            some = used[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[p].tobytes() for p in some], pa.binary())], ["part", "counts"])

    def total(table: pa.Table) -> pa.Table:
        out = np.zeros(PART, np.int64)
        for counts in table.column("counts"):
            out += np.frombuffer(counts.as_buffer(), np.int32)
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([out.astype(np.float32).tobytes()], pa.binary())})

    added = docs.select("__body").mapInArrow(met, "part long, counts binary").groupBy("part").applyInArrow(total, "part long, counts binary")
    out = np.zeros((size // PART, PART), np.float32)
    for row in added.toLocalIterator():  # as large as the array
        out[row["part"]] = np.frombuffer(row["counts"], np.float32)
    return out.ravel()


def count(docs: DataFrame) -> list[np.ndarray]:
    """Half bytes met in each row of each context, over all texts of ``docs``."""
    cuts = np.cumsum([0, *(16 << bits for bits in ROW_BITS)])

    def add(counts, stream):
        for j in range(CONTEXTS):
            for half, value in enumerate((stream.bytes >> 4, stream.bytes & 15)):
                np.add.at(counts[cuts[j] : cuts[j + 1]], (stream.rows(j, half) + value).astype(np.int64), np.int32(1))

    flat = _added(docs, int(cuts[-1]), add)
    return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _paths(counts: np.ndarray) -> np.ndarray:
    """Stretched probabilities of the four bits of each half byte in each row, 16 bits each.

    Entry 32 * row + value is by all counts, entry 32 * row + 16 + value by those
    without each bit's own count, where the text that is scored was counted too.
    """
    leaves = counts.reshape(-1, 16)
    out = np.zeros((len(leaves), 2, 16, 4), np.int16)
    for depth in range(4):
        sums = leaves.reshape(len(leaves), 1 << depth, 2, -1).sum(3)
        some, less = np.log(sums + np.float32(0.2)), np.log(np.maximum(sums - 1, 0) + np.float32(0.2))
        for value in range(16):
            node, bit = value >> (4 - depth), value >> (3 - depth) & 1
            other = some[:, node, 1 - bit]
            for own, mine in enumerate((some[:, node, bit], less[:, node, bit])):
                out[:, own, value, depth] = np.rint(((mine - other) if bit else (other - mine)) * np.float32(_SCALE))
    return out.view(np.uint64).ravel()


def steps(size: int):
    """First and last byte of the stretches of a text between which its mixture is moved."""
    begin, step = 0, FIRST_STEP
    while begin < size:
        yield begin, min(begin + step, size)
        begin += step
        step = min(begin, STEP)


class Mixer:
    """Stretched probabilities of all half bytes, gated weights and the map."""

    def __init__(self, counts: list[np.ndarray]):
        self.counts = counts
        self.paths: list[np.ndarray] = []
        self.met = np.zeros(GATES * LEVELS**CONTEXTS * 2, np.float32)
        self.weights = np.full((GATES, CONTEXTS), 0.5, np.float32)
        self.map = np.tile(_squash(np.linspace(-_LIMIT, _LIMIT, STEPS)), (GATES, 1))

    def prepare(self) -> None:
        """Tables of the counts, which are no longer needed."""
        if self.counts:
            self.paths, self.counts = [_paths(c) for c in self.counts], []

    def learn(self, stream: Stream) -> None:
        """Count the bits of counted texts that weights and map are fitted on."""
        self.prepare()
        meet(self.met, stream, levels(self.paths))

    def finish(self) -> None:
        """Fit weights and map; probabilities over a fine grid."""
        self.prepare()
        at, steps = np.arange(LEVELS), np.linspace(-_LIMIT, _LIMIT, STEPS)
        value = at - LEVELS / 2 + 0.5
        for gate, met in enumerate(self.met.reshape(GATES, -1, 2)):
            cell = np.flatnonzero(met.any(1))
            if len(cell):
                s = value[np.stack(np.unravel_index(cell, (LEVELS,) * CONTEXTS), 1)]
                one, every = met[cell, 1].astype(np.float64), met[cell].sum(1, dtype=np.float64)
                w = _fitted(s, one, every)
                self.weights[gate] = w
                x = np.clip(s @ w, -_LIMIT, _LIMIT)
                near = np.rint((x + _LIMIT) * ((STEPS - 1) / (2 * _LIMIT))).astype(np.int64)
                more = np.bincount(near, one - every * _squash(x), STEPS) / (np.bincount(near, every, STEPS) + 8)
                self.map[gate] = np.clip(_squash(steps) + more, 1e-5, 1 - 1e-5)
        self.met = np.zeros(0, np.float32)
        grid = (np.arange(FINE) + 0.5) * (2 * _LIMIT / FINE) - _LIMIT
        p = np.stack([np.clip((_squash(grid) + np.interp(grid, steps, m)) / 2, 1e-6, 1 - 1e-6) for m in self.map])
        self.one = p.astype(np.float32).ravel()

    def score(self, stream: Stream, learned: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each byte of the block.

        Of the texts marked in ``learned`` every bit's own count is taken out.
        """
        n = len(stream.bytes)
        out = np.zeros(n, np.float32)
        size = np.diff(np.append(stream.begin, n))
        own = np.zeros(len(size), bool) if learned is None else learned.astype(bool)
        factors = np.ones((CONTEXTS, len(size)), np.float32)
        for low, high in steps(int(size.max(initial=0))):
            last = size <= high
            for moved, texts in enumerate((np.flatnonzero(last & (size > low)), np.flatnonzero(~last))):
                cuts = np.flatnonzero(np.diff(np.cumsum(np.minimum(size[texts], high) - low) // TOGETHER_SCORED)) + 1
                for some in np.split(texts, cuts) if len(texts) else ():  # small arrays stay in the cache
                    have = np.minimum(size[some], high) - low
                    part = text.stretches(stream.begin[some] + low, have)
                    of = np.repeat(np.arange(len(some)), have)
                    out[part], slopes = self._bits(stream, part, of, factors[:, some], np.where(own[some], 16, 0).astype(np.int32), bool(moved))
                    if moved:
                        factors[:, some] = np.clip(factors[:, some] + ADAPT * slopes / (8 * have), 0.25, 3)
        return out

    def _bits(self, stream: Stream, part: np.ndarray, of: np.ndarray, factors: np.ndarray, own: np.ndarray, moved: bool):
        """Cost of each byte of ``part``; if the mixture is moved behind it, the slope of each text's probability along its contexts' factors."""
        gate = stream.gate.take(part)
        order = np.argsort(gate, kind="stable")  # places of one gate lie together
        cuts = np.cumsum([0, *np.bincount(gate, minlength=4)]).tolist()
        part, of = part.take(order), of.take(order)
        byte, factor = stream.bytes.take(part), factors.take(of, 1)
        rows, own = [c.take(part) for c in stream.contexts], own.take(of)
        n = len(part)
        at_gate = np.repeat(np.arange(4, dtype=np.float32) * FINE, np.diff(cuts))
        total, slopes = np.zeros(n, np.float32), np.zeros((CONTEXTS, n), np.float32)
        terms, x, error = np.empty((CONTEXTS, n), np.float32), np.empty(n, np.float32), np.empty(n, np.float32)
        one = self.one.reshape(8, 4 * FINE)
        weights = (self.weights * np.float32(FINE / (2 * _LIMIT) / _SCALE)).reshape(8, 4, CONTEXTS, 1)
        for half, value in enumerate((byte >> 4, byte & 15)):
            if half:
                rows = [c ^ second.take(byte >> 4) for c, second in zip(rows, _SECOND, strict=True)]
            given = np.empty((4, CONTEXTS, n), np.float32)
            mine = own + value
            for j in range(CONTEXTS):
                given[:, j] = self.paths[j].take(2 * rows[j] + mine).view(np.int16).reshape(n, 4).T
            product = np.ones(n, np.float32)
            for depth in range(4):
                for place in range(4):
                    here = slice(cuts[place], cuts[place + 1])
                    np.multiply(factor[:, here], weights[4 * half + depth, place], out=terms[:, here])
                terms *= given[depth]
                np.add(terms[0], terms[1], out=x)
                x += terms[2]
                x += np.float32(FINE / 2)
                np.clip(x, 0, FINE - 1, out=x)
                x += at_gate
                one[4 * half + depth].take(x.astype(np.int32).astype(np.int64), out=error, mode="clip")
                np.subtract((value >> (3 - depth) & 1).astype(np.float32), error, out=error)
                if moved:
                    terms *= error
                    slopes += terms
                np.abs(error, out=error)
                product *= np.subtract(1, error, out=error)
            total += np.log(product, out=product)
        costs = np.empty_like(total)
        costs[order] = total * np.float32(1 / math.log(10))
        if not moved:
            return costs, None
        new = np.append(True, of[1:] != of[:-1])  # a text's places in one gate, or in two that follow each other
        at = np.flatnonzero(new)
        slopes = np.stack([np.bincount(of[at], s, len(factors[0])) for s in np.add.reduceat(slopes, at, 1)])
        return costs, slopes / factors * (2 * _LIMIT / FINE)  # the terms have the factors


def levels(paths: list[np.ndarray]) -> list[np.ndarray]:
    """For ``meet``: of each half byte in each row, its four bits' levels without the own count.

    These are held in 16 bits each and scaled, so that the sum over the contexts is
    twice the number of the triple, and the bit.
    """
    out = []
    for j, entries in enumerate(paths):
        level = entries.view(np.int16).reshape(-1, 2, 16, 4)[:, 1] >> 9
        np.clip(level, -LEVELS // 2, LEVELS // 2 - 1, out=level)
        level += LEVELS // 2
        level *= 2 * LEVELS ** (CONTEXTS - 1 - j)
        if j == 0:
            level += np.arange(16, dtype=np.int16)[:, None] >> np.arange(3, -1, -1, dtype=np.int16) & 1
        out.append(level.view(np.uint64).ravel())
    return out


def meet(counts: np.ndarray, stream: Stream, tables: list[np.ndarray]) -> None:
    """Add how often a bit followed each triple of ``levels``, by gate; each bit's own count is taken out."""
    size = LEVELS**CONTEXTS * 2
    bins = counts.reshape(8, 4 * size)
    gate = stream.gate.astype(np.int64) * size
    for half, value in enumerate((stream.bytes >> 4, stream.bytes & 15)):
        cell = np.zeros(len(gate), np.uint64)
        for j, table in enumerate(tables):
            cell += table.take(stream.rows(j, half) + value)
        for depth, triple in enumerate(cell.view(np.int16).reshape(-1, 4).T):
            bins[4 * half + depth] += np.bincount(gate + triple, minlength=4 * size).astype(counts.dtype)


def _fitted(s: np.ndarray, one: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, by Newton's steps; few rows leave them at 0.5."""
    w = np.full(s.shape[1], 0.5)
    for _ in range(30):
        p = _squash(s @ w)
        slope = s.T @ (one - every * p) - (w - 0.5)
        step = np.linalg.solve((s * (every * p * (1 - p))[:, None]).T @ s + np.eye(len(w)), slope)
        w += step * min(1, 0.5 / (np.abs(step).max() + 1e-12))
    return w


def _tokens(block: pa.RecordBatch):
    data, at = text.raw(block.column("__body"))
    data = text.LOWER[data]
    starts, ends, first = text.spans(data, at, text.SPACED)
    return data, starts, ends, first, text.hashes(data, starts, ends)


def words(docs: DataFrame) -> DataFrame:
    """h (hash), token and n (places in training texts) of every distinct word of all texts."""

    def count(batches):
        def passed(parts):
            h = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts])
            tokens = pa.concat_arrays([p[2] for p in parts])
            _, which, number = np.unique(h, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(h[which].view(np.int64)), tokens.take(pa.array(which)), pa.array(np.bincount(number, n, len(which)).astype(np.int64))], ["h", "token", "n"])

        parts: list = []
        for block in text.blocks(batches, "__body", 1 << 21):
            data, starts, ends, first, h = _tokens(block)
            known = np.repeat(text.column(block, "learn").astype(np.float64), np.diff(first))
            _, which, number = np.unique(h, return_index=True, return_inverse=True)
            flat = data.tobytes()
            parts.append((h[which], np.bincount(number, known, len(which)), pa.array([flat[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)], pa.binary())))
            if len(parts) == CHUNK:
                yield passed(parts)
                parts = []
        if parts:
            yield passed(parts)

    counts = docs.select("__body", "learn").mapInArrow(count, "h long, token binary, n long")
    return counts.groupBy("h", "token").agg(F.sum("n").alias("n"))


def frequent(table: DataFrame, wanted: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words met so often that ``wanted`` are left at most."""
    classes = table.groupBy(F.floor(8 * F.log2(F.col("n") + 1)).alias("class")).count().orderBy(F.desc("class")).collect()  # a few hundred
    left, cut = wanted, math.inf
    for row in classes:
        left -= row["count"]
        if left < 0:
            break
        cut = row["class"]
    top = table.where(F.floor(8 * F.log2(F.col("n") + 1)) >= cut).select("h", "n").toPandas()  # ``wanted`` at most
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def train(docs: DataFrame) -> Mixer:
    """A mixer with the counts of all texts of ``docs``, fitted on all of them."""
    mixer = Mixer(count(docs))
    mixer.prepare()
    shared = docs.sparkSession.sparkContext.broadcast(levels(mixer.paths))
    mixer.met = _added(docs, len(mixer.met), lambda counts, stream: meet(counts, stream, shared.value))
    shared.destroy()
    mixer.finish()
    return mixer


_STRETCH = "c long, s long, own int, own_c int, bits float"


def _scored(made: DataFrame, mixer: Mixer, known: tuple[np.ndarray, np.ndarray], whole: float, texts: int) -> DataFrame:
    """Each row's base and bit scores, its stretches, and its words that are not frequent."""
    shared = made.sparkSession.sparkContext.broadcast((mixer, *known))
    end = math.log10((texts + 0.5) / whole)

    def run(block):
        model, keys, n = shared.value
        stream = Stream(block.column("__body"))
        first, h = stream.first_word, stream.words
        order, at = np.argsort(h), np.empty(len(h), np.int64)
        at[order] = np.minimum(np.searchsorted(keys, h[order]), max(len(keys) - 1, 0))
        hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
        rows, size = text.owners(first), block.num_rows
        counts = n[at[hit]]
        base = np.bincount(rows[hit], np.log10((counts + 0.5) / whole), size) + end
        met = np.bincount(rows[hit], counts > 0, size).astype(np.int64) + (texts > 0)
        order = np.lexsort((h[~hit], rows[~hit]))
        row, other = rows[~hit][order], h[~hit][order]
        new = np.append(True, (other[1:] != other[:-1]) | (row[1:] != row[:-1]))[: len(other)]
        begin = np.flatnonzero(new)
        times = np.diff(np.append(begin, len(other)))
        rare = pa.StructArray.from_arrays([pa.array(other[begin].view(np.int64)), pa.array(times.astype(np.int32))], ["h", "times"])
        rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[begin], np.arange(size + 1)), pa.int32()), rare)

        bits = model.score(stream, text.column(block, "learn")).astype(np.float64)
        item, of, s = stream.stretches()
        cost = np.add.reduceat(bits, stream.items[item])
        score = np.bincount(of, cost, size)
        inner = np.flatnonzero(of[1:] == of[:-1]) + 1  # a text's first stretch has no context
        c, s, of, cost = s[inner - 1], s[inner], of[inner], cost[inner]
        learned = text.column(block, "learn")[of]

        def own(values):
            pair = text.mix(values + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, number = np.unique(pair, return_inverse=True)
            return pa.array((np.bincount(number)[number] * learned).astype(np.int32) if len(pair) else np.zeros(0, np.int32))

        columns = [pa.array(c.view(np.int64)), pa.array(s.view(np.int64)), own(text.mix(c) ^ s), own(c), pa.array(cost.astype(np.float32))]
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(size + 1)), pa.int32()), pa.StructArray.from_arrays(columns, ["c", "s", "own", "own_c", "bits"]))
        length = np.diff(text.raw(block.column("__body"))[1])
        out = [block.column("doc_id"), block.column("learn"), pa.array(np.diff(first) + 1), pa.array(met), pa.array(base), pa.array(score), pa.array(length), rare, lists]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "learn", "n_tokens", "met", "base", "bits", "length", "rare", "stretches"])

    made = per_block(made.select("doc_id", "__body", "learn"), run, f"doc_id long, learn boolean, n_tokens long, met long, base double, bits double, length long, rare array<struct<h long, times int>>, stretches array<struct<{_STRETCH}>>", "__body", BLOCK)
    out = stored(made.withColumn("row", F.monotonically_increasing_id()))
    shared.destroy()  # its copies in all local folders go
    return out


def met_again(scored: DataFrame) -> DataFrame:
    """c of all contexts of stretches that stand in two places or more.

    Tasks keep two places of each context among ``HELD`` and hand them on in ranges of
    contexts; a range has about ``RANGE`` bytes at any size of the corpus.
    """
    size = scored.agg(F.sum(F.size("stretches"))).first()[0] or 0
    bits = max(1, (8 * size // RANGE).bit_length())

    def ranges(c):
        c = np.sort(c)
        c = c[np.append([True, True], c[2:] != c[:-2])[: len(c)]]
        part = (c >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(c)]), len(c)).tolist()
        for k in range(0, len(cuts) - 1, 256):
            some = list(zip(cuts[k : k + 256], cuts[k + 1 : k + 257], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array(part[[a for a, _ in some]]), pa.array([c[a:b].tobytes() for a, b in some], pa.binary())], ["part", "c"])

    def run(batches):
        held: list = []
        for batch in batches:
            held.append(pa.concat_arrays([batch.column("c")]).flatten().to_numpy().view(np.uint64))
            if sum(map(len, held)) >= HELD:
                yield from ranges(np.concatenate(held))
                held = []
        if held:
            yield from ranges(np.concatenate(held))

    def met(table: pa.Table) -> pa.Table:
        c = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("c")]))
        return pa.table({"c": np.unique(c[1:][c[1:] == c[:-1]]).view(np.int64)})

    return scored.select("stretches.c").mapInArrow(run, "part long, c binary").groupBy("part").applyInArrow(met, "c long")


def _places(scored: DataFrame, shared) -> DataFrame:
    """A row for each stretch whose context the bitmap lets pass."""

    def run(batches):
        for batch in batches:
            lists = pa.concat_arrays([batch.column("stretches")])
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            hit = text.passes(shared.value, flat.field(0).to_numpy().view(np.uint64))
            take = pa.array(row[hit])
            columns = [flat.field(k).take(pa.array(hit)) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(take), batch.column("learn").take(take), *columns], ["row", "learn", "c", "s", "own", "own_c", "bits"])

    return scored.select("row", "learn", "stretches").mapInArrow(run, f"row long, learn boolean, {_STRETCH}")


def _gain(scored: DataFrame) -> DataFrame:
    """row and gain: what the contexts of whole stretches add to a text's log10 probability.

    A context that stands in one place alone has no others, so it adds nothing; a bitmap
    keeps (nearly) all of these out of the joins.
    """
    again = stored(met_again(scored))
    shared = scored.sparkSession.sparkContext.broadcast(bitmap(again, "c"))
    discard(again)
    rows = stored(_places(scored, shared))
    shared.destroy()
    pairs = stored(rows.groupBy("c", "s").agg(F.count_if("learn").alias("n"), F.count("*").alias("every")))
    totals = stored(pairs.groupBy("c").agg(F.sum("n").alias("n_c"), F.sum("every").alias("every")).where("n_c > 0 and every > 1").select("c", "n_c"))
    gate = lambda n: F.floor(F.log2(n)).cast("int")
    # of the occurrences in contexts with n others: how many were met among these
    met = pairs.join(totals.where("n_c > 1"), "c").groupBy(gate(F.col("n_c") - 1).alias("g")).agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    shares = {r["g"]: min(max(r["share"], 0.01), 0.99) for r in met.collect()}  # one row for each power of two
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), gate(F.col("others"))), F.lit(0.01)) if shares else F.lit(0.01)
    here = rows.join(totals, "c").withColumn("others", F.col("n_c") - F.col("own_c")).where("others > 0")
    here = here.join(pairs.where("n > 0").select("c", "s", "n"), ["c", "s"], "left").withColumn("share", share)
    p = F.col("share") * (F.coalesce("n", F.lit(0)) - F.col("own")) / F.col("others")
    # log10(p + (1 - share) * 10 ** bits) - bits, with no loss where the second term is tiny
    rest = F.log10(1 - F.col("share"))
    gain = F.when(p > 0, F.log10(p) - F.col("bits") + F.log10(1 + F.pow(F.lit(10.0), F.greatest(rest + F.col("bits") - F.log10(p), F.lit(-300.0))))).otherwise(rest)
    out = stored(here.select("row", gain.alias("gain")).groupBy("row").agg(F.sum("gain").alias("gain")))
    discard(rows, pairs, totals)
    return out


def score_text(docs: DataFrame, divisor: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts by a model of those outside the held-out split.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add
    half, over token counts), score (the model's log10 probability) and
    bits_per_byte.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = keyed(named).withColumn("learn", remainder("doc_id", divisor) != held)
    table = stored(words(made))
    mixer = train(made.where("learn"))
    texts = made.where("learn").count()
    facts = table.where("n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (facts["n"] or 0) + texts, facts["v"] + (texts > 0)
    whole = total + 0.5 * (distinct + 1)
    scored = _scored(made, mixer, frequent(table), whole, texts)
    rare = scored.select("row", F.inline("rare")).join(table.select("h", "n"), "h").groupBy("row")
    rare = stored(rare.agg(F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / whole)).alias("more_base"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("more_known")))
    discard(table)
    both = scored.drop("rare", "stretches").join(rare, "row", "left").join(_gain(scored), "row", "left")
    score = F.col("bits") + F.coalesce("gain", F.lit(0.0))
    return both.select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        (F.col("met") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (-score * math.log2(10) / F.greatest("length", F.lit(1))).alias("bits_per_byte"),
    )
