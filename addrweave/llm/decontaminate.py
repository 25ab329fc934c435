"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

Texts and benchmark items are sequences of words (lower-cased).  The CGK random
walk reads a window of words: in each step it puts out the word under the
pointer, and a random function of step and word decides whether the pointer moves
on.  After an edit two walks meet again with high probability, so a small edit
distance becomes a small Hamming distance of the walks.  Samples of walk
positions are keys; a text's window and an item's window with an equal key are
candidates.

Windows are sized by the item (``LADDER``).

- Items of at most ``EXACT`` words may not be edited at all (a fifth of them is
  less than one word), so the whole item is one key, held against every place.
- Items of fewer than ``LONG`` words give windows of all but a word or two, texts
  a window at every word.
- Longer items give windows of at most two thirds of their words, at each of
  their words.  Texts give windows at their *anchors*, words with the least hash
  of some ``ANCHORS`` in a row: any ``ANCHORS`` consecutive words have one, the
  same in a text and in an item that it holds.

A walk sees nothing but its window, so an unedited copy is always found.  Steps and
samples of each size are such that at least ``TARGET`` of the items with as many
edits as are allowed get a candidate (tests measure it for items of all lengths).

Of the texts' keys only those in a bitmap of the items' keys (16 bits a key, 32 MB
at most) leave the task; an ordinary join then finds the items.  Candidates that
lack more of an item's words than edits are allowed can't be leaks; for all others
the edit distance of the item to the best place around the candidate is computed
exactly, word by word.

Nulls and empty texts hold nothing, and items without a word are in nothing.
Rows without an id are left out.  Repeated rows, of either table, give one row for
each pair of ids; of different texts under one id the best place counts.  Jobs
run when the function is called.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .common import bitmap, discard, documents, per_block, stored

EXACT = 4
LONG = 15
LADDER = (4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128)
ANCHORS = 4
WALKS = 2
TARGET = 0.95
MAX_EDITS = 0.2
PAIRS = 4096

_PAD = np.uint64(0x1B873593CC9E2D51)
_FACTOR = np.uint64(0x2545F4914F6CDD1D)


def steps_of(size: int) -> int:
    """Walk positions in a key: few for short windows, which edits hit harder."""
    return 3 if size < 8 else 4 if size < 16 else 5


def samples_of(size: int) -> int:
    """Keys of a walk: more for short windows, of which an item has few."""
    return 12 if size < 8 else 6 if size < 16 else 4


@functools.cache
def plan(seed: int = 23):
    """The steps sampled for each (walk, size), and the walks' random functions."""
    draw = np.random.default_rng(seed)
    odd = draw.integers(0, 1 << 63, (WALKS, LADDER[-1] * 3 // 2), np.uint64) * np.uint64(2) + np.uint64(1)
    chosen = {(w, size): [np.sort(draw.choice(size * 3 // 2, steps_of(size), replace=False)) for _ in range(samples_of(size))] for w in range(WALKS) for size in LADDER}
    return odd, chosen


def keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size the keys of the windows at ``starts``; one row a key.

    ``ends`` is where each window's text ends; behind a window or text stands padding.
    """
    odd, chosen = plan()
    mixed = text.mix(np.append(words, _PAD))
    out = {size: np.full((WALKS * samples_of(size), len(starts)), size, np.uint64) for size in sizes}
    for walk in range(WALKS):
        at = starts.copy()
        for step in range(max((size * 3 // 2 for size in sizes), default=0)):
            here = mixed[np.where(at < ends, at, len(words))]
            for size in sizes:
                wanted = [k for k, sample in enumerate(chosen[walk, size]) if step in sample]
                if wanted:
                    seen = np.where(at < starts + size, here, mixed[-1]) if step >= size else here
                    for k in wanted:
                        row = out[size][walk * samples_of(size) + k]
                        row ^= seen
                        row *= _FACTOR
            at += (here * odd[walk, step] >> np.uint64(63)).astype(np.int64)
    for made in out.values():
        made ^= np.arange(1, len(made) + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return {size: text.mix(made) for size, made in out.items()}


def _words(texts: pa.Array):
    data, at = text.raw(texts)
    data = text.LOWER[data]
    starts, ends, first = text.spans(data, at, text.ALNUM)
    return text.hashes(data, starts, ends), first


def phrases(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all stretches of n words inside a text, and where they start."""
    found = text.grams(words, n)
    rows = text.owners(first)
    at = np.flatnonzero(rows[: len(found)] == rows[n - 1 : n - 1 + len(found)])
    return text.mix(found[at] + np.uint64(n)), at


def anchors(words: np.ndarray) -> np.ndarray:
    """Words with the least hash of some ANCHORS in a row."""
    least = text.sliding_min(words, ANCHORS)
    mark = np.ones(len(words), bool)
    mark[: len(least)] = False
    for k in range(ANCHORS):
        mark[k : k + len(least)] |= words[k : k + len(least)] == least
    return np.flatnonzero(mark)


def item_size(n: int) -> int:
    """Words of an item's windows: the whole of a short one; 0 without words."""
    if n <= EXACT:
        return n
    return max(size for size in LADDER if size <= (n - 1 if n < LONG else 2 * n // 3))


def item_windows(items: DataFrame) -> DataFrame:
    """key, item_id, place (word), size and kind (exact, short or long) of all windows of all items."""

    def run(block):
        words, first = _words(block.column("text"))
        n = np.diff(first)
        sizes = np.array([item_size(int(k)) for k in n], np.int64)
        parts = []
        for kind, low, high in (("exact", 1, EXACT), ("short", EXACT + 1, LONG - 1), ("long", LONG, 1 << 62)):
            for size in np.unique(sizes[(n >= low) & (n <= high)]).tolist():
                rows = np.flatnonzero((sizes == size) & (n >= low) & (n <= high))
                count = n[rows] - size + 1
                row = np.repeat(rows, count)
                place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                if kind == "exact":
                    made, at = phrases(words, first, size)
                    every = [made[np.searchsorted(at, first[row])]]
                else:
                    every = keys(words, first[row] + place, first[row + 1], [size])[size]
                parts += [(key, row, place, np.full(len(row), size), [kind] * len(row)) for key in every]
        made, row, place, size = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4))
        kinds = pa.array([kind for p in parts for kind in p[4]], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), block.column("doc_id").take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)), kinds], ["key", "item_id", "place", "size", "kind"])

    return per_block(items, run, "key long, item_id long, place int, size int, kind string").distinct()


def candidates(docs: DataFrame, bits: np.ndarray, sizes: list[tuple[str, int]]) -> DataFrame:
    """key, doc_id, fp, at (word) of the texts' windows that the bitmap lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    of = {kind: sorted(size for k, size in sizes if k == kind) for kind in ("exact", "short", "long")}

    def run(block):
        words, first = _words(block.column("text"))
        rows = text.owners(first)
        found, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

        def keep(key, at):
            hit = text.passes(shared.value, key)
            found.append(key[hit])
            where.append(at[hit])

        for n in of["exact"]:
            key, at = phrases(words, first, n)
            keep(key, at)
            key, at = found.pop(), where.pop()
            _, one = np.unique(np.stack([key, rows[at].astype(np.uint64)]), axis=1, return_index=True)  # one place is enough
            found.append(key[one])
            where.append(at[one])
        for kind, starts in (("short", np.arange(len(words))), ("long", anchors(words))):
            if of[kind]:
                for made in keys(words, starts, first[rows[starts] + 1], of[kind]).values():
                    for row in made:
                        keep(row, starts)
        key, at = np.concatenate(found), np.concatenate(where)
        owner = rows[at]
        take = pa.array(owner)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), block.column("doc_id").take(take), block.column("fp").take(take), pa.array((at - first[owner]).astype(np.int32))], ["key", "doc_id", "fp", "at"])

    return per_block(docs, run, "key long, doc_id long, fp long, at int")


def best_place(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to a stretch of the words, and where that ends."""
    row = np.zeros(len(words) + 1, np.int64)
    step = np.arange(len(words) + 1)
    for k, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (words != w), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    end = int(row.argmin())
    return int(row[end]), end


def flat_lists(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All elements of the lists, and the number of the list that each is of."""
    lists = pa.concat_arrays([lists])
    return lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _stretches(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all stretches one after the other, and the stretch that each is of."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + begin[of], of


def shared_words(words: np.ndarray, begin: np.ndarray, size: np.ndarray, items: np.ndarray, item_begin: np.ndarray, item_size: np.ndarray) -> np.ndarray:
    """How many words of its item stand in each stretch (at least: hashes may agree by chance).

    An item that is k edits away from a stretch has all but k of its words in it.
    """
    at, of = _stretches(begin, size)
    item_at, item_of = _stretches(item_begin, item_size)
    here = words[at] ^ text.mix(of.astype(np.uint64) + _PAD)
    there = items[item_at] ^ text.mix(item_of.astype(np.uint64) + _PAD)
    return np.bincount(item_of, np.isin(there, here), len(size)).astype(np.int64)


def find_leaks(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, edited at most so much.

    Returns doc_id, item_id, n_words (of the item), edits (the least word edit
    distance), first_word (where that place begins, about) and similarity.
    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    if max_edits > MAX_EDITS:
        raise ValueError(f"windows and samples are made for at most {MAX_EDITS:.0%} of edits")
    items = documents(items, "item_id").where("doc_id is not null").withColumn("text", F.lower("text"))
    docs = documents(docs).where("doc_id is not null").withColumn("fp", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("text", F.lower("text"))
    windows = stored(item_windows(items))
    sizes = [(r["kind"], r["size"]) for r in windows.select("kind", "size").distinct().collect()]  # of the few that there are
    hits = candidates(docs, bitmap(windows, "key"), sizes).join(windows, "key").select("doc_id", "fp", "item_id", (F.col("at") - F.col("place")).alias("start"))
    hits = hits.groupBy("doc_id", "fp", "item_id").agg(F.collect_set("start").alias("starts"))
    lists = hits.join(items.select(F.col("doc_id").alias("item_id"), F.col("text").alias("item")).distinct(), "item_id").groupBy("doc_id", "fp").agg(F.collect_list(F.struct("item_id", "item", "starts")).alias("found"))
    texts = docs.join(lists.withColumnsRenamed({"doc_id": "d", "fp": "f"}), (F.col("doc_id") == F.col("d")) & (F.col("fp") == F.col("f"))).select("doc_id", "text", "found")

    def verify(block):
        words, first = _words(block.column("text"))
        found, row = flat_lists(block.column("found"))
        doc_ids, item_ids = block.column("doc_id").to_pylist(), found.field("item_id").to_pylist()
        out = []
        for begin in range(0, len(found), PAIRS):
            rows = row[begin : begin + PAIRS]
            part = found.take(pa.array(np.arange(begin, begin + len(rows))))
            items_of, item_first = _words(part.field("item"))
            n = np.diff(item_first)
            allowed = (max_edits * n).astype(np.int64)
            starts, pair = flat_lists(part.field("starts"))
            starts = starts.to_numpy().astype(np.int64)
            order = np.lexsort((starts, pair))
            starts, pair = starts[order], pair[order]
            low = np.maximum(starts - allowed[pair], 0)
            high = np.minimum(starts + n[pair] + allowed[pair], np.diff(first)[rows[pair]])
            near = shared_words(words, first[rows[pair]] + low, high - low, items_of, item_first[pair], n[pair]) >= (n - allowed)[pair]
            best: dict[int, tuple[int, int]] = {}
            seen: dict[int, int] = {}
            for k, a, b in zip(pair[near].tolist(), low[near].tolist(), high[near].tolist(), strict=True):
                if b <= seen.get(k, -1):
                    continue
                seen[k] = b
                item = items_of[item_first[k] : item_first[k + 1]]
                edits, end = best_place(item, words[first[rows[k]] + a : first[rows[k]] + b])
                if edits <= allowed[k] and (k not in best or edits < best[k][0]):
                    best[k] = (edits, max(0, a + end - len(item)))
            for k, (edits, at) in best.items():
                out.append((doc_ids[rows[k]], item_ids[begin + k], int(n[k]), edits, at, 1 - edits / int(n[k])))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(),) * 5 + (pa.float64(),)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_words", "edits", "first_word", "similarity"])

    made = per_block(texts, verify, "doc_id long, item_id long, n_words long, edits long, first_word long, similarity double")
    best = F.min(F.struct("edits", "first_word", "n_words", "similarity")).alias("best")
    return made.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_words", "best.edits", "best.first_word", "best.similarity")
