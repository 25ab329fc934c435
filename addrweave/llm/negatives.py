"""Hard negatives by a secondary-sort shuffle of scored pairs.

Anchors are scored against all rows in blocks: rows are dealt to groups of about
``GROUP`` by a hash of their id, each group meets ``ANCHORS`` anchors at a time, and
a task forms the integer products of one such block.  Of each block an anchor
keeps its best positives and every negative that can still be returned: with t
the score of the block's last kept positive, the anchor's positives score at
least t, so of the negatives that any window lets in from above (100 * score <=
high * t) only the first few can count, and those above that are all kept.  What
is left is one row a pair whose key is (anchor, descending score, id) packed in
24 bytes; rows are dealt by anchor and sorted by key inside the partitions, and
an iterator over the sorted batches opens a window at each positive and emits
negatives until the window is full or passed.  It holds an anchor's few open
windows, never its rows.

Rows with a null id, label or vector, or with a null or non-finite component, take
no part; of rows that share an id the least (label, vector) counts.  Vectors of
other lengths than the anchor's are not its candidates; empty vectors score 0.
Equal scores are ordered by id.  Products are exact while scores stay below 2**63.
Fewer positives or negatives than wanted are all returned; an empty table gives
an empty one.  Other columns are not read.  Jobs run when the function is called.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

GROUP = 1 << 13
ANCHORS = 1 << 13
AT_ONCE = 64
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label and vec (whole numbers) of the rows that take part, one an id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < math.inf))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)
    return rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec")


def matrix(vectors: pa.ChunkedArray, rows: np.ndarray, size: int) -> np.ndarray:
    """floor(256 * x) of vectors of one length, as doubles if products stay exact, else as longs."""
    flat = vectors.take(pa.array(rows)).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.floor(256 * flat).reshape(len(rows), size)
    return flat if not flat.size or size * np.abs(flat).max() ** 2 < 2**53 else np.clip(flat, -(2.0**62), 2.0**62).astype(np.int64)


def kept_pairs(scores: np.ndarray, same: np.ndarray, ids: np.ndarray, positives: int, negatives: int, high: int) -> np.ndarray:
    """Places of one anchor's candidates in a block that can still matter."""
    order = np.lexsort((ids, ~scores))
    mine = same[order]
    first = order[mine][:positives]
    others = order[~mine]
    if len(first) < positives or not len(others):
        return np.concatenate([first, others])
    above = np.searchsorted(~scores[others], ~(high * int(scores[first[-1]]) // 100))  # those over high % of the least kept positive
    return np.concatenate([first, others[: above + negatives]])


def packed(anchor: int, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Three unsigned numbers a pair, which big-endian sort as (anchor, descending score, id)."""
    key = np.empty((len(ids), 3), np.int64)
    key[:, 0], key[:, 1], key[:, 2] = anchor, ~scores, ids
    return key.view(np.uint64) ^ np.uint64(1 << 63)


def unpacked(keys: pa.Array) -> np.ndarray:
    _, offsets, data = keys.buffers()
    begin = np.frombuffer(offsets, np.int32)[keys.offset]
    key = np.frombuffer(data, ">u8", 3 * len(keys), int(begin)).astype(np.uint64).reshape(-1, 3) ^ np.uint64(1 << 63)
    key = key.view(np.int64)
    key[:, 1] = ~key[:, 1]
    return key


def scored_pairs(rows: DataFrame, is_anchor: Column, positives: int, negatives: int, high: int) -> DataFrame:
    """key and same (whether labels agree) of the pairs that can matter."""
    anchors = rows.where(is_anchor)
    n, asked = rows.count(), anchors.count()
    groups, parts = math.ceil(n / GROUP) or 1, math.ceil(asked / ANCHORS) or 1
    every = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    of = lambda count, name: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias(name)
    left = anchors.select("*", of(parts, "part")).select("*", every(groups, "grp"))
    right = rows.select("*", of(groups, "grp")).select("*", every(parts, "part"))

    def block(anchor: pa.Table, table: pa.Table) -> pa.Table:
        keys, flags = [], []
        dims, theirs = (t.column("vec").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) for t in (anchor, table))
        for size in np.unique(dims).tolist():
            a, b = np.flatnonzero(dims == size), np.flatnonzero(theirs == size)
            x, y = matrix(anchor.column("vec"), a, size), matrix(table.column("vec"), b, size)
            if x.dtype != y.dtype or (x.size and y.size and size * float(np.abs(x).max()) * float(np.abs(y).max()) >= 2**53):
                x, y = x.astype(np.int64), y.astype(np.int64)
            who, what = (anchor.column(c).to_numpy()[a] for c in ("id", "label"))
            ids, labels = (table.column(c).to_numpy()[b] for c in ("id", "label"))
            for k in range(0, len(a), AT_ONCE):
                products = (x[k : k + AT_ONCE] @ y.T).astype(np.int64)
                for i, scores in enumerate(products, k):
                    other = ids != who[i]
                    own, value = ids[other], scores[other]
                    same = labels[other] == what[i]
                    some = kept_pairs(value, same, own, positives, negatives, high)
                    keys.append(packed(int(who[i]), value[some], own[some]))
                    flags.append(same[some])
        flat = np.concatenate(keys).astype(">u8").tobytes() if keys else b""
        count = len(flat) // 24
        key = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(np.arange(0, 24 * count + 1, 24, dtype=np.int32)), pa.py_buffer(flat)])
        return pa.table({"key": key, "same": pa.array(np.concatenate(flags) if flags else np.zeros(0, bool))})

    return left.groupBy("grp", "part").cogroup(right.groupBy("grp", "part")).applyInArrow(block, "key binary, same boolean")


def windows(batches, positives: int, negatives: int, low: int, high: int):
    """Stream pairs in order of their keys; emit the first negatives of each positive's window."""
    anchor, opened, zeros = None, [], []  # opened: id, score and number of negatives so far
    for batch in batches:
        out = []
        key, same = unpacked(batch.column("key")), batch.column("same").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(key[:, 0])) + 1).tolist(), len(key)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if begin == end:
                continue
            if key[begin, 0] != anchor:
                anchor, opened, zeros = int(key[begin, 0]), [], []
            score, ids, mine = key[begin:end, 1], key[begin:end, 2], same[begin:end]
            earlier = len(opened)
            opened += [[int(ids[k]), int(score[k]), 0] for k in np.flatnonzero(mine)[: positives - earlier]]
            for w in opened:
                # only a positive of score 0 has negatives before it: those of score 0
                held = zeros if w[1] == 0 and w in opened[earlier:] else []
                fits = np.flatnonzero(~mine & (score <= high * w[1] // 100) & (score >= -(-low * w[1] // 100)))[: max(0, negatives - w[2] - len(held))]
                for other, value in [*held, *zip(ids[fits].tolist(), score[fits].tolist(), strict=True)]:
                    w[2] += 1
                    out.append((anchor, w[0], w[2], other, w[1], value))
            zeros += [(x, 0) for x in ids[~mine & (score == 0)][: negatives - len(zeros)].tolist()]
        names = [c.split()[0] for c in _OUT.split(", ")]
        types = [pa.int32() if c == "rank" else pa.int64() for c in names]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor and each of its best positives, the best negatives inside the positive's window.

    ``is_anchor`` is a condition on ``id``.  A negative fits a positive if low *
    positive_score <= 100 * negative_score <= high * positive_score.
    """
    rows = stored(usable(vectors, id_col, label_col, vector_col))
    pairs = scored_pairs(rows, is_anchor, positives, negatives, high)
    ordered = pairs.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")
    return ordered.mapInArrow(lambda batches: windows(batches, positives, negatives, low, high), _OUT)
