"""Near-duplicate documents by min-max hashing.

A text's set holds its distinct word shingles.  Each of H hash functions gives
two signature values, the least and the greatest hash of the set, so a signature
of 2H values costs H evaluations.  Bands of consecutive values are the buckets
in which sets meet; the number of bands follows from the similarity so that a
pair right at the threshold is missed with a chance under ``MISS``.

Equal sets are folded into their smallest id first.  In every bucket the member
with the smallest label is compared with the members of other labels; confirmed
links (on the full sets) merge labels, and this repeats while it links anything.
Then all pairs that still have different labels, were not compared and can reach
the similarity (they share a rare shingle) are confirmed, so no bucket is capped;
pairs inside one component are never expanded.

Nulls, empty texts: no shingles, linked with nothing.  A text with fewer words
than a shingle is one shingle, its whole sequence.  Rows of one doc_id count as
one document (with different texts: the set with the least digest is its own);
rows without a doc_id are linked with nothing and kept.  Shingles are told apart
by 64-bit hashes, sets by 128 bits and their size.  Jobs run when the function is
called; the labels that the result reads stay in the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text
from .common import discard, documents, per_block, stored
from .graph import components

MISS = 1e-8
SKETCH = 1024


def banding(similarity: float, miss: float = MISS) -> tuple[int, int]:
    """Rows a band, and bands (an even number of values in all)."""
    rows = 6 if similarity >= 0.85 else 5
    bands = math.ceil(math.log(miss) / math.log(1 - similarity**rows))
    return rows, bands + bands % 2


def shingle_sets(block: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each begins."""
    data, at = text.raw(block.column("text"))
    data = text.LOWER[data]
    starts, ends, first = text.spans(data, at, text.SPACED)
    words, rows = text.hashes(data, starts, ends), text.owners(first)
    grams = text.grams(words, size)
    whole = rows[: len(grams)] == rows[size - 1 : size - 1 + len(grams)]
    owner, value = [rows[: len(grams)][whole]], [grams[whole]]
    counts = np.diff(first)
    for r in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        owner.append(np.array([r]))
        value.append(text.grams(words[first[r] : first[r + 1]], int(counts[r])) ^ np.uint64(counts[r]))
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(block.num_rows + 1))


def digests(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two columns."""
    two = np.zeros((2, len(at) - 1), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        two[0, full] = np.add.reduceat(text.mix(values), at[:-1][full])
        two[1, full] = np.add.reduceat(text.mix(values ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][full])
    return two[0].view(np.int64), two[1].view(np.int64)


def signatures(docs: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, and one key a band."""
    functions = rows * bands // 2
    draw = np.random.default_rng(11)
    odd = draw.integers(0, 1 << 63, functions, np.uint64) * np.uint64(2) + np.uint64(1)
    mask = draw.integers(0, 1 << 63, functions, np.uint64)

    def run(block):
        values, at = shingle_sets(block, size)
        counts = np.diff(at)
        full = np.flatnonzero(counts)
        begin = at[:-1][full]
        keys = np.zeros((len(full), bands), np.uint64)
        if len(full):
            signature = np.empty((len(full), 2 * functions), np.uint64)
            for k in range(functions):
                hashed = (values ^ mask[k]) * odd[k]
                signature[:, 2 * k] = np.minimum.reduceat(hashed, begin)
                signature[:, 2 * k + 1] = np.maximum.reduceat(hashed, begin)
            for b in range(bands):
                total = np.full(len(full), b, np.uint64)
                for k in range(rows):
                    total = text.mix(total * np.uint64(31) + signature[:, b * rows + k])
                keys[:, b] = total
        cuts = np.cumsum([0, *np.where(counts, bands, 0)])
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(keys.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(counts), *map(pa.array, digests(values, at)), lists], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return per_block(docs, run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame, fold: DataFrame, size: int) -> DataFrame:
    """Shingles of each node, and a sketch: the parity of each of SKETCH classes of them.

    Sketches differ in no more bits than the sets in shingles.
    """

    def run(block):
        values, at = shingle_sets(block, size)
        n = block.num_rows
        owner = np.repeat(np.arange(n), np.diff(at))
        parity = np.bincount(owner * SKETCH + (values % np.uint64(SKETCH)).astype(np.int64), minlength=n * SKETCH) & 1
        bits = np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)
        sketch = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (SKETCH // 64), pa.int32()), pa.array(bits))
        shingles = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))
        return pa.RecordBatch.from_arrays([block.column("doc_id"), *map(pa.array, digests(values, at)), shingles, sketch], ["node", "d1", "d2", "shingles", "sketch"])

    made = per_block(docs, run, "node long, d1 long, d2 long, shingles array<long>, sketch array<long>")
    return made.join(fold.select("node", "d1", "d2"), ["node", "d1", "d2"]).drop("d1", "d2").dropDuplicates(["node"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    return both.where(100 * shared >= percent * union).select("a", "b")


def _rest(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs under different labels that can still be links.

    Of the members of buckets with several labels, two similar sets share one of
    their rarest shingles: so many that what is left could not reach the
    similarity.  Sizes, ranks of the shared shingle and sketches bound the overlap further.  Frequent shingles, such as those of a passage that many texts
    hold, thus bring no pairs about.
    """
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    open_nodes = placed.join(mixed, "bucket").select("node", "label").distinct()
    single = sets.join(open_nodes, "node").select("node", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    single = single.join(single.groupBy("shingle").count(), "shingle")
    order = Window.partitionBy("node").orderBy("count", "shingle")
    rare = single.withColumn("rank", F.row_number().over(order)).where(f"rank <= n - (({percent} * n + 99) div 100) + 1").select("shingle", "node", "label", "n", "rank")
    most = rare.groupBy("shingle", "label").count().groupBy("shingle").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    rare = stored(rare.join(most, "shingle").join(sets.select("node", "sketch"), "node"))
    few = rare.where("label <> most").select("shingle", F.col("node").alias("p"), F.col("label").alias("q"), F.col("n").alias("m"), F.col("rank").alias("at"), F.col("sketch").alias("bits"))
    overlap = F.least("at", "rank") + F.least(F.col("m") - F.col("at"), F.col("n") - F.col("rank"))  # at most
    enough = overlap * (100 + percent) >= percent * (F.col("m") + F.col("n"))
    differ = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("sketch")[k])) for k in range(SKETCH // 64)), F.lit(0))  # at least
    near = differ * (100 + percent) <= (100 - percent) * (F.col("m") + F.col("n"))
    both = few.join(rare, (few["shingle"] == rare["shingle"]) & (few["q"] != rare["label"]) & enough & near)
    return both.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Link documents whose shingle sets have at least the Jaccard similarity.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable
    over links, its own included) and kept (doc_id = component_id).
    """
    percent = round(100 * similarity)
    rows, bands = banding(similarity)
    docs = documents(docs)
    made = stored(signatures(docs, shingle, rows, bands))
    full = made.where("n_shingles > 0 and doc_id is not null")
    keys = ["d1", "d2", "n_shingles"]
    own = full.groupBy("doc_id").agg(F.min(F.struct(*keys)).alias("set")).select("doc_id", "set.*")
    fold = stored(own.groupBy(*keys).agg(F.min("doc_id").alias("node")))
    first = full.join(fold, keys).where("doc_id = node")
    exploded = first.select("node", F.explode("bands").alias("bucket")).distinct()
    shared = exploded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")
    members = stored(exploded.join(shared, "bucket"))
    nodes = members.select("node").distinct()
    sets = stored(_sets(docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi"), fold.join(nodes, "node"), shingle))
    labels = stored(nodes.withColumn("label", F.col("node")))
    tested: DataFrame | None = None
    found: list[DataFrame] = []
    compared: list[DataFrame] = []
    everything = False
    while True:
        placed = members.join(labels, "node")
        if everything:
            pairs = _rest(placed, sets, percent)
        else:
            low = placed.groupBy("bucket").agg(F.min(F.struct("label", "node")).alias("low"), F.max("label").alias("high")).where("low.label < high")
            pairs = placed.join(low, "bucket").where("label <> low.label").select(F.least("low.node", "node").alias("a"), F.greatest("low.node", "node").alias("b"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        elif not everything:  # at first, one leader for each member is enough
            pairs = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        pairs = stored(pairs)
        links = stored(_confirm(pairs, sets, percent))
        some = not links.isEmpty()
        tested = pairs if tested is None else tested.union(pairs)
        compared.append(pairs)
        found.append(links)
        if some:
            at = labels.select(F.col("node").alias("a"), F.col("label").alias("p"))
            to = labels.select(F.col("node").alias("b"), F.col("label").alias("q"))
            merged = components(links.join(at, "a").join(to, "b").select(F.col("p").alias("a"), F.col("q").alias("b")))
            after = stored(labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("lower")), "label", "left").select("node", F.coalesce("lower", "label").alias("label")))
            discard(labels, merged)
            labels = after
        if everything:
            break
        everything = not some
    whole = fold.join(labels, "node", "left").select(*keys, F.coalesce("label", "node").alias("component"))
    whole = own.join(whole, keys).select("doc_id", F.col("n_shingles").alias("n"), "component")
    out = stored(made.select("doc_id", "n_shingles").join(whole, "doc_id", "left"))
    discard(made, fold, members, sets, labels, *found, *compared)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.coalesce("n", "n_shingles").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
