"""Near copies by fingerprints of 64 bits, linked by meeting in the middle.

A fingerprint's bit is 1 if it is set in over half of the hashes of the text's word
shingles, repeats included.  Two fingerprints that differ in at most ``radius``
bits have a variant in common that differs from each in half as many, so every
distinct fingerprint emits all of its variants within half the radius, and what
meets in a variant is close enough: a variant meets at most 65 fingerprints at
the radius of 2, whatever the corpus holds.  Each of them is linked with the
smallest of its bucket, links are verified, and components are taken over
fingerprints, so copies of a text are one node and never paired.

Null or empty texts have the fingerprint zero, which is linked like any other.
Very long texts are hashed whole.  Every row keeps the fingerprint of its own
text, also where rows share a doc_id; repeated rows are returned as often as they
stand there.  Rows without a doc_id are linked with nothing and have no
component.  Other columns are not read; an empty table gives an empty one.  Jobs
run when the function is called; the tables that the result reads stay in the
shared folder.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text
from .common import discard, documents, per_block, stored
from .graph import components

SEED = 42


def shingle_hashes(block: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a block's texts, and how many each text has."""
    data, at = text.raw(block.column("text"))
    data = text.LOWER[data]
    starts, ends, first = text.spans(data, at, text.SPACED)
    length = ends - starts
    begin = np.cumsum(length + 1) - (length + 1)
    joined = np.full(int((length + 1).sum()), 0x20, np.uint8)  # one blank behind each word
    joined[text.stretches(begin, length)] = data[text.stretches(starts, length)]
    words = np.diff(first)
    counts = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    head = text.stretches(first[:-1], counts)
    last = np.minimum(head + size - 1, np.repeat(first[1:] - 1, counts))
    flat, hashed = joined.tobytes(), xxhash.xxh64_intdigest
    spans = zip(begin[head].tolist(), (begin[last] + length[last]).tolist(), strict=True)
    return np.fromiter((hashed(flat[a:b], SEED) for a, b in spans), np.uint64, len(head)), counts


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits set in over half of each text's hashes (0 for no hashes)."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        begin = np.cumsum(counts) - counts
        bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)
        sums = np.add.reduceat(bits, begin[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * sums > counts[full, None], axis=1).view(np.uint64)[:, 0]
    return out.view(np.int64)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a long."""

    def run(block):
        return pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(majorities(*shingle_hashes(block, size)))], ["doc_id", "fp"])

    return per_block(documents(docs), run, "doc_id long, fp long")


def close_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """a and b of links that join all distinct fingerprints (fp) within the radius.

    In each bucket of a common variant every member is linked with the smallest.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius is an even number of bits")
    masks = [sum(1 << b for b in some) for k in range(radius // 2 + 1) for some in combinations(range(64), k)]
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    variants = F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: m.bitwiseXOR(F.col("fp")))
    met = nodes.select("fp", F.explode(variants).alias("variant"))
    met = met.withColumn("low", F.min("fp").over(Window.partitionBy("variant"))).where("low <> fp")
    pairs = met.select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_groups(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """Per row doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links."""
    made = stored(fingerprints(docs, size))
    nodes = stored(made.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = stored(close_pairs(nodes, radius))
    labels = components(links)
    named = stored(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))
    whole = named.join(named.groupBy("label").agg(F.min("first").alias("component")), "label").select("fp", "component")
    whole = stored(whole)
    discard(nodes, links, labels, named)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return made.join(whole, "fp", "left").select("doc_id", shown.alias("fingerprint"), component.alias("component_id"))
