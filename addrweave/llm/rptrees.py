"""Approximate nearest neighbours: a forest of random-projection trees.

Nearness is the largest inner product.  Vectors get one more component that
makes all lengths equal, so that the inner product orders them as distance does.
Equal vectors are folded to one node first; only the ``k + 1`` smallest ids of a
node can ever be among a query's nearest.

A tree splits at the median of the projections on the line through two random
points.  The planes are fitted on a bounded sample (about ``SAMPLE`` nodes, by
hash), and every vector is then routed to its leaf in every tree.  The depth
follows the number of vectors until the sample has ``LEAST`` points a leaf or
``LEAVES`` are no more than ``SHARE`` of all leaves; from there leaves grow with
the table, so that a query's share of the table does not shrink.  A query walks
all trees through one priority queue, the best margin first, until it holds
``LEAVES`` leaves.

Vectors are dealt to *buckets* of about ``BUCKET`` by the leaf of the first tree, each
to one (a leaf that holds more is dealt to several), and carry their leaves in all
trees; a bucket gives a query its best nodes among those in the query's leaves.  So a
task's group is bounded at any size of the table, and no node is met twice.  Buckets
are visited in rounds: a query's own bucket, then the next one, two, four, ...  What
a bucket returns must reach the query's last place so far, so a round that doubles
what was seen returns about as many rows as a query has places, and all rounds
together grow with the queries (times the logarithm of the buckets) instead of with
queries times buckets.  No node that belongs among the best of the leaves is lost
by that.  The scores of the best ``k + 1`` (and ``SPARE`` more, for ties) are computed
again from the original vectors, in double precision and component by component, so
equal vectors have equal scores wherever they were met.

Null vectors, those with null or non-finite components, of length zero, or of
another dimension than the most common one, take no part.  Of the vectors of one
vec_id one counts (the least digest).  With fewer candidates than ``k`` all found
are returned.  Jobs run when the function is called.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

TREES = 16
LEAF = 128
LEAST = 8
SAMPLE = 20_000
LEAVES = 320
SHARE = 1 / 26
BUCKET = 10_000
SPARE = 10


def depth_for(n: int) -> int:
    """Depth of the trees over n vectors."""
    depth = 0
    while n / (1 << depth) > LEAF and min(n, SAMPLE) / (2 << depth) >= LEAST and LEAVES / (TREES << depth + 1) >= SHARE:
        depth += 1
    return depth


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (float or double) of the rows that take part."""
    kind = vectors.select(vector_col).schema[0].dataType.simpleString()
    vector = F.col(vector_col) if kind == "array<float>" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (size["d"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Forest:
    """Planes of all trees, as arrays: node n of a tree has children 2n+1 and 2n+2."""

    def __init__(self, points: np.ndarray, depth: int, trees: int, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.depth = depth
        inner = (1 << depth) - 1
        self.planes = np.zeros((trees, inner, points.shape[1]))
        self.cuts = np.zeros((trees, inner))
        for t in range(trees):
            groups = {0: np.arange(len(points))}
            for node in range(inner):
                own = groups.pop(node, np.zeros(0, np.int64))
                if len(own) > 1:
                    a, b = draw.choice(own, 2, replace=False)
                    line = points[a] - points[b]
                    line /= np.linalg.norm(line) or 1.0
                    at = points[own] @ line
                    cut = float(np.median(at))
                    self.planes[t, node], self.cuts[t, node] = line, cut
                    groups[2 * node + 1], groups[2 * node + 2] = own[at <= cut], own[at > cut]

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point in each tree."""
        out = np.zeros((len(points), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", points, self.planes[t, node]) > self.cuts[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def search(self, point: np.ndarray, wanted: int) -> list[tuple[int, int]]:
        """The first leaves (tree, leaf) that a shared priority queue reaches."""
        inner = (1 << self.depth) - 1
        margins = np.einsum("tnd,d->tn", self.planes, point) - self.cuts
        heap = [(-np.inf, t, 0) for t in range(len(self.planes))]
        found = []
        while heap and len(found) < wanted:
            priority, t, node = heapq.heappop(heap)
            while node < inner:
                m = float(margins[t, node])
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(heap, (max(priority, abs(m)), t, far))
                node = near
            found.append((t, node - inner))
        return found


def nearest(vectors: DataFrame, k: int = 20, divisor: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of every row whose id is divisible by ``divisor``, among all others.

    Returns query_id, rank (from 1), vec_id and score (the inner product).
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).withColumn("digest", F.md5(F.to_json("vector")))
    kind = rows.schema["vector"].dataType.simpleString()
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("digest", "vector")).alias("x")).select("vec_id", "x.digest", "x.vector")
    nodes = stored(rows.groupBy("digest").agg(F.min("vec_id").alias("node"), F.first("vector").alias("vector")))
    # of each node the k + 1 smallest ids: first among each of 64 parts, then among what is left
    salted = Window.partitionBy("digest", "salt").orderBy("vec_id")
    whole = Window.partitionBy("digest").orderBy("vec_id")
    ids = rows.select("digest", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    ids = ids.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1).select("digest", "vec_id")
    members = ids.join(nodes.select("digest", "node"), "digest").select("node", "vec_id")

    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    facts = nodes.agg(F.count("*").alias("n"), F.max(product("vector", "vector")).alias("square")).first()
    n, square = facts["n"], facts["square"] or 0.0
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(max(1, n // SAMPLE))) == 0).select("vector").toPandas()["vector"]  # about SAMPLE, 2 * SAMPLE at most

    def lifted(points: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(square - (points**2).sum(1), 0))
        return np.hstack([points, more[:, None]])

    depth = depth_for(n)
    points = lifted(np.array(sample.tolist(), np.float64)) if len(sample) else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(Forest(points, depth, TREES))  # as large as the sample at most, times TREES / LEAST

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.leaves(lifted(_matrix(batch.column("vector"))))
                cell = (np.arange(TREES)[None, :] << depth) + leaf
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * TREES, pa.int32()), pa.array(cell.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("vector"), lists], ["node", "vector", "cells"])

    routed = stored(nodes.select("node", "vector").mapInArrow(route, f"node long, vector {kind}, cells array<int>"))
    sizes = np.zeros(1 << depth, np.int64)
    for row in routed.groupBy(F.col("cells")[0].alias("cell")).count().collect():  # 1 << depth rows at most
        sizes[row["cell"]] = row["count"]
    parts = np.maximum(-(-sizes // BUCKET), 1)  # buckets of a large leaf
    base = np.where(parts > 1, 0, np.cumsum(np.where(parts > 1, 0, sizes)) // BUCKET)
    small = int(base.max(initial=0)) + 1
    base = np.where(parts > 1, small + np.cumsum(np.where(parts > 1, parts, 0)) - parts, base)
    buckets = int((base + parts).max(initial=1))
    dealt = spark.sparkContext.broadcast((base, parts))  # as many entries as leaves of a tree

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                base, parts = dealt.value
                cell = batch.column("cells").flatten().to_numpy()[::TREES]
                bucket = base[cell] + (batch.column("node").to_numpy() * 0x9E3779B1 >> 12) % parts[cell]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], ["bucket", "node", "vector", "cells"])

    def walk(batches):
        for batch in batches:
            if batch.num_rows:
                flat = _matrix(batch.column("vector"))
                plain = np.hstack([flat, np.zeros((len(flat), 1))])
                found = [np.array([(t << depth) + leaf for t, leaf in shared.value.search(p, LEAVES)], np.int32) for p in plain]
                home = dealt.value[0][shared.value.leaves(lifted(flat))[:, 0]]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("vector"), pa.array(home), lists], ["node", "vector", "home", "cells"])

    asked = rows.where(F.col("vec_id") % divisor == 0).select("digest", F.col("vec_id").alias("query_id")).distinct()
    asking = nodes.join(asked.select("digest").distinct(), "digest").select("node", "vector")
    index = routed.mapInArrow(deal, f"bucket long, node long, vector {kind}, cells array<int>").repartition(buckets, "bucket").groupBy("bucket")
    walks = stored(asking.mapInArrow(walk, f"node long, vector {kind}, home long, cells array<int>"))
    places = k + 1 + SPARE

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            right = right.sort_by("node")  # ties: the smaller id
            a, b = (_matrix(side.column("vector").combine_chunks()) for side in (left, right))
            query, near, least = left.column("node").to_numpy(), right.column("node").to_numpy(), left.column("least").to_numpy()
            lists = pa.concat_arrays(left.column("cells").chunks)
            cuts, asked = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            lies = pa.concat_arrays(right.column("cells").chunks).flatten().to_numpy().reshape(-1, TREES)
            for low in range(0, len(query), 128):
                high = min(low + 128, len(query))
                wanted = np.zeros((TREES << depth, high - low), bool)
                wanted[asked[cuts[low] - cuts[0] : cuts[high] - cuts[0]], np.repeat(np.arange(high - low), np.diff(cuts[low : high + 1]))] = True
                seen = np.zeros((len(near), high - low), bool)
                for t in range(TREES):
                    seen |= wanted[lies[:, t]]
                held = np.flatnonzero(seen.any(1))
                scores = np.where(seen[held].T, a[low:high] @ b[held].T, -np.inf)
                scores[scores < least[low:high, None]] = -np.inf
                for q, row in enumerate(scores):
                    some = np.flatnonzero(row > -np.inf)
                    if len(some) > 4 * places:
                        some = some[row[some] >= -np.partition(-row[some], places - 1)[places - 1]]
                    some = some[np.argsort(-row[some], kind="stable")[:places]]
                    out[0].append(np.full(len(some), query[low + q]))
                    out[1].append(near[held[some]])
                    out[2].append(row[some])
        return pa.table(dict(zip(("query", "node", "score"), map(np.concatenate, out), strict=True)))

    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    best, begin, end = None, 0, 1
    while begin < buckets:
        least = F.lit(float("-inf")).alias("least")
        sent = walks
        if best is not None:
            last = best.groupBy(F.col("query").alias("node")).agg(F.when(F.count("*") >= places, F.min("score")).alias("last"))
            sent, least = walks.join(last, "node", "left"), F.coalesce("last", F.lit(float("-inf"))).alias("least")
        offset = F.explode(F.sequence(F.lit(begin), F.lit(min(end, buckets) - 1))).alias("offset")
        sent = sent.select("node", "vector", "cells", "home", least, offset)
        sent = sent.select(F.pmod(F.col("home") + F.col("offset"), F.lit(buckets)).alias("bucket"), "node", "vector", "cells", "least")
        found = sent.repartition(buckets, "bucket").groupBy("bucket").cogroup(index).applyInArrow(rerank, "query long, node long, score double")
        both = found if best is None else found.unionByName(best)
        kept = stored(both.withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= places).drop("r"))
        if best is not None:
            discard(best)
        best, begin, end = kept, end, 2 * end
    last_round, best = best, best.select("query", "node")
    best = best.join(nodes.select(F.col("node").alias("query"), F.col("vector").alias("x")), "query").join(nodes.select("node", F.col("vector").alias("y")), "node")
    best = best.select("query", "node", product("x", "y").alias("score"))
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = best.join(members, "node").withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    lists = stored(lists.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("list")))
    each = asked.join(nodes.select("digest", F.col("node").alias("query")), "digest").join(lists, "query")
    each = each.select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    out = stored(each.select("query_id", F.posexplode("list").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"))
    discard(nodes, routed, walks, last_round, lists)
    return out
