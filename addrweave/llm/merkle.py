"""A manifest of the corpus as a tree of hashes, with a proof for each row.

Leaves of one group (``lang``) stand in order of doc_id, and every two consecutive
nodes become their parent until one is left; the groups' subroots become the root
in the same way.  Ranks are taken by a sort in ranges and the sizes of what comes
before, so no group is ever one task's.  A rank's digits, of ``BITS`` bits each,
are columns that are grouped away one after the other inside blocks of
``2 ** (BITS * DIGITS)`` nodes: each step nests the structs of up to 16 children
in one, with the levels of hashes between.  All steps of a block need one shuffle,
by group and block.  Roots of blocks are the nodes of the next tier.  On the way
down each block meets the path of its own root by one more grouping on group and
block, and a nested transform and one explode give every node its proof, without
joins.

Rows that share a doc_id are ordered by their leaf; null doc_ids come first.  Rows
that are equal in all of their five columns have equal leaves and a place each,
and what they return differs by their places.  Null columns count as ``-``, empty
texts as ``0:``; texts are hashed whole, however long.  A group of one row has its
leaf as subroot, a single group its subroot as root; a proof without siblings is
the hash of nothing.  Other columns are not read; an empty table gives an empty
one.  Jobs run when the function is called; the tables that the result reads stay
in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, remainder, stored

BITS = 4
DIGITS = 3
SPAN = BITS * DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def framed(c: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return sha(F.concat(*[framed(changed.get(name, F.col(name))) for name in FIELDS]))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, group, hash, and the hash of the tampered row where it differs."""
    docs = docs.select(*[F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS])
    hit = F.col("doc_id").isNotNull() & (remainder("doc_id", 7) == 0) & F.col("n_chars").isNotNull()
    other = leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)
    group = F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0"))  # null first
    return docs.select("doc_id", group.alias("g"), leaf().alias("hash"), F.when(hit, other).alias("tampered"))


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """Each node of (g, hash, ...) with its place in its group, and the height of the group's tree."""
    rows = nodes.repartitionByRange("g", *order, F.rand(3)).sortWithinPartitions("g", *order)  # equal rows are spread too
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()))
    runs = rows.groupBy("g", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("from"), F.count("*").alias("n"))
    group = Window.partitionBy("g")  # a row for each partition at most
    before = F.sum("n").over(group.orderBy("part")) - F.col("n")
    runs = stored(runs.select("g", "part", (before - F.col("from")).alias("shift"), F.sum("n").over(group).alias("count")))
    height = F.when(F.col("count") > 1, F.length(F.bin(F.col("count") - 1))).otherwise(0)
    both = rows.withColumn("part", F.shiftright("at", 33)).join(runs, ["g", "part"])
    out = stored(both.select(*nodes.columns, (F.col("at") + F.col("shift")).alias("rank"), height.alias("height")))
    discard(rows, runs)
    return out


def parents(hashes: Column, level: int) -> Column:
    """The next level of hashes, where the tree goes on; else the same."""
    pairs = F.sequence(F.lit(0), F.shiftright(F.size(hashes) - 1, 1))
    made = F.transform(pairs, lambda k: sha(F.concat(F.get(hashes, 2 * k), F.coalesce(F.get(hashes, 2 * k + 1), F.lit("")))))
    return F.when(F.col("height") > level, made).otherwise(hashes)


def blocks(nodes: DataFrame, below: int) -> DataFrame:
    """g, height, block and the nested node of every block of (g, height, rank, node); ``below`` levels are done."""
    digits = [f"d{k}" for k in range(DIGITS)]
    mask = (1 << BITS) - 1
    rows = nodes.select("g", "height", F.shiftright("rank", SPAN).alias("block"), *[F.shiftright("rank", BITS * k).bitwiseAND(mask).cast("int").alias(d) for k, d in enumerate(digits)], "node")
    rows = rows.repartition("g", "block")
    for k, digit in enumerate(digits):
        keys = ["g", "height", "block", *digits[k + 1 :]]
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(digit, "node"))).alias("x")).select(*keys, F.col("x.node").alias("kids"))
        rows = rows.withColumn("l0", F.col("kids.hash"))
        for j in range(BITS):
            rows = rows.withColumn(f"l{j + 1}", parents(F.col(f"l{j}"), below + BITS * k + j))
        node = F.struct(F.get(f"l{BITS}", F.lit(0)).alias("hash"), F.array(*[f"l{j}" for j in range(BITS)]).alias("levels"), "kids")
        rows = rows.select(*keys, node.alias("node"))
    return rows


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of the nodes (g, height, rank, node), blocks of their roots, and so on up to one block a group."""
    most = nodes.agg(F.max("height")).first()[0] or 0
    out = [stored(blocks(nodes, 0))]
    while len(out) * SPAN < most:
        roots = out[-1].select("g", "height", F.col("block").alias("rank"), F.struct(F.col("node.hash").alias("hash"), F.col("block").alias("place")).alias("node"))
        out.append(stored(blocks(roots, len(out) * SPAN)))
    return out


def steps(node: Column, place: Column, below: int) -> Column:
    """A child's siblings up to its parent struct: L or R and the hash, A where it stands alone."""

    def one(j: int) -> Column:
        at = F.shiftright(place, j)
        side = F.when(at % 2 == 1, "L").otherwise("R")
        return F.when(F.col("height") > below + j, F.coalesce(F.concat(side, F.get(node["levels"][j], at.bitwiseXOR(F.lit(1)))), F.lit("A")))

    return F.array_compact(F.array(*[one(j) for j in range(BITS)]))


def proofs(node: Column, above: Column, below: int, digit: int) -> Column:
    """All lowest children of a nested node, each with its path."""

    def child(kid: Column, place: Column) -> Column:
        path = F.concat(steps(node, place, below + BITS * digit), above)
        return proofs(kid, path, below, digit - 1) if digit else F.array(F.struct(kid.alias("node"), path.alias("path")))

    return F.flatten(F.transform(node["kids"], child))


def descend(trees: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """g, node, path, subroot and root of every lowest node.

    ``above`` has g, path and root of each group's top; without it paths end at the groups' tops.
    """
    rest = ["path", "subroot", "root"]
    none = F.array().cast("array<string>")
    if above is None:
        rows = trees[-1].select("*", none.alias("path"), F.lit("").alias("subroot"), F.col("node.hash").alias("root"))
    for k in reversed(range(len(trees))):
        if above is not None:
            upper = above.select("g", F.col("place").alias("block"), F.lit(None).cast(trees[k].select(F.struct("height", "node")).schema[0].dataType).alias("tree"), F.struct(*rest).alias("above"))
            lower = trees[k].select("g", "block", F.struct("height", "node").alias("tree"), F.lit(None).cast(upper.schema["above"].dataType).alias("above"))
            met = lower.unionByName(upper).groupBy("g", "block").agg(F.first("tree", True).alias("tree"), F.first("above", True).alias("above"))
            rows = met.select("g", "tree.*", "above.*")
        found = rows.select("g", F.explode(proofs(F.col("node"), F.col("path"), k * SPAN, DIGITS - 1)).alias("x"), "subroot", "root")
        above = found.select("g", F.col("x.node").alias("node"), F.col("x.path").alias("path"), "subroot", "root")
        if k:
            above = above.withColumn("place", F.col("node.place"))
    return above


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def up(done: Column, step: Column) -> Column:
        other, side = F.substring(step, 2, 64), F.substring(step, 1, 1)
        return sha(F.when(side == "L", F.concat(other, done)).otherwise(F.concat(done, other)))

    return F.aggregate(path, start, up)


def manifest(docs: DataFrame) -> DataFrame:
    """Per row doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf) and verified."""
    hashed = stored(leaves(docs))  # texts are read once, not for the ranges again
    nodes = ranked(hashed, "doc_id", "hash")
    trees = tiers(nodes.select("g", "height", "rank", F.struct("hash", "doc_id", "tampered").alias("node")))
    discard(hashed, nodes)
    tops = trees[-1].select(F.lit("").alias("g"), F.col("g").alias("group"), F.col("node.hash").alias("hash"))
    groups = ranked(tops, "group")
    crown = tiers(groups.select("g", "height", "rank", F.struct("hash", "group").alias("node")))
    above = descend(crown, None).select(F.col("node.group").alias("g"), "path", F.col("node.hash").alias("subroot"), "root", F.lit(0).cast("long").alias("place"))
    rows = descend(trees, above)
    siblings = F.array_join(F.transform("path", lambda s: F.substring(s, 2, 64)), "")
    rows = rows.select("node.*", "subroot", "root", "path", sha(siblings).alias("proof_sha256"))
    rows = rows.withColumn("folded_root", folded(F.col("path"), F.coalesce("tampered", "hash")))
    discard(groups)
    return rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
