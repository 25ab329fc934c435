"""License scans by diagonal voting.

All rolling word pairs of the texts, adjacent or with one word between them, are
joined to the adjacent pairs of license templates.  A shared pair votes for its
diagonal, the offset of the text's word from the template's word: a whole license
text keeps one diagonal, an edit moves to a neighbouring one.  Votes are summed by
diagonal, then over the diagonals up to ``reach`` behind each (1.2 times a
template's words: all of them put in, a fifth taken out).  Diagonals that start
such a stretch with enough votes are merged where they are neighbours, and the
merged spans are verified by the longest common subsequence of their words with
the template's words.  A span's similarity is the share of the template's words
that stand in order in a text window of about 2.5 times its words.

Where spans of two labels lie on one another, one that matches fewer words and is
less similar goes: a line on CC BY-NC is none on CC BY-SA.

What voting can't lose: spans of at least ``MIN_SIMILARITY`` where one word is put
in anywhere, any number of times, and two or more at once in fewer places than
three tenths of the template's words (see ``votes_needed``).

The templates' pair table has at most as many rows as the templates have words.
A fixed bitmap of 2**BITMAP_BITS places keeps most pairs without a partner from
the join; what it lets pass by chance finds no partner there.  Texts are read
again for the verification of the documents that have spans.

Nulls and empty texts: no words, no labels, score 0.  Repeated rows get equal
results.  Very long texts are scanned whole, in windows.  Of several spans of a
text the best similarity is its score.  Further columns of the input are not
read.  An empty table gives an empty table.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text
from .common import documents, per_block
from .license_texts import LINES, OPENINGS, TEXTS

BITMAP_BITS = 20
MIN_SIMILARITY = 0.8
UNIT = 1024
BROADCAST_ROWS = 100_000

#: Phrases and labels of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

TEMPLATES = [*LINES, *OPENINGS, *TEXTS]


def _words(texts: pa.Array):
    data, at = text.raw(texts)
    data = text.LOWER[data]
    starts, ends, first = text.spans(data, at, text.ALNUM)
    return text.hashes(data, starts, ends), first


def _template_words(templates) -> list[np.ndarray]:
    hashes, first = _words(pa.array([t for _, t in templates], pa.string()))
    return [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def base_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Word counts, and places where a phrase's words stand consecutively."""
    wanted = list(zip(_template_words([(0, p) for p in phrases]), phrases.values(), strict=True))

    def run(block):
        words, first = _words(block.column("text"))
        rows = text.owners(first)
        n = block.num_rows
        total = np.zeros(n, np.int64)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        labels: list[set] = [set() for _ in range(n)]
        for sequence, label in wanted:
            m = len(sequence)
            at = np.flatnonzero(words[: max(0, len(words) - m + 1)] == sequence[0])
            for k in range(1, m):
                at = at[words[at + k] == sequence[k]]
            at = at[rows[at] == rows[at + m - 1]] if len(at) else at
            owner = rows[at]
            place = at - first[owner]
            np.add.at(total, owner, 1)
            np.minimum.at(low, owner, place)
            np.maximum.at(high, owner, place)
            for r in np.unique(owner).tolist():
                labels[r].add(label)
        none = total == 0
        columns = [block.column("doc_id"), block.column("key"), pa.array(np.diff(first)), pa.array(total), pa.array(low, mask=none), pa.array(high, mask=none), pa.array([sorted(x) for x in labels], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base"])

    return per_block(docs, run, "doc_id long, key long, n_words long, n_base long, first_word long, last_word long, base array<string>")


def hits(docs: DataFrame, sequences: list[np.ndarray]) -> DataFrame:
    """doc_id, key, template, gram and at (word) of the texts' pairs that can be of a span.

    Pairs of adjacent words, and of words with one between them.  A bitmap drops
    most pairs of no template.  A pair is handed on for a template that has it if
    a stretch of text as long as the template's spans holds as many of its pairs
    as it needs votes, each counted as often as the template has it at most: a
    bound on the votes, so no span is lost.
    """
    mask = np.uint64((1 << BITMAP_BITS) - 1)
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    wanted = []
    for s in sequences:
        grams, times = np.unique(text.pairs(s, 1), return_counts=True)
        bitmap[grams & mask] = True
        wanted.append((grams, times, votes_needed(len(s)), reach(len(s)) + len(s)))

    def dense(at: np.ndarray, number: np.ndarray, times: np.ndarray, needed: int, wide: int) -> np.ndarray:
        """Which places lie in a stretch of ``wide`` words with as many votes as needed."""
        end = np.searchsorted(at, at + wide)
        full = np.flatnonzero(end - np.arange(len(at)) >= needed)
        good = np.array([np.minimum(np.bincount(number[a:b]), times[: number[a:b].max() + 1]).sum() >= needed for a, b in zip(full.tolist(), end[full].tolist(), strict=True)], bool)
        edge = np.zeros(len(at) + 1, np.int64)
        np.add.at(edge, full[good], 1)
        np.subtract.at(edge, end[full[good]], 1)
        return np.cumsum(edge[:-1]) > 0

    def run(block):
        words, first = _words(block.column("text"))
        rows = text.owners(first)
        met = []
        for apart in (1, 2):
            found = text.pairs(words, apart)
            at = np.flatnonzero(bitmap[found & mask])
            at = at[rows[at] == rows[at + apart]]
            met.append((at, found[at]))
        at, found = map(np.concatenate, zip(*met, strict=True))
        order = np.argsort(at, kind="stable")
        at, found = at[order], found[order]
        out = []
        for t, (grams, times, needed, wide) in enumerate(wanted):
            number = np.minimum(np.searchsorted(grams, found), max(len(grams) - 1, 0))
            own = np.flatnonzero(grams[number] == found) if len(grams) else at[:0]
            own = own[dense(at[own], number[own], times, needed, wide)]
            out.append((own, np.full(len(own), t)))
        own, template = map(np.concatenate, zip(*out, strict=True)) if out else (at[:0], at[:0])
        at, found = at[own], found[own]
        take = pa.array(rows[at])
        return pa.RecordBatch.from_arrays([block.column("doc_id").take(take), block.column("key").take(take), pa.array(template.astype(np.int32)), pa.array(found.view(np.int64)), pa.array(at - first[rows[at]])], ["doc_id", "key", "template", "gram", "at"])

    return per_block(docs, run, "doc_id long, key long, template int, gram long, at long")


def _common(words: np.ndarray, template: np.ndarray) -> tuple[int, int]:
    """Length of the longest common subsequence, and the words up to its end."""
    row = np.zeros(len(template) + 1, np.int64)
    end = 0
    for k, w in enumerate(words):
        before = row[-1]
        step = np.where(template == w, row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], step))
        if row[-1] > before:
            end = k + 1
    return int(row[-1]), end


def _not_outdone(found: list[tuple]) -> list[tuple]:
    """The spans (begin, end, matched, similarity, label) that no other label's span outdoes.

    One outdoes another if it covers half of its place, matches as many words and
    is as similar, and is better in one of the two.  Ties stay.
    """
    better = lambda x, y: x[2] >= y[2] and x[3] >= y[3] and x[2:4] != y[2:4]
    over = lambda x, y: 2 * (min(x[1], y[1]) - max(x[0], y[0])) >= y[1] - y[0]
    found = sorted(set(found))
    kept, at = [], 0
    longest = max((x[1] - x[0] for x in found), default=0)
    for y in found:
        while found[at][0] + longest < y[0]:
            at += 1
        near = itertools.takewhile(lambda x: x[0] <= y[1], itertools.islice(found, at, None))  # noqa: B023
        if not any(x[4] != y[4] and over(x, y) and better(x, y) for x in near):  # noqa: B023
            kept.append(y)
    return kept


def votes_needed(words: int) -> int:
    """Votes that a span has at least.

    Of a template's n - 1 adjacent pairs a lost word spoils two and a place with
    two or more words put in spoils one: with a fifth of the words lost and fewer
    than 0.3 n such places, 0.3 n are left.
    """
    return max(1, int(0.3 * words))


def reach(words: int) -> int:
    """How far a span's diagonals lie apart: all words put in once, a fifth left out."""
    return words + words // 5 + 1


def spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Verified license spans: doc_id, key, label, start (word), similarity."""
    spark = docs.sparkSession
    sequences = _template_words(templates)
    reaches = [reach(len(s)) for s in sequences]
    table = [(int(g), t, p, votes_needed(len(s)), reaches[t]) for t, s in enumerate(sequences) for p, g in enumerate(text.pairs(s, 1).view(np.int64))]
    positions = spark.createDataFrame(table, "gram long, template int, place int, needed int, reach int")
    if len(table) <= BROADCAST_ROWS:
        positions = F.broadcast(positions)
    votes = (
        hits(docs, sequences)
        .join(positions, ["gram", "template"])
        .groupBy("doc_id", "key", "template", "needed", "reach", (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.count("*").alias("votes"))  # repeated rows vote again: more spans are verified, none is lost
    )
    each = Window.partitionBy("doc_id", "key", "template")
    scaled = F.floor(F.col("diagonal") * UNIT / F.col("reach"))  # one reach is UNIT at any template
    ahead = F.sum("votes").over(each.orderBy("scaled").rangeBetween(0, UNIT))
    warm = votes.withColumn("scaled", scaled).withColumn("ahead", ahead).where("ahead >= needed")
    each = each.orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(each) > F.col("reach")
    merged = (
        warm.withColumn("cluster", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(each))
        .groupBy("doc_id", "key", "template", "cluster")
        .agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
        .groupBy("doc_id", "key")
        .agg(F.collect_list(F.struct("template", "low", "high")).alias("spans"))
    )

    def verify(block):
        words, first = _words(block.column("text"))
        out = []
        for r, (doc_id, key, found) in enumerate(zip(*(block.column(c).to_pylist() for c in ("doc_id", "key", "spans")), strict=True)):
            own = words[first[r] : first[r + 1]]
            met = []
            for span in found:
                template, far = sequences[span["template"]], reaches[span["template"]]
                step = max(1, len(template) // 4)
                for low in range(span["low"], span["high"] + 1, step):  # each diagonal's window is inside of one of these
                    a, b = max(0, low), max(0, low + step + far + len(template))
                    matched, end = _common(own[a:b], template)
                    if matched >= MIN_SIMILARITY * len(template):
                        _, back = _common(own[a : a + end][::-1], template[::-1])
                        met.append((a + end - back, a + end, matched, matched / len(template), templates[span["template"]][0]))
            out += [(doc_id, key, label, begin, alike) for begin, _, _, alike, label in _not_outdone(met)]
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "key", "label", "start", "similarity"])

    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key"))
    both = docs.alias("a").join(merged.alias("b"), same).select("a.doc_id", "a.key", "a.text", "b.spans")
    return per_block(both, verify, "doc_id long, key long, label string, start long, similarity double").distinct()


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per document: base places and labels, and those of the templates.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the best similarity of a verified span, 0 without one).
    """
    docs = documents(docs).withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    own = spans(docs, templates).groupBy("doc_id", "key").agg(F.collect_set("label").alias("own"), F.max("similarity").alias("score"))
    base = base_scan(docs, phrases)
    both = base.alias("a").join(own.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left")
    labels = F.array_sort(F.array_distinct(F.concat("a.base", F.coalesce("b.own", F.array().cast("array<string>")))))
    return both.select(
        "a.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("a.base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce("b.score", F.lit(0.0)).alias("score"),
    )
