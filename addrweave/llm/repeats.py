"""Where windows of words or bytes repeat across documents, as Spark jobs.

The two substring operators share this frame; they differ in the index that a
shard builds.

1. Each window has a *minimizer*, the least hash among its short grams; equal
   windows have equal minimizers.  A *run* is a stretch of windows of one text
   with the same minimizer.  Runs are rows of ids and positions only.
2. Minimizers met in one text alone are dropped: ranges of minimizers are held
   against each other, then a bitmap and a join pick the runs.
3. The runs that are left are joined to the texts once, which gives *segments*
   (the symbols that a run's windows cover).  Equal segments are folded to one,
   with their smallest and largest doc_id.
4. Segments are dealt to shards by minimizer; a shard's index finds, for each
   window of its segments, the smallest doc_id among all equal windows.  Where
   the folded segments of one minimizer are more than a shard should hold, each
   of their windows is dealt as a segment of its own, by its content.
5. The answers are joined back to the runs: a window whose smallest doc_id is
   below the run's own is a repeat.

No step holds the rows of one key in one task: what shares a key is folded where
it lies before it is shuffled, joins can be split, and shards hold different
segments.

Null texts count as empty.  A null doc_id counts as the largest.  Rows of equal
doc_id and text are one document; exact copies of a text with a smaller doc_id
are recognised by a digest of the whole text and need no segments.

The functions run Spark jobs when they are called.  Their intermediate tables go
when the last job has read them; the marks, which the result reads, stay in the
shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .common import bitmap, discard, stored

SALTS = 16
HELD = 1 << 19
RANGE = 1 << 20
FOLDED = 1 << 16
SHARD_SYMBOLS = 1 << 18
LAST = (1 << 63) - 1


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (never null), fp (a hash of the text) and body, beside the given columns."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({"__doc": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "__body": body}).withColumn("__fp", F.xxhash64("__body"))


def _symbols(unit: str, body: pa.Array):
    """Hashes of the grams' symbols, each text's first symbol, and byte spans of the symbols."""
    data, at = text.raw(body)
    if unit == "word":
        starts, ends, first = text.spans(data, at, text.SPACED)
        return data, text.hashes(data, starts, ends), first, starts, ends
    return data, None, at, None, None


def _byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive bytes (n a multiple of 8)."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    eight = np.ndarray(len(data) - 7, np.uint64, np.ascontiguousarray(data), 0, (1,)).copy()  # the eight bytes at each place
    total = np.zeros(len(data) - n + 1, np.uint64)
    for k in range(0, n, 8):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += eight[k : k + len(total)]
        total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    total *= np.uint64(0x9E3779B97F4A7C15)
    return total


def _runs(unit: str, body: pa.Array, window: int, gram: int):
    """Minimizer, row, first window in the text and number of windows of every run."""
    _, words, first, _, _ = _symbols(unit, body)
    grams = text.grams(words, gram) if unit == "word" else _byte_grams(text.raw(body)[0], gram)
    least = text.sliding_min(grams, window - gram + 1)
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[first[first < len(least)]] = True
    begin = np.flatnonzero(new)
    row = np.searchsorted(first, begin, "right") - 1
    stop = first[row + 1] - window + 1  # behind the text's last window
    inside = begin < stop
    end = np.minimum(np.append(begin[1:], len(least)), stop)[inside]
    begin, row = begin[inside], row[inside]
    return least[begin], row, begin - first[row], end - begin


def runs(docs: DataFrame, unit: str, window: int, gram: int, bitmap: np.ndarray | None = None) -> DataFrame:
    """m (minimizer), fp (of the text) and at (first window << 31 | windows) of every run.

    With a bitmap only of those runs whose minimizer it lets pass.
    """
    shared = None if bitmap is None else docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for block in text.blocks(batches, "__body"):
            m, row, start, n = _runs(unit, block.column("__body"), window, gram)
            if shared is not None:
                hit = text.passes(shared.value, m)
                m, row, start, n = m[hit], row[hit], start[hit], n[hit]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), block.column("__fp").take(take), pa.array(start << 31 | n)], ["m", "fp", "at"])

    return docs.select("__fp", "__body").mapInArrow(run, "m long, fp long, at long")


def shared_minimizers(docs: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """m of all minimizers that two different texts have.

    Tasks hold about ``HELD`` runs at a time, keep two texts of each minimizer
    among them (the least and the greatest fp) and hand them on in ranges of
    minimizers; a range has about ``RANGE`` bytes at any size of the corpus.
    """
    size = docs.agg(F.sum(F.octet_length("__body"))).first()[0] or 0
    bits = max(1, (size // RANGE).bit_length())

    def ranges(m, fp):
        order = np.argsort(m)
        m, fp = m[order], fp[order]
        begin = np.flatnonzero(np.append(True, m[1:] != m[:-1])[: len(m)])
        low, high = np.minimum.reduceat(fp, begin), np.maximum.reduceat(fp, begin)
        two = low != high
        m, fp = np.concatenate([m[begin], m[begin][two]]), np.concatenate([low, high[two]])
        part = (m >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        m, fp, part = m[order], fp[order], part[order]
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]), len(part))
        for k in range(0, len(cuts) - 1, 256):
            some = list(zip(cuts[k : k + 256].tolist(), cuts[k + 1 : k + 257].tolist(), strict=False))
            yield pa.RecordBatch.from_arrays([pa.array(part[[a for a, _ in some]]), *(pa.array([x[a:b].tobytes() for a, b in some], pa.binary()) for x in (m, fp))], ["part", "m", "fp"])

    def run(batches):
        held: list = []
        for block in text.blocks(batches, "__body"):
            m, row, _, _ = _runs(unit, block.column("__body"), window, gram)
            held.append((m, text.column(block, "__fp")[row]))
            if sum(len(m) for m, _ in held) >= HELD:
                yield from ranges(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if sum(len(m) for m, _ in held):
            yield from ranges(*map(np.concatenate, zip(*held, strict=True)))

    def met(table: pa.Table) -> pa.Table:
        m, fp = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)]) for c, kind in (("m", np.int64), ("fp", np.int64)))
        order = np.argsort(m)
        m, fp = m[order], fp[order]
        begin = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
        shared = np.minimum.reduceat(fp, begin) != np.maximum.reduceat(fp, begin)
        return pa.table({"m": m[begin][shared]})

    return docs.select("__fp", "__body").mapInArrow(run, "part long, m binary, fp binary").groupBy("part").applyInArrow(met, "m long")


def _content(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The bytes data[low:high] of each stretch."""
    size = high - low
    cuts = np.cumsum([0, *size])
    at = np.repeat(low - cuts[:-1], size) + np.arange(cuts[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data[at].tobytes())]).cast(pa.binary())


def _stretches(unit: str, body: pa.Array):
    """Each row's first symbol, and a function from symbol ranges to digests (two of 64 bits) and bytes."""
    data, words, first, starts, ends = _symbols(unit, body)

    def cut(a: np.ndarray, b: np.ndarray):
        size = (b - a).astype(np.uint64)
        if unit == "byte":
            return text.hashes(data, a, b), text.hashes(text.SHUFFLED[data], a, b) + size, _content(data, a, b)
        sums = []
        for salt in (0, 0x632BE59BD9B4E019):
            power = text._power(text._BASE, len(words) + 1)
            total = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(text.mix(words ^ np.uint64(salt)) * power[: len(words)], out=total[1:])
            sums.append(text.mix((total[b] - total[a]) * text._power(text._INVERSE, len(words) + 1)[a] + size))
        return *sums, _content(data, starts[a], ends[b - 1])

    return first, cut


def segments(docs: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """Runs of shared minimizers with their symbols' bytes and a 128-bit digest of these.

    Only the smallest document of each text is cut; its exact copies are judged
    by ``copies``.
    """
    shared = stored(shared_minimizers(docs, unit, window, gram))
    some = runs(docs, unit, window, gram, bitmap(shared, "m"))  # and some by chance, which the join drops
    met = some.join(shared, "m").groupBy("fp").agg(F.collect_set(F.struct("m", "at")).alias("runs"))
    met = stored(met.join(_lowest_of_text(docs).select("doc", "fp"), "fp"))
    texts = docs.select("__doc", "__fp", "__body").join(met, (F.col("__fp") == F.col("fp")) & (F.col("__doc") == F.col("doc")))

    def run(batches):
        for block in text.blocks(batches, "__body"):
            first, cut = _stretches(unit, block.column("__body"))
            lists = pa.concat_arrays([block.column("runs")])
            flat = lists.flatten()
            m, place = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            row = np.repeat(np.arange(block.num_rows), np.diff(lists.offsets.to_numpy()))
            start, n = place >> 31, place & 0x7FFFFFFF
            a = first[row] + start
            s1, s2, content = cut(a, a + n + window - 1)
            take = pa.array(row)
            columns = [pa.array(m), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), block.column("__doc").take(take), block.column("__fp").take(take), pa.array(start.astype(np.int32)), content, pa.array(np.diff(text.raw(content)[1]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["m", "s1", "s2", "doc", "fp", "start", "content", "bytes"])

    made = stored(texts.select("__doc", "__fp", "__body", "runs").mapInArrow(run, "m long, s1 long, s2 long, doc long, fp long, start int, content binary, bytes int"))
    discard(shared, met)
    return made


def windows(folded: DataFrame, unit: str, window: int) -> DataFrame:
    """Every window of the segments as a segment of its own, under a key of its own (m).

    p1, p2 and k tell the segment and the window's number in it.
    """

    def run(batches):
        for block in text.blocks(batches, "content"):
            first, cut = _stretches(unit, block.column("content"))
            n = np.diff(first) - window + 1
            row = np.repeat(np.arange(block.num_rows), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            a = first[row] + k
            s1, s2, content = cut(a, a + window)
            s1, s2, take = pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(row)
            columns = [s1, s1, s2, *(block.column(c).take(take) for c in ("doc", "last", "s1", "s2")), pa.array(k.astype(np.int32)), content]
            yield pa.RecordBatch.from_arrays(columns, ["m", "s1", "s2", "doc", "last", "p1", "p2", "k", "content"])

    return folded.select("s1", "s2", "doc", "last", "content").mapInArrow(run, "m long, s1 long, s2 long, doc long, last long, p1 long, p2 long, k int, content binary")


def fold(table: pa.Table) -> pa.Table:
    """Equal segments once, with the smallest and the largest doc_id of all of them."""
    s1, s2, doc, last = (table.column(c).to_numpy() for c in ("s1", "s2", "doc", "last"))
    order = np.lexsort((s2, s1))
    new = np.append(True, (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1]))[: len(order)]
    begin = np.flatnonzero(new)
    low, high = (f.reduceat(x[order], begin) if len(begin) else x for f, x in ((np.minimum, doc), (np.maximum, last)))
    one = table.take(pa.array(order[begin]))
    return one.set_column(one.schema.get_field_index("doc"), "doc", pa.array(low)).set_column(one.schema.get_field_index("last"), "last", pa.array(high))


def folded(df: DataFrame) -> DataFrame:
    """Equal segments that lie together are folded where they are (``FOLDED`` rows at a time)."""

    def run(batches):
        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= FOLDED:
                yield from fold(pa.Table.from_batches(held)).to_batches()
                held = []
        if held:
            yield from fold(pa.Table.from_batches(held)).to_batches()

    return df.select("m", "s1", "s2", "doc", "last", "content").mapInArrow(run, "m long, s1 long, s2 long, doc long, last long, content binary")


def heavy(made: DataFrame, limit: int) -> DataFrame:
    """m of the minimizers whose different segments have more than ``limit`` bytes together.

    All segments together bound that, so equal ones are told apart only where their sum is over the limit.
    """
    over = F.col("total") > limit
    some = stored(made.groupBy("m").agg(F.sum("bytes").alias("total")).where(over).select("m"))
    each = made.select("m", "s1", "bytes").join(some, "m", "left_semi").groupBy("m", "s1").agg(F.max("bytes").alias("bytes"))
    out = stored(each.groupBy("m").agg(F.sum("bytes").alias("total")).where(over).select("m"))
    discard(some)
    return out


def repeated(docs: DataFrame, unit: str, window: int, gram: int, lowest) -> DataFrame:
    """__doc, __fp and starts of windows that also start in a smaller doc (stretches: at, n).

    ``lowest(contents, docs)`` gives, for each segment of a shard, the smallest
    doc_id of each of its windows.  ``docs`` comes from ``keyed``.
    """
    made = segments(docs, unit, window, gram)
    each = made.withColumn("last", F.col("doc"))
    shard = SHARD_SYMBOLS * (6 if unit == "word" else 1)
    n, distinct, total = made.agg(F.count("*"), F.approx_count_distinct("s1"), F.sum("bytes")).first()
    total = int((total or 0) * min(1, distinct / max(n, 1)))  # about what equal segments leave; it sets only how many shards there are
    hot = heavy(made, 8 * shard)

    def index(table: pa.Table) -> pa.Table:
        table = fold(table)
        contents = table.column("content").combine_chunks()
        lists = lowest(contents.chunk(0) if isinstance(contents, pa.ChunkedArray) else contents, table.column("doc").to_numpy())
        low, cuts = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        new = np.append(True, low[1:] != low[:-1])[: len(low)]  # stretches of windows with one answer
        new[cuts[:-1]] = True
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(low)))
        row = np.searchsorted(cuts, begin, "right") - 1
        kept = low[begin] < table.column("last").to_numpy()[row]  # they repeat in some document
        begin, size, row = begin[kept], size[kept], row[kept]
        cuts, k = np.searchsorted(row, np.arange(table.num_rows + 1)), begin - cuts[row]
        found = pa.StructArray.from_arrays([pa.array(k.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(low[begin])], ["k", "n", "low"])
        out = pa.table({"s1": table.column("s1"), "s2": table.column("s2"), "found": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found)})
        return out.filter(pa.array(np.diff(cuts) > 0))

    def indexed(segments_of: DataFrame, size: int) -> DataFrame:
        shards = size // shard + 1
        dealt = folded(segments_of).withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards))).repartition(int(shards), "shard")
        return dealt.groupBy("shard").applyInArrow(index, "s1 long, s2 long, found array<struct<k int, n int, low long>>")

    some = not hot.isEmpty()
    answers = [stored(indexed(each.join(hot, "m", "left_anti") if some else each, total))]
    if some:
        every = stored(windows(folded(each.join(hot, "m", "left_semi")), unit, window))
        found = indexed(every, every.agg(F.sum(F.octet_length("content"))).first()[0]).select("s1", "s2", F.col("found")[0]["low"].alias("low"))
        back = every.select("s1", "s2", "p1", "p2", "k").distinct().join(found, ["s1", "s2"])
        answers.append(stored(back.groupBy(F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(F.collect_list(F.struct("k", F.lit(1).alias("n"), "low")).alias("found"))))
        discard(every)
    discard(hot)
    found = answers[0] if len(answers) == 1 else answers[0].union(answers[1])
    at = made.select("s1", "s2", "doc", "fp", "start").join(found, ["s1", "s2"])
    starts = F.transform(F.filter("found", lambda x: x["low"] < F.col("doc")), lambda x: F.struct((F.col("start") + x["k"]).alias("at"), x["n"].alias("n")))
    hits = at.select(F.col("doc").alias("__doc"), F.col("fp").alias("__fp"), starts.alias("starts")).where(F.size("starts") > 0)
    out = stored(hits.groupBy("__doc", "__fp").agg(F.flatten(F.collect_list("starts")).alias("starts")))
    discard(made, *answers)
    return out


def _digests(docs: DataFrame) -> DataFrame:
    return docs.select("__doc", "__fp", F.md5("__body").alias("digest"))


def _lowest_of_text(docs: DataFrame) -> DataFrame:
    """doc and fp of the smallest document of each text, and n, the text's rows."""
    return _digests(docs).groupBy("digest").agg(F.min("__doc").alias("doc"), F.min("__fp").alias("fp"), F.count("*").alias("n"))


def copies(docs: DataFrame) -> DataFrame:
    """__doc and __fp of the documents whose whole text a smaller doc has.

    Only texts of more than one row are joined, each under ``SALTS`` keys, so
    the rows of one text are dealt to as many tasks.
    """
    low = _lowest_of_text(docs).where("n > 1").select("digest", F.col("doc").alias("low"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    each = _digests(docs).withColumn("salt", F.pmod(F.xxhash64("__doc"), F.lit(SALTS)).cast("int"))
    return each.join(low, ["digest", "salt"]).where("__doc > low").select("__doc", "__fp").distinct()


def marked(docs: DataFrame, unit: str, window: int, gram: int, lowest) -> DataFrame:
    """The documents with their repeated windows (``__starts``) and whether they are copies (``__copy``)."""
    marks = repeated(docs, unit, window, gram, lowest).withColumn("copy", F.lit(False))
    whole = copies(docs).select("__doc", "__fp", F.array().cast("array<struct<at:int,n:int>>").alias("starts"), F.lit(True).alias("copy"))
    marks = marks.unionByName(whole).withColumnsRenamed({"starts": "__starts", "copy": "__copy"})
    return docs.join(marks, ["__doc", "__fp"], "left")


def covered(first: np.ndarray, lists: pa.Array, copy: pa.Array, window: int) -> np.ndarray:
    """Which symbols of a block the repeated windows cover."""
    edge = np.zeros(first[-1] + 1, np.int32)
    whole = np.flatnonzero(copy.fill_null(False).to_numpy(zero_copy_only=False) & (np.diff(first) >= window))
    edge[first[whole]] += 1
    np.subtract.at(edge, first[whole + 1], 1)
    lists = pa.concat_arrays([lists])
    counts = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
    at, n = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
    at += np.repeat(first[:-1], counts)
    edge += np.bincount(at, minlength=len(edge)).astype(np.int32)
    edge -= np.bincount(at + n + window - 1, minlength=len(edge)).astype(np.int32)
    return np.cumsum(edge[:-1]) > 0
