"""Language identification by compression.

Each language is a raw-content zstandard dictionary: stretches of training texts
of that language, ``SLOTS`` at most, each of ``EXCERPT`` bytes at most.  Whole
texts are cut into stretches, and a hash of a stretch's own content picks them,
so all parts of all texts are eligible and equal stretches count once.  All
languages together have ``MAX_STRETCHES`` at most: many languages get fewer each
(one at least), and none is left out.  Texts are reduced to lower-case letters
(Unicode category L) and single spaces first.  A text is cut into pieces, each
piece is encoded once per language with that language's dictionary, and the
language with the fewest bytes in all is the prediction; a margin under
``min_margin`` rejects it (column ``accepted``).  Whole texts are encoded; the
pieces keep a long text from becoming its own dictionary.

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows with
a null language are not learned from.  Equal sizes go to the language that
sorts first.  Without any training row every text is ``und``.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, per_block, remainder, stored

SLOTS = 512
EXCERPT = 512
PIECE = 16384
LEVEL = 3
MAX_STRETCHES = 1 << 17
MIN_MARGIN = 0.02

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"\P{L}+")


def letters(text: str) -> bytes:
    """Lower-case letters, other characters as single spaces."""
    return f" {_OTHER.sub(' ', text.lower())}".encode()


def stretches(text: str) -> list[bytes]:
    """The whole text's letters, cut into equal parts of EXCERPT bytes at most."""
    data = letters(text)
    step = -(-len(data) // -(-len(data) // EXCERPT))
    return [data[k : k + step] for k in range(0, len(data), step)]


def dictionaries(docs: DataFrame, lang_col: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary content, from at most SLOTS stretches a language.

    The stretches are picked by an aggregate over hashes of their content, first
    within each block, so no language's rows meet in one task.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")

    def cut(block):
        least: dict = {}
        for text, lang in zip(block.column("text").to_pylist(), block.column("lang").to_pylist(), strict=True):
            if _LETTER.search(text):
                for stretch in stretches(text):
                    key = int.from_bytes(hashlib.blake2b(stretch, digest_size=8).digest(), "little", signed=True)
                    at = lang, key % SLOTS
                    least[at] = min(least.get(at, (key, stretch)), (key, stretch))
        columns = [[lang for lang, _ in least], [slot for _, slot in least], [key for key, _ in least.values()], [stretch for _, stretch in least.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["lang", "slot", "key", "stretch"])

    cuts = per_block(rows, cut, "lang string, slot int, key long, stretch binary")
    picked = cuts.groupBy("lang", "slot").agg(F.min_by("stretch", F.struct("key", "stretch")).alias("stretch"))
    picked = stored(picked)
    languages = picked.select("lang").distinct().count()
    allowed = max(1, min(SLOTS, MAX_STRETCHES // max(1, languages)))
    each = picked.groupBy("lang", (F.col("slot") % allowed).alias("slot")).agg(F.min_by("stretch", F.struct("slot", "stretch")).alias("stretch"))
    out: dict[str, bytes] = {}
    for row in each.orderBy("lang", "slot").toLocalIterator():
        out[row["lang"]] = out.get(row["lang"], b"") + bytes(row["stretch"])
    discard(picked)
    return out


def identify(docs: DataFrame, contents: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, accepted and runner_up of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(sorted(contents.items()))
    made: list = []

    def encoders():
        if not made:
            for name, content in shared.value:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                made.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress))
        return made

    def decide(text: str | None):
        if text is None or not shared.value or not _LETTER.search(text):
            return "und", 0.0, False, None
        data = letters(text)
        pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
        sizes = sorted((sum(len(encode(p)) for p in pieces), name) for name, encode in encoders())
        if len(sizes) == 1:
            return sizes[0][1], 1.0, True, None
        (best, lang), (other, next_lang) = sizes[:2]
        margin = (other - best) / other
        return lang, min(1.0, 0.5 + margin), margin >= min_margin, next_lang

    def run(block):
        out = [decide(t) for t in block.column("text").to_pylist()]
        columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.string()))]
        return pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "accepted", "runner_up"])

    return per_block(documents(docs), run, "doc_id long, lang_pred string, score double, accepted boolean, runner_up string")


def language_id(docs: DataFrame, lang_col: str = "lang", divisor: int = 4, held: int = 2, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Predict every document's language from dictionaries of the other splits."""
    contents = dictionaries(docs.where(remainder("doc_id", divisor) != held), lang_col)
    out = identify(docs, contents, min_margin)
    return out.select("doc_id", (remainder("doc_id", divisor) == held).alias("held_out"), "lang_pred", "score", "accepted", "runner_up")
