"""A corpus through five stages: toxicity, near copies, substrings, leaks, tokens.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of ``documents``.

Toxicity and leaks are judged row by row: of rows that share a doc_id, or have
none, each is kept or dropped for its own text (rows are told apart by 64 bits of
id and text).  Near copies are judged by doc_id; rows without one are kept, and of
rows with equal id and text one stays, the least.  For the substring stage rows
without a doc_id come last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from addrweave.llm import bpe
from addrweave.llm.common import remainder, shared_dir
from addrweave.llm.decontaminate import find_leaks
from addrweave.llm.fmindex import substring_dedup
from addrweave.llm.neardup import near_duplicates
from addrweave.llm.queries import tokenizer_path
from addrweave.llm.toxicity import fit, sample, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _row() -> Column:
    """What tells rows apart, whatever their ids."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose key is not among ``dropped`` (doc_id holds the key)."""
    gone = dropped.select(F.col("doc_id").alias("__row")).distinct()
    return docs.withColumn("__row", _row()).join(gone, "__row", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(sample(docs, labels.where(remainder("doc_id", 3) != 1), "toxic"))
    scores = score_toxicity(docs.select(_row().alias("doc_id"), "text"), model)
    return _without(docs, scores.where(F.col("score") >= 0.7))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies (5-word shingles, 0.8)."""
    judged = near_duplicates(docs, shingle=5, similarity=0.8)
    dropped = judged.where("not kept").select("doc_id").distinct()
    left = docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti")
    rest = F.min(F.struct("lang", "source", "n_chars", "text")).alias("x")
    named = left.where("doc_id is not null").groupBy("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest")).agg(rest)
    named = named.select("doc_id", *[f"x.{c}" for c in COLUMNS[1:]]).select(*COLUMNS)
    return named.unionByName(left.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 13-word windows that an earlier document holds.

    A text that loses no word stays as it is; a text left without words goes.
    """
    cut = substring_dedup(docs.select(*COLUMNS), keep=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = cut.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, find_leaks(docs.select(_row().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", tokenize),
]

#: The stages can't be expressed in SQL; tests hold each against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
