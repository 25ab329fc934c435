"""Votes of an outside scorer."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.scores import breakdown, component_scores
from .match import merge_candidates, top_candidates
from .report import clean, number

PAYLOAD_CANDIDATES = 5


def rerank_payloads(addresses: DataFrame, top: DataFrame, locations: DataFrame) -> DataFrame:
    """record_id and a JSON payload with the address and its first candidates."""
    places = locations.select("location_id", "street", "city", "state", "postal_code").dropDuplicates(["location_id"])
    rows = top.where(F.col("rank") <= PAYLOAD_CANDIDATES).join(places, "location_id")
    names = ("location_id", "confidence", "strategy", "street", "city", "state", "postal_code")
    texts = [clean(F.col(n)).alias(n) if n != "confidence" else number(F.col(n), "0.000").alias(n) for n in names]
    lists = rows.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("rank", *texts))).alias("candidates"))
    plain = F.transform("candidates", lambda c: F.struct(*[c[k].alias(k) for k in names]))
    return addresses.join(lists, "record_id").select("record_id", F.to_json(F.struct(clean(F.col("address")).alias("address"), plain.alias("candidates"))).alias("payload"))


def score_payloads(payloads: DataFrame, scorer: Callable[[list[str]], list[str]], tries: int = 3) -> DataFrame:
    """Hand payloads to a Python scorer in Arrow batches: record_id, response and error.

    A batch whose scorer raises, or does not return one response a payload, is
    tried again, and then each of its payloads by itself, ``tries`` times each; a
    payload that still fails has a null response and the error's text, and the
    job goes on without its vote.
    """

    return _scored(payloads, scorer, tries).drop("digest")


def _scored(payloads: DataFrame, scorer: Callable[[list[str]], list[str]], tries: int) -> DataFrame:
    def attempt(texts: list[str]) -> tuple[list[str], str | None]:
        error = "not tried"
        for _ in range(max(1, tries)):
            try:
                found = list(scorer(texts))
            except Exception as e:  # noqa: BLE001 - whatever a scorer raises is a row's error
                error = f"{type(e).__name__}: {e}"
                continue
            if len(found) == len(texts):
                return found, None
            error = f"{len(found)} responses to {len(texts)} payloads"
        return [], error

    def run(batches):
        for pdf in batches:
            texts = pdf["payload"].tolist()
            found, error = attempt(texts)
            errors = [None] * len(texts)
            if error:
                each = [attempt([t]) for t in texts] if len(texts) > 1 else [([], error)]
                found, errors = [f[0] if f else None for f, _ in each], [e for _, e in each]
            digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pdf[["record_id"]].assign(response=[None if r is None else str(r) for r in found], error=errors, digest=digests)

    return payloads.mapInPandas(run, "record_id long, response string, error string, digest string")


def exchange(payloads: DataFrame, scorer: Callable[[list[str]], list[str]], path: str, tries: int = 3) -> DataFrame:
    """Score payloads and keep the responses under ``path``: a second run asks only for what is missing.

    Responses are kept with a digest of their payload, so a changed payload is asked
    for anew and failed ones are tried again by the next run.  Returns record_id,
    response and error of the given payloads, one row each; where several runs
    answered, the response that stands there first in byte order.
    """
    spark = payloads.sparkSession
    asked = payloads.select("record_id", "payload", F.sha2("payload", 256).alias("digest"))
    known = _kept(spark, path)
    todo = asked if known is None else asked.join(known.where("response is not null").select("record_id", "digest"), ["record_id", "digest"], "left_anti")
    _scored(todo, scorer, tries).write.mode("append").parquet(path)
    answers = spark.read.parquet(path).groupBy("record_id", "digest").agg(F.min("response").alias("response"), F.max("error").alias("error"))
    answers = answers.join(asked.select("record_id", "digest").distinct(), ["record_id", "digest"], "left_semi")
    return answers.select("record_id", "response", F.when(F.col("response").isNull(), F.col("error")).alias("error"))


def _kept(spark: SparkSession, path: str) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema("record_id long, response string, error string, digest string").parquet(path) if there else None


def parse_rerank_decisions(responses: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """record_id, location_id and confidence of the responses that count.

    The first line's words, with spaces between, are read; of a repeated word the last one wins, and a
    number is its leading numeric part.
    """
    words = F.split(F.regexp_extract("response", r"^([^\r\n]*)", 1), " +")
    last = lambda name: F.coalesce(F.substring(F.try_element_at(F.filter(words, lambda w: w.startswith(name)), F.lit(-1)), len(name) + 1, 1 << 20), F.lit(""))
    number = F.regexp_extract(last("confidence="), r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", 0)
    rows = responses.select("record_id", last("location_id=").alias("location_id"), F.coalesce(number.try_cast("double"), F.lit(0.0)).alias("confidence"))
    return rows.where((F.col("location_id") != "") & (F.col("confidence") > 0) & (F.col("confidence") >= config.rerank_min))


def apply_rerank(addresses: DataFrame, locations: DataFrame, top: DataFrame, decisions: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Candidates with the votes merged in: a vote can raise or add, never lower.

    Votes for unknown locations are dropped; the first of a repeated location_id counts.
    """
    places = locations.where("components is not null").groupBy("location_id").agg(F.min("components").alias("r"))
    mine = addresses.where("components is not null").select("record_id", F.col("components").alias("l"))
    voted = decisions.join(places, "location_id").join(mine, "record_id").join(top.select("record_id").distinct(), "record_id", "left_semi")
    voted = voted.withColumn("breakdown", breakdown("l", "r", component_scores("l", "r")))
    votes = voted.select("record_id", "location_id", "confidence", F.lit("llm").alias("strategy"), F.lit("llm_ranked").alias("reason"), "breakdown")
    return top_candidates(merge_candidates(top.drop("rank").unionByName(votes)), config)
