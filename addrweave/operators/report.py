"""Documents, audits and explanations of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.vocab import COMPONENTS, WEIGHTS

_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def clean(c: Column) -> Column:
    """Without the control bytes that JSON texts leave out."""
    return F.regexp_replace(c, _CONTROL, "")


def number(c: Column, pattern: str) -> Column:
    """A JSON number with fixed decimals, rounded from the exact double."""
    places = len(pattern) - 2
    return F.call_function("format_number", c, F.lit(pattern)).cast(f"decimal({places + 4},{places})")


def _candidate(c: Column, *more: str) -> list[Column]:
    texts = lambda *names: [clean(c[n]).alias(n) for n in names]
    return [*texts("location_id"), number(c["confidence"], "0.000").alias("confidence"), *texts("strategy", "reason", *more)]


def match_documents(results: DataFrame) -> DataFrame:
    """record_id and one JSON document with the best candidate, all candidates, diagnostics and components.

    Confidences have three decimals, weights two; components are empty texts where
    the address has no words.
    """
    entry = lambda k: F.struct(clean(F.col("best.breakdown")[k]["value"]).alias("value"), number(F.col("best.breakdown")[k]["weight"], "0.00").alias("weight"))
    weights = F.struct(*[entry(k).alias(key) for k, (key, _) in enumerate(WEIGHTS)])
    best = F.struct(*_candidate(F.col("best"), "street", "city", "state", "postal_code"), weights.alias("breakdown"))
    body = F.struct(
        F.when(F.col("best").isNotNull(), best).alias("best_candidate"),
        F.transform("candidates", lambda c: F.struct(*_candidate(c))).alias("candidates"),
        F.struct("selected_strategy", "selected_confidence").alias("diagnostics"),
        F.struct(*[F.coalesce(clean(F.col(f"record_components.{c}")), F.lit("")).alias(c) for c in COMPONENTS]).alias("record_components"),
    )
    return results.select("record_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def explain_matches(best: DataFrame) -> DataFrame:
    """One row for each record and component of its best match, with both values in full."""
    rows = best.where("location_id is not null").select("record_id", "location_id", F.inline("breakdown"))
    return rows.select("record_id", "location_id", F.col("key").alias("component"), F.col("left").alias("address_value"), F.col("right").alias("location_value"), "weight")


def audit_zip_mismatch(best: DataFrame, locations: DataFrame) -> DataFrame:
    """Records whose best match is fuzzy although both ZIPs are there and differ."""
    theirs = locations.select("location_id", F.col("components.postal_code").alias("location_zip")).dropDuplicates(["location_id"])
    rows = best.where("selected_strategy = 'fuzzy'").join(theirs, "location_id")
    mine = F.col("components.postal_code")
    return rows.where((mine != "") & (F.col("location_zip") != "") & (mine != F.col("location_zip"))).select("record_id", "location_id", mine.alias("address_zip"), "location_zip", "confidence")


def with_outcome_counts(results: DataFrame, counts: Observation) -> DataFrame:
    """The same rows; ``counts`` gets how many are ``empty``, ``matched`` and ``no_match`` by the job that writes them."""
    return results.observe(counts, *[F.count_if(F.col("outcome") == name).alias(name) for name in ("empty", "matched", "no_match")])


def location_count(locations: DataFrame) -> DataFrame:
    return locations.agg(F.count("*").alias("locations"))
