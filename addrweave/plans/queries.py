"""One query for each operator, over addresses and locations of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import component_scores, similarity_ratio, structured_score
from ..functions.vocab import COMPONENTS
from ..operators import candidates as C
from ..operators import match as M
from ..operators import report as P
from ..operators import rerank as R
from ..operators.keys import KeyIndex
from ..operators.parse import canonical_key_index, parse_distinct
from ..sources.tables import load_locations, read_addresses, read_rerank_decisions
from ..storage import new_folder
from ..streaming.stream import match_stream
from .fixtures import addresses, locations, raw_addresses, raw_locations, responses


def _r6(name: str):
    return F.round(name, 6).alias(name)


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, *[F.coalesce(F.col(f"components.{c}"), F.lit("-")).alias(c) for c in COMPONENTS])


def _scored(spark, d):
    return C.scored_pairs(addresses(spark, d), locations(spark, d))


def _top(spark, d):
    return M.find_candidates(addresses(spark, d), locations(spark, d))


def _plain(df: DataFrame) -> DataFrame:
    return df.select("record_id", "location_id", _r6("confidence"), "strategy", "reason")


def q_load_locations(spark, d):
    return load_locations(raw_locations(spark, d)).select("location_id", "street", "city", "state", "postal_code", "address")


def q_clean_pasted_text(spark, d):
    return read_addresses(raw_addresses(spark, d)).select("record_id", "address")


def q_expand_abbreviations(spark, d):
    rows = read_addresses(raw_addresses(spark, d))
    return rows.select("record_id", T.expand_abbreviations(F.col("address")).alias("expanded"))


def q_tokenize(spark, d):
    rows = read_addresses(raw_addresses(spark, d))
    return rows.select("record_id", F.posexplode(T.tokenize(T.expand_abbreviations(F.col("address")))).alias("place", "token"))


def q_canonicalize_zip(spark, d):
    rows = raw_addresses(spark, d)
    return rows.select("record_id", T.canonicalize_zip(F.col("raw_address")).alias("zip"))


def q_parse_addresses(spark, d):
    return _flat(addresses(spark, d), "record_id")


def q_parse_locations(spark, d):
    return _flat(locations(spark, d), "location_id")


def q_canonical_key_index(spark, d):
    return canonical_key_index(addresses(spark, d), "record_id")


def q_parse_distinct(spark, d):
    return _flat(parse_distinct(read_addresses(raw_addresses(spark, d)), "address"), "record_id")


def q_seen_addresses(spark, d):
    """Addresses whose key a stored index of locations holds; the locations come in two inserts."""
    index = KeyIndex(spark, f"keys_{uuid.uuid4().hex}", new_folder(spark))
    places = locations(spark, d)
    half = F.pmod(F.xxhash64("location_id"), F.lit(2))
    for k in (0, 1):
        index.insert(places.where(half == k), "location_id")
    return index.seen(addresses(spark, d)).withColumn("representative", F.coalesce("representative", F.lit("-")))


def q_similarity_ratio(spark, d):
    names = locations(spark, d).select(F.col("components.street_name").alias("a")).distinct()
    return names.join(names.withColumnRenamed("a", "b"), F.col("a") < F.col("b")).select("a", "b", F.round(similarity_ratio(F.col("a"), F.col("b")), 6).alias("similarity"))


def q_score_components(spark, d):
    left = addresses(spark, d).where("components is not null").select("record_id", F.col("components").alias("l"))
    right = locations(spark, d).select("location_id", F.col("components").alias("r"))
    pairs = left.join(right, (F.col("l.postal_code") == F.col("r.postal_code")) & (F.col("l.postal_code") != ""))
    parts = component_scores("l", "r")
    return pairs.select("record_id", "location_id", *[F.round(v, 6).alias(k) for k, v in parts.items()], F.round(structured_score(parts), 6).alias("score"))


def q_canonical_candidates(spark, d):
    return _plain(C.canonical_candidates(addresses(spark, d), locations(spark, d)))


def q_structured_candidates(spark, d):
    return _plain(C.structured_candidates(_scored(spark, d)))


def q_fuzzy_candidates(spark, d):
    return _plain(C.fuzzy_candidates(_scored(spark, d)))


def q_merge_candidates(spark, d):
    return _plain(M.merge_pairs(_scored(spark, d), read_addresses(raw_addresses(spark, d)), load_locations(raw_locations(spark, d))))


def q_top_candidates(spark, d):
    return _top(spark, d).select("record_id", "rank", "location_id", _r6("confidence"), "strategy", "reason")


def _best(spark, d):
    return M.best_match(addresses(spark, d), _top(spark, d))


def q_best_match(spark, d):
    return _best(spark, d).select("record_id", F.coalesce("location_id", F.lit("-")).alias("location_id"), "selected_strategy", "selected_confidence")


def q_unmatched_addresses(spark, d):
    return M.unmatched_addresses(addresses(spark, d), _top(spark, d))


def q_match_outcome(spark, d):
    return M.match_outcome(addresses(spark, d), _top(spark, d))


def q_match_results(spark, d):
    rows = M.match_addresses(addresses(spark, d), locations(spark, d))
    ids = F.array_join(F.transform("candidates", lambda c: c["location_id"]), ",")
    return rows.select("record_id", "outcome", "selected_strategy", "selected_confidence", F.size("candidates").cast("long").alias("n_candidates"), ids.alias("location_ids"))


def q_match_documents(spark, d):
    return P.match_documents(M.match_addresses(addresses(spark, d), locations(spark, d)))


def q_rerank_payloads(spark, d):
    return R.rerank_payloads(addresses(spark, d), _top(spark, d), locations(spark, d))


def q_parse_rerank_decisions(spark, d):
    top = _top(spark, d)
    return R.parse_rerank_decisions(responses(None, top)).select("record_id", "location_id", _r6("confidence"))


def q_read_rerank_decisions(spark, d):
    """Responses written as lines and read back."""
    path = new_folder(spark)
    responses(None, _top(spark, d)).select(F.concat_ws("\t", F.col("record_id").cast("string"), "response").alias("value")).write.text(path)
    return read_rerank_decisions(spark, path)


def q_apply_rerank(spark, d):
    top = _top(spark, d)
    out = R.apply_rerank(addresses(spark, d), locations(spark, d), top, R.parse_rerank_decisions(responses(None, top)))
    return out.select("record_id", "rank", "location_id", _r6("confidence"), "strategy", "reason")


def q_score_payloads(spark, d):
    def first(payloads):
        import json

        return [f"location_id={json.loads(p)['candidates'][0]['location_id']} confidence=0.9" for p in payloads]

    return R.score_payloads(q_rerank_payloads(spark, d), first).select("record_id", "response")


def q_audit_zip_mismatch(spark, d):
    return P.audit_zip_mismatch(_best(spark, d), locations(spark, d)).select("record_id", "location_id", "address_zip", "location_zip", _r6("confidence"))


def q_explain_matches(spark, d):
    return P.explain_matches(_best(spark, d)).select("record_id", "location_id", "component", "address_value", "location_value", _r6("weight"))


def q_location_count(spark, d):
    return P.location_count(load_locations(raw_locations(spark, d)))


def q_match_stream(spark: SparkSession, d: str) -> DataFrame:
    """Addresses as a stream of files, matched batch by batch."""
    root = new_folder(spark)
    rows = raw_addresses(spark, d)
    rows.write.parquet(f"{root}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(f"{root}/in")
    match_stream(arriving, locations(spark, d), f"{root}/out", f"{root}/state").awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.select("record_id", F.coalesce("location_id", F.lit("-")).alias("location_id"), "selected_strategy", "selected_confidence")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
