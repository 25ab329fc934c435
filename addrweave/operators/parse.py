"""Addresses into components, by staged built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonicalize_zip, cap, expand_abbreviations, is_primary_suffix, is_unit_followup, is_unit_token, is_zip_code, normalize_direction, normalize_state, strip_ordinal, tokenize
from ..storage import spread


def _places(array: str, test):
    return F.transform(array, lambda w, i: F.when(test(w, i), i))


def parse_addresses(df: DataFrame, text_col: str = "raw_address", out: str = "components") -> DataFrame:
    """Add a struct of components (all strings, '' where missing; null if there are no tokens).

    The rules take tokens away in turn: the last ZIP, the last word as state, the
    unit and what follows it, the house number, the first word as direction, the
    first suffix; what stands before the suffix is the street, behind it the city.
    Other columns are kept; names that begin with an underscore are the parser's.
    """
    before = [F.col(c) for c in df.columns if c != out]
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.lit(-1)
    df = df.withColumn("_t", F.when(text != "", tokenize(expand_abbreviations(text))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_n", F.size("_t"))
    df = df.withColumn("_z", F.coalesce(F.array_max(_places("_t", lambda w, i: is_zip_code(w))), none))
    df = df.withColumn("_s", F.when(F.col("_z") == F.col("_n") - 1, F.col("_n") - 2).otherwise(F.col("_n") - 1))
    free = lambda i: (i != F.col("_z")) & (i != F.col("_s"))
    df = df.withColumn("_u", F.coalesce(F.array_min(_places("_t", lambda w, i: is_unit_token(w) & free(i))), F.col("_n")))
    df = df.withColumn("_v", F.coalesce(F.array_min(_places("_t", lambda w, i: (i > F.col("_u")) & ~(free(i) & is_unit_followup(w)))), F.col("_n")))
    df = df.withColumn("_a", F.filter("_t", lambda w, i: free(i) & ((i < F.col("_u")) | (i >= F.col("_v")))))
    number = "^[0-9-]+"
    df = df.withColumn("_h", F.coalesce(F.array_min(_places("_a", lambda w, i: w.rlike(number))), none))
    df = df.withColumn("_number", F.when(F.col("_h") >= 0, F.regexp_extract(F.get("_a", F.col("_h")), number, 0)).otherwise(""))
    rest = F.transform("_a", lambda w, i: F.when(i == F.col("_h"), F.regexp_replace(w, number, "")).otherwise(w))
    df = df.withColumn("_b", F.filter(rest, lambda w: w != ""))
    df = df.withColumn("_c", F.slice("_b", 2, F.greatest(F.size("_b"), F.lit(1))))
    df = df.withColumn("_f", F.coalesce(F.array_min(_places("_c", lambda w, i: is_primary_suffix(w))), none))
    has = F.col("_f") >= 0
    street = F.when(has, F.slice("_c", 1, F.greatest(F.col("_f"), F.lit(0)))).otherwise(F.col("_c"))
    parts = {
        "street_number": F.col("_number"),
        "street_direction": F.coalesce(normalize_direction(F.get("_b", F.lit(0))), F.lit("")),
        "street_name": cap(F.array_join(F.transform(street, strip_ordinal), " "), 127),
        "street_suffix": F.when(has, F.get("_c", F.col("_f"))).otherwise(""),
        "unit": cap(F.array_join(F.slice("_t", F.col("_u") + 1, F.greatest(F.col("_v") - F.col("_u"), F.lit(0))), " "), 127),
        "city": F.when(has, cap(F.array_join(F.filter("_c", lambda w, i: i > F.col("_f")), " "), 127)).otherwise(""),
        "state": F.coalesce(normalize_state(F.get("_t", F.col("_s"))), F.lit("")),
        "postal_code": F.when(F.col("_z") >= 0, canonicalize_zip(F.get("_t", F.col("_z")))).otherwise(""),
    }
    df = df.withColumns({f"_p_{k}": v for k, v in parts.items()})
    key = [f"_p_{k}" for k in ("street_number", "street_direction", "street_name", "street_suffix", "city", "state", "postal_code")]
    full = (F.col("_p_street_number") != "") & (F.col("_p_street_name") != "")
    df = df.withColumn("_key", F.when(full, cap(F.concat_ws("|", *key), 255)).otherwise(""))
    made = F.struct(*[F.col(f"_p_{k}").alias(k) for k in parts], F.col("_key").alias("canonical_key"))
    # a generator of one row: conditions on the result stay above it, so that no join
    # computes the rules anew, and conditions on other columns still reach the source
    made = F.explode(F.array(F.when(F.col("_n") > 0, made))).alias(out)
    return df.select(*before, made)


def parse_distinct(df: DataFrame, text_col: str = "raw_address", out: str = "components") -> DataFrame:
    """As ``parse_addresses``, with the rules applied once to each distinct text.

    Texts are folded, parsed and joined back on a hash and the text.  Conditions on
    other columns still reach the source of the rows; the texts that are parsed are
    those of the whole table, so a lookup of few rows is better parsed row by row.
    Empty texts are not shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(text.alias("_text")).where("_text <> ''").distinct()
    texts = spread(texts, "_text")
    parsed = parse_addresses(texts, "_text", "_parsed").select(F.xxhash64("_text").alias("_hash"), "_text", "_parsed")
    before = [c for c in df.columns if c != out]
    rows = df.withColumns({"_text": text, "_hash": F.xxhash64(text)})
    found = rows.where("_text <> ''").join(parsed, ["_hash", "_text"], "left").select(*before, F.col("_parsed").alias(out))
    return found.unionByName(rows.where("_text = ''").select(*before, F.lit(None).cast(found.schema[out].dataType).alias(out)))


def canonical_key_index(parsed: DataFrame, id_col: str, components: str = "components") -> DataFrame:
    """canonical_key, the smallest id that has it and how many rows do."""
    keyed = parsed.select(F.col(f"{components}.canonical_key").alias("canonical_key"), F.col(id_col).alias("id"))
    return keyed.where("canonical_key <> ''").groupBy("canonical_key").agg(F.min("id").alias("representative"), F.count("*").alias("members"))
