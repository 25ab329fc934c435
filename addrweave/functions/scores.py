"""Similarity and scores of a pair of component sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cap
from .vocab import WEIGHTS

#: Component of each weighted comparison.
FIELDS = {"street_number": "street_number", "street_name": "street_name", "directional": "street_direction", "suffix": "street_suffix", "city": "city", "state": "state", "postal_code": "postal_code"}
FUZZY = ("street_name", "city")


def as_bytes(c: Column) -> Column:
    """One character for each UTF-8 byte, so that lengths and edits count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def exact_match(a: Column, b: Column) -> Column:
    return F.when((a != "") & (a == b), 1.0).otherwise(0.0)


def similarity_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer length; 0 if either is empty."""
    x, y = as_bytes(a), as_bytes(b)
    ratio = F.lit(1.0) - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.greatest(ratio, F.lit(0.0)))


def component_scores(left: str, right: str) -> dict[str, Column]:
    """Score of each weighted component of two structs."""
    out = {}
    for key, _ in WEIGHTS:
        a, b = F.col(f"{left}.{FIELDS[key]}"), F.col(f"{right}.{FIELDS[key]}")
        out[key] = similarity_ratio(a, b) if key in FUZZY else exact_match(a, b)
    return out


def structured_score(parts: dict[str, Column]) -> Column:
    """Weighted sum of the parts, added in the order of the weights."""
    total = None
    for key, weight in WEIGHTS:
        term = F.lit(weight) * parts[key]
        total = term if total is None else total + term
    return total


def zip_bonus(a: Column, b: Column) -> Column:
    """0.05 where ZIPs are more than 0.8 alike; different ones of five bytes never are."""
    long = F.greatest(F.octet_length(a), F.octet_length(b)) > 5
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 0.05).when(long & (similarity_ratio(a, b) > 0.8), 0.05).otherwise(0.0)


def fuzzy_score(structured: Column, parts: dict[str, Column], bonus: Column) -> Column:
    base = F.lit(0.6) * structured + F.lit(0.25) * parts["street_name"] + F.lit(0.15) * parts["city"]
    return F.least(base + bonus, F.lit(1.0))


def breakdown(left: str, right: str, parts: dict[str, Column]) -> Column:
    """array<struct<key, value, weight, left, right>> with one entry for each weighted component.

    ``value`` is both sides with a bar between, 127 bytes at most.
    """

    def entry(key: str, weight: float) -> Column:
        a, b = F.col(f"{left}.{FIELDS[key]}"), F.col(f"{right}.{FIELDS[key]}")
        value = cap(F.concat(a, F.lit("|"), b), 127)
        return F.struct(F.lit(key).alias("key"), value.alias("value"), (F.lit(weight) * parts[key]).alias("weight"), a.alias("left"), b.alias("right"))

    return F.array(*[entry(key, weight) for key, weight in WEIGHTS])
