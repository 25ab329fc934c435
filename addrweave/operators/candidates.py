"""Candidate pairs of addresses and locations, without a cross product.

Only what is scored counts here: addresses with equal components are one *shape*,
and locations with equal components one *group*, each known by a digest of 128
bits.  A pair can reach a threshold only if the house numbers are equal, or the
ZIPs are, or street and city are so similar that they alone reach the fuzzy
score.  These are four disjoint tiers of equi-joins, each with a bound on what its
pairs can score: by number (1.0), by ZIP (0.84), by pairs of different ZIPs so
similar that they earn a bonus (0.78), and by pairs of distinct (street, city)
values (0.73).  Edit distances are computed once for each pair of distinct values
that can matter, with the distance that the thresholds leave as the limit, and
are looked up by the joins of shapes and groups.

A shortlist of k needs less than all pairs:

- without equal numbers the score of a pair does not depend on the numbers, and in
  the last tier not on the ZIPs: of groups (and shapes) that differ in them alone
  the k first are enough, as what precedes them by an equal number or ZIP scores
  higher and counts itself;
- shapes with k candidates above the next tier's bound leave before that tier;
- breakdowns are made for the k rows that are left.

Heavy numbers, ZIPs and values are split on both sides (``split_join``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.scores import as_bytes, breakdown, component_scores, exact_match, fuzzy_score, similarity_ratio, structured_score, zip_bonus
from ..storage import discard, new_folder, spread, stored
from .skew import split_join

#: Cities at least so similar are paired first, and streets inside the pairs.
CITY = 0.5
_SLACK = 1e-9
#: The most that pairs of the tiers after the first can score.
BOUNDS = {"zip": 0.84 + _SLACK, "bonus": 0.78 + _SLACK, "names": 0.73 + _SLACK}
#: Ids kept of a group for shortlists, the largest ``max_candidates``.
FIRST = 16

SHAPE = {"number": "street_number", "direction": "street_direction", "street": "street_name", "suffix": "street_suffix", "city": "city", "state": "state", "zip": "postal_code", "key": "canonical_key"}
_EXACT = {"street_number": "number", "directional": "direction", "suffix": "suffix", "state": "state", "postal_code": "zip"}
_REST = ("directional", "suffix", "state")
#: What counts where neither numbers nor ZIPs are equal or similar.
NAMED = ("street", "city", "direction", "suffix", "state")


def once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """Add a column that is computed once a row, whatever reads it: conditions on it stay above a generator."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def _digest(components: str) -> Column:
    parts = [F.col(f"{components}.{c}") for c in SHAPE.values()]
    return F.md5(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]))


def _fields(prefix: str, components: str = "components") -> list[Column]:
    return [F.col(f"{components}.{c}").alias(f"{prefix}_{k}") for k, c in SHAPE.items()]


def shapes(addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """record_id, lid and components of the parsed records; lid and components (l_*) of the distinct shapes.  Both are stored."""
    records = stored(addresses.where("components is not null").select("record_id", _digest("components").alias("lid"), "components"))
    return records, stored(spread(records.select("lid", *_fields("l")).distinct(), "lid"))


@dataclass(frozen=True)
class LocationIndex:
    """Stored tables of parsed locations that every match reads.

    ``groups``: gid, rid (the smallest location_id), own and components (r_*) of each
    group; ``own`` is the location_id where one id stands there with different
    components (such a location has groups of its own).  ``members``: gid,
    location_id and components; ``first``: the ``FIRST`` smallest ids of each group, with the components.
    ``zips``, ``names``: the groups with the smallest rids of those that differ in
    the number alone, or in number and ZIP; ``name`` tells the latter apart, and
    ``head`` is the first of them.
    """

    groups: DataFrame
    members: DataFrame
    first: DataFrame
    zips: DataFrame
    names: DataFrame

    TABLES = ("groups", "members", "first", "zips", "names")

    def discard(self) -> None:
        discard(*[getattr(self, name) for name in self.TABLES])


def _smallest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(by))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= FIRST).drop("_rank")


def index_locations(locations: DataFrame, path: str | None = None) -> LocationIndex:
    """Store the tables of an index under ``path`` (a new folder of the shared one if none is given)."""
    path = path or new_folder(locations.sparkSession)
    rows = locations.where("components is not null").select("location_id", _digest("components").alias("gid"), "components")
    rows = stored(rows, f"{path}/rows")
    several = rows.groupBy("location_id").agg(F.min("gid").alias("low"), F.max("gid").alias("high")).where("low < high").select("location_id", F.col("location_id").alias("own"))
    rows_of = rows.join(several, "location_id", "left").withColumn("gid", F.when(F.col("own").isNotNull(), F.md5(F.concat("gid", "own"))).otherwise(F.col("gid")))
    members = stored(rows_of.groupBy("gid", "location_id", "own").agg(F.min("components").alias("components")), f"{path}/members")
    groups = members.select("gid", "own", "location_id", *_fields("r"))
    groups = groups.groupBy("gid", "own", *[f"r_{k}" for k in SHAPE]).agg(F.min("location_id").alias("rid"))
    groups = stored(spread(groups, "gid"), f"{path}/groups")
    first = stored(_smallest(members.select("gid", "location_id", "components"), ["gid"], "location_id"), f"{path}/first")
    named = ["own", *[f"r_{k}" for k in NAMED]]
    zips = stored(_smallest(groups.where("r_zip <> ''"), [*named, "r_zip"], "rid"), f"{path}/zips")
    name = F.md5(F.concat(*[x for p in map(F.col, named) for x in (F.coalesce(F.octet_length(p), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(p, F.lit("")))]))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("rid", "gid"))
    names = groups.withColumn("name", name).withColumn("_rank", rank).where(F.col("_rank") <= FIRST)
    names = stored(names.withColumn("head", F.col("_rank") == 1).drop("_rank"), f"{path}/names")
    discard(rows)
    return LocationIndex(groups, members, first, zips, names)


def read_index(spark, path: str) -> LocationIndex:
    return LocationIndex(*[spark.read.parquet(f"{path}/{name}") for name in LocationIndex.TABLES])


def _by_length(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """All pairs (x, y) whose lengths let them be that similar."""
    size = F.octet_length("x")
    reach = F.sequence(F.ceil(size * least - _SLACK).cast("int"), F.floor(size / least + _SLACK).cast("int"))
    return split_join(a.withColumn("size", F.explode(reach)), b.withColumn("size", F.octet_length("y")), ["size"], "x", "y").select("x", "y")


def _by_segment(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Pairs (x, y) that share a segment of y at about the same place.

    With a similarity of ``least`` y is at most k = y / least * (1 - least) edits
    away from x, so of its k + 1 segments one stands in x unedited, moved by k
    bytes at most.
    """
    edits = F.floor(F.col("q") / least * (1 - least) + _SLACK).cast("int")
    cut = lambda j: F.floor(j * F.col("q") / (F.col("k") + 1)).cast("int")
    parts = lambda df: df.withColumn("k", edits).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("at", cut(F.col("j"))).withColumn("n", cut(F.col("j") + 1) - F.col("at"))
    right = parts(b.withColumn("t", as_bytes(F.col("y"))).withColumn("q", F.length("t"))).select("y", "q", "j", F.substring("t", F.col("at") + 1, F.col("n")).alias("s"))
    p = F.length("t")
    left = a.withColumn("t", as_bytes(F.col("x"))).withColumn("q", F.explode(F.sequence(F.ceil(p * least - _SLACK).cast("int"), F.floor(p / least + _SLACK).cast("int"))))
    low, high = F.greatest(F.col("at") - F.col("k"), F.lit(0)), F.least(F.col("at") + F.col("k"), p - F.col("n"))
    left = parts(left).where(high >= low).withColumn("from", F.explode(F.sequence(low, high)))
    left = left.select("x", "q", "j", F.substring("t", F.col("from") + 1, F.col("n")).alias("s")).distinct()
    return split_join(left, right, ["q", "j", "s"], "x", "y").select("x", "y").distinct()


def bounded_similarity(x: Column, y: Column, least: Column) -> Column:
    """Similarity of two values that differ and aren't empty; null below ``least``."""
    a, b = as_bytes(x), as_bytes(y)
    longer = F.greatest(F.length(a), F.length(b))
    limit = F.greatest(F.floor((1 - F.greatest(least, F.lit(0.0))) * longer + _SLACK), F.lit(0)).cast("int")
    edits = F.call_function("levenshtein", a, b, limit)
    return F.transform(F.array(edits), lambda d: F.when(d >= 0, F.greatest(F.lit(1.0) - d / longer, F.lit(0.0))))[0]


def similar_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """x, y and similarity of all pairs of values of ``a`` (x) and ``b`` (y) that are as similar.

    ``least`` is over 0; empty values are similar to nothing.
    """
    a, b = a.where("x <> ''"), b.where("y <> ''")
    pairs = _by_segment(a, b, least) if least >= 0.6 else _by_length(a, b, least)
    alike = F.when(F.col("x") == F.col("y"), 1.0).otherwise(bounded_similarity(F.col("x"), F.col("y"), F.lit(least)))
    return once(pairs, "similarity", alike).where(F.col("similarity") >= least - _SLACK)


def reachable(config: MatchConfig, street: Column, city: Column, rest: Column | float = 3.0) -> Column:
    """Whether a pair without equal or similar numbers and ZIPs can reach a threshold; ``rest`` counts equal directions, suffixes and states."""
    rest = F.lit(rest) if isinstance(rest, float) else rest
    structured = F.lit(0.25) * street + F.lit(0.15) * city + F.lit(0.05) * rest
    fuzzy = F.lit(0.40) * street + F.lit(0.24) * city + F.lit(0.03) * rest
    return (structured >= config.structured_min - _SLACK) | (fuzzy >= config.fuzzy_min - _SLACK)


def _least_street(config: MatchConfig, city: float) -> float:
    """The similarity that a street needs where the city's is as given, and direction, suffix and state are equal."""
    return min((config.fuzzy_min - 0.09 - 0.24 * city) / 0.40, (config.structured_min - 0.15 - 0.15 * city) / 0.25) - _SLACK


def _least_city(config: MatchConfig) -> float:
    """The similarity that a city needs where all else is equal but number and ZIP."""
    return min((config.fuzzy_min - 0.09 - 0.40) / 0.24, (config.structured_min - 0.15 - 0.25) / 0.15) - _SLACK


def _need(config: MatchConfig, city: Column, structured: Column, fuzzy: Column) -> Column:
    """The street similarity that is needed where the other components give as much."""
    return F.least((config.structured_min - structured - 0.15 * city) / 0.25, (config.fuzzy_min - fuzzy - 0.24 * city) / 0.40) - _SLACK


def _at_most(a: Column, b: Column) -> Column:
    """A bound on the similarity of two values by their lengths."""
    x, y = F.octet_length(a), F.octet_length(b)
    return F.when((x == 0) | (y == 0), 0.0).when(a == b, 1.0).otherwise(1.0 - F.greatest(F.abs(x - y), F.lit(1)) / F.greatest(x, y))


def _street_table(rows: DataFrame) -> DataFrame:
    """l_street, r_street, n: the distance of each pair of different streets once, as far as one of ``rows`` (need) wants it."""
    rows = rows.where((F.col("l_street") != "") & (F.col("r_street") != "") & (F.col("l_street") != F.col("r_street")))
    rows = rows.where(_at_most(F.col("l_street"), F.col("r_street")) >= F.col("need"))
    pairs = rows.groupBy("l_street", "r_street").agg(F.min("need").alias("need"))
    return once(pairs, "n", bounded_similarity(F.col("l_street"), F.col("r_street"), F.col("need"))).where("n is not null").drop("need")


def _looked_up(a: str, b: str, found: str) -> Column:
    """Similarity of two columns with the looked-up one where they differ; null if that is too low to matter."""
    return F.when((F.col(a) == "") | (F.col(b) == ""), 0.0).when(F.col(a) == F.col(b), 1.0).otherwise(F.col(found))


def similar_values(left: DataFrame, right: DataFrame, config: MatchConfig) -> DataFrame:
    """Pairs of distinct (street, city) values that can reach a threshold without equal or similar numbers and ZIPs, stored.

    Cities are paired first.  In pairs of them at least ``CITY`` alike the streets
    are paired by length; streets of other cities have to be so much more alike
    that they share segments.
    """
    keys = ["l_street", "l_city", "r_street", "r_city"]
    lv, rv = spread(left.select(*keys[:2]).distinct(), *keys[:2]), right.select(*keys[2:]).distinct()
    inside, outside, low = _least_street(config, 1.0), _least_street(config, CITY), _least_city(config)
    of = lambda df, c, name: df.select(F.col(c).alias(name)).distinct()
    if min(inside, outside, low) <= 0:  # thresholds so low that any street or city qualifies
        both = once(once(lv.crossJoin(rv), "n", similarity_ratio(F.col("l_street"), F.col("r_street"))), "c", similarity_ratio(F.col("l_city"), F.col("r_city")))
        return stored(both.where(reachable(config, F.col("n"), F.col("c"))).select(*keys, "n", "c"))
    cities = similar_pairs(of(lv, "l_city", "x"), of(rv, "r_city", "y"), min(low, CITY))
    cities = stored(cities.select(F.col("x").alias("l_city"), F.col("y").alias("r_city"), F.col("similarity").alias("c")))
    size = F.octet_length("l_street")
    reach = F.sequence(F.ceil(size * inside - _SLACK).cast("int"), F.floor(size / inside + _SLACK).cast("int"))
    sized = lv.where("l_street <> ''").join(cities.where(F.col("c") >= CITY - _SLACK), "l_city").withColumn("size", F.explode(reach))
    same = split_join(sized, rv.where("r_street <> ''").withColumn("size", F.octet_length("r_street")), ["r_city", "size"], "l_street", "r_street").drop("size")
    streets = stored(_street_table(same.withColumn("need", _need(config, F.col("c"), F.lit(0.15), F.lit(0.09)))))
    found = same.join(streets, ["l_street", "r_street"], "left").withColumn("n", _looked_up("l_street", "r_street", "n"))
    found = found.where(reachable(config, F.col("n"), F.col("c"))).select(*keys, "n", "c")
    if outside <= 1:
        alike = similar_pairs(of(lv, "l_street", "x"), of(rv, "r_street", "y"), outside).select(F.col("x").alias("l_street"), F.col("y").alias("r_street"), F.col("similarity").alias("n"))
        alike = stored(alike)
        other = lv.join(alike, "l_street").join(cities.where(F.col("c") < CITY - _SLACK), "l_city").where(reachable(config, F.col("n"), F.col("c")))
        found = found.unionByName(other.join(rv, ["r_street", "r_city"]).select(*keys, "n", "c"))
    found = stored(found)
    discard(cities, streets)
    if outside <= 1:
        discard(alike)
    return found


def first_values(values: DataFrame, heads: DataFrame, config: MatchConfig) -> DataFrame:
    """The pairs of values that shortlists can need.

    Directions, suffixes and states move a score within bounds, so a pair of values
    whose best score is below the least score of others with enough names of
    locations (``heads``) has none of the first candidates.
    """
    fuzzy, structured = F.lit(0.40) * F.col("n") + F.lit(0.24) * F.col("c"), F.lit(0.25) * F.col("n") + F.lit(0.15) * F.col("c")
    least = F.greatest(F.when(fuzzy >= config.fuzzy_min + _SLACK, fuzzy), F.when(structured >= config.structured_min + _SLACK, structured))
    names = heads.where("own is null").groupBy("r_street", "r_city").agg(F.count("*").alias("names"))
    rows = values.join(names, ["r_street", "r_city"], "left").withColumn("least", least)
    mine = Window.partitionBy("l_street", "l_city")
    so_far = F.sum(F.when(F.col("least").isNotNull(), F.col("names"))).over(mine.orderBy(F.col("least").desc_nulls_last()))
    rows = rows.withColumn("full", (so_far >= config.max_candidates) & F.col("least").isNotNull())
    rows = rows.withColumn("bound", F.max(F.when(F.col("full"), F.col("least"))).over(mine))
    reached = F.greatest(fuzzy + F.lit(0.09), structured + F.lit(0.15)) >= F.col("bound") - _SLACK
    return rows.where(F.col("bound").isNull() | reached).select(*values.columns)


def _facts(pairs: DataFrame) -> DataFrame:
    """What the score of a pair needs besides the similarities of street and city."""
    parts = [exact_match(F.col(f"l_{c}"), F.col(f"r_{c}")).alias(key) for key, c in _EXACT.items()]
    same_key = (F.col("l_key") == F.col("r_key")) & (F.col("l_key") != "")
    known = [c for c in ("n", "c") if c in pairs.columns]
    return pairs.select("lid", "gid", "rid", "own", "l_street", "l_city", "r_street", "r_city", *known, *parts, zip_bonus(F.col("l_zip"), F.col("r_zip")).alias("bonus"), same_key.alias("same_key"))


def _bases() -> tuple[Column, Column]:
    """What the equal components add to the structured and the fuzzy score."""
    rest = sum((F.col(c) for c in _REST), F.lit(0.0))
    number, postal = F.col("street_number"), F.col("postal_code")
    return 0.35 * number + 0.05 * rest + 0.10 * postal, 0.21 * number + 0.03 * rest + 0.06 * postal + F.col("bonus")


def _not_equal(pairs: DataFrame, *keys: str) -> DataFrame:
    for key in keys:
        pairs = pairs.where((F.col(f"l_{key}") == "") | (F.col(f"l_{key}") != F.col(f"r_{key}")))
    return pairs


def similar_zips(left: DataFrame, right: DataFrame) -> DataFrame:
    """x and y: different ZIPs of shapes and groups more than 0.8 alike, stored.  Those of five digits never are, so this is most often empty."""
    of = lambda df, c, name: df.select(F.col(c).alias(name)).distinct()
    pairs = similar_pairs(of(left, "l_zip", "x"), of(right, "r_zip", "y"), 0.8)
    return stored(pairs.where((F.col("x") != F.col("y")) & (F.greatest(F.octet_length("x"), F.octet_length("y")) > 5) & (F.col("similarity") > 0.8)))


def keyed_sides(left: DataFrame, right: DataFrame, tier: str, zips: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Shapes and groups with the key (``on``) whose equality makes a pair of the tier."""
    key = "number" if tier == "number" else "zip"
    b = right.where(F.col(f"r_{key}") != "").withColumn("on", F.col(f"r_{key}"))
    if tier == "bonus":
        return left.join(zips.select(F.col("x").alias("l_zip"), F.col("y").alias("on")), "l_zip"), b
    return left.where(F.col(f"l_{key}") != "").withColumn("on", F.col(f"l_{key}")), b


def keyed_pairs(left: DataFrame, right: DataFrame, tier: str, config: MatchConfig, zips: DataFrame | None = None) -> DataFrame:
    """Facts and similarities (n, c) of the pairs of one tier that can reach a threshold.

    The tiers are ``number``, ``zip`` (equal ZIPs, no equal numbers) and ``bonus``
    (pairs of ``zips``, no equal numbers).  Two tables of distances are stored, which the result reads.
    """
    a, b = keyed_sides(left, right, tier, zips)
    met = split_join(a.select("on", "l_city").distinct(), b.select("on", "r_city").distinct(), ["on"], "l_city", "r_city")
    met = met.where((F.col("l_city") != "") & (F.col("r_city") != "") & (F.col("l_city") != F.col("r_city"))).select("l_city", "r_city").distinct()
    cities = stored(once(met, "city", similarity_ratio(F.col("l_city"), F.col("r_city"))))
    pairs = split_join(a, b, ["on"], "lid", "gid")
    if tier != "number":
        pairs = _not_equal(pairs, "number")
    structured, fuzzy = _bases()
    rows = _facts(pairs).join(cities, ["l_city", "r_city"], "left").withColumn("c", _looked_up("l_city", "r_city", "city")).drop("city")
    rows = rows.withColumn("need", _need(config, F.col("c"), structured, fuzzy))
    rows = rows.where(F.col("same_key") | (_at_most(F.col("l_street"), F.col("r_street")) >= F.col("need")))
    streets = stored(_street_table(rows.select("l_street", "r_street", "need")))
    rows = rows.join(streets, ["l_street", "r_street"], "left").withColumn("n", _looked_up("l_street", "r_street", "n"))
    return rows.where("n is not null and (same_key or n >= need)").drop("need")


def named_pairs(left: DataFrame, right: DataFrame, values: DataFrame, config: MatchConfig) -> DataFrame:
    """Facts and similarities of pairs of rows that can reach a threshold without equal or similar numbers and ZIPs, as if there were none.

    Values that need equal directions, suffixes and states too are joined on all of them.
    """
    near = left.join(values, ["l_street", "l_city"])
    loose = reachable(config, F.col("n"), F.col("c"), 2.0)
    rests = ("direction", "suffix", "state")
    strict = near.where(~loose).withColumns({f"r_{k}": F.col(f"l_{k}") for k in rests})
    for k in rests:
        strict = strict.where(F.col(f"r_{k}") != "")
    pairs = near.where(loose).join(right, ["r_street", "r_city"]).unionByName(strict.join(right, ["r_street", "r_city", *[f"r_{k}" for k in rests]]))
    pairs = pairs.withColumns({f"{side}_{k}": F.lit("") for side in "lr" for k in ("number", "zip", "key")})
    rest = sum((F.col(c) for c in _REST), F.lit(0.0))
    return _facts(pairs).where(reachable(config, F.col("n"), F.col("c"), rest))


def names_of(left: DataFrame) -> DataFrame:
    """The distinct names of shapes: lid (a digest of them), and what counts in the last tier."""
    return spread(left.select(_name_digest().alias("lid"), *[f"l_{k}" for k in NAMED]).distinct(), "lid")


def _name_digest() -> Column:
    parts = [F.col(f"l_{k}") for k in NAMED]
    return F.md5(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]))


def for_shapes(named: DataFrame, left: DataFrame, groups: DataFrame) -> DataFrame:
    """Results of distinct names for all shapes that have them, without pairs of the earlier tiers."""
    rows = split_join(named.withColumnRenamed("lid", "name"), left.select("lid", "l_number", "l_zip", _name_digest().alias("name")), ["name"], "gid", "lid").drop("name")
    rows = split_join(rows, groups.select("gid", "r_number", "r_zip"), ["gid"], "lid", "gid")
    rows = _not_equal(rows, "number", "zip").where(zip_bonus(F.col("l_zip"), F.col("r_zip")) == 0)
    return rows.drop("l_number", "r_number", "l_zip", "r_zip")


def with_scores(facts: DataFrame, config: MatchConfig) -> DataFrame:
    """Add the confidences of the three strategies (null where one does not apply); rows without any are left out."""
    parts = {k: F.col(k) for k in _EXACT} | {"street_name": F.col("n"), "city": F.col("c")}
    rows = facts.withColumn("s", structured_score(parts))
    rows = rows.withColumn("f", fuzzy_score(F.col("s"), parts, F.col("bonus")))
    s = F.col("s")
    hold = (lambda c: F.least(c, F.lit(1.0))) if config.clamp_confidence else (lambda c: c)
    canonical = F.when(F.col("same_key"), F.when(s >= 0.9, 1.0).otherwise(s))
    structured = F.when(s >= config.structured_min, hold(s))
    rows = rows.withColumns({"canonical": canonical, "structured": structured, "fuzzy": F.when(F.col("f") >= config.fuzzy_min, F.col("f"))})
    return rows.where("coalesce(canonical, structured, fuzzy) is not null").select("lid", "gid", "rid", "own", "n", "c", "canonical", "structured", "fuzzy")


def all_pairs(left: DataFrame, index: LocationIndex, config: MatchConfig) -> DataFrame:
    """Scored pairs of shapes and groups, every one that reaches a threshold."""
    values = similar_values(left, index.groups, config)
    zips = similar_zips(left, index.groups)
    tiers = ["number", "zip"] if zips.isEmpty() else ["number", "zip", "bonus"]
    tiers = [with_scores(keyed_pairs(left, index.groups, tier, config, zips), config) for tier in tiers]
    named = with_scores(named_pairs(names_of(left), index.groups, values, config), config)
    return _union([*tiers, for_shapes(named, left, index.groups)])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def candidate_pairs(addresses: DataFrame, locations: DataFrame, config: MatchConfig = MatchConfig(), method: str = "pruned") -> DataFrame:
    """record_id, location_id and both component structs (l, r) of pairs worth scoring.

    ``method="cross"`` gives all pairs, as a yardstick for small tables.
    """
    if method == "cross":
        sides = [df.where("components is not null").select(i, F.col("components").alias(x)) for df, i, x in ((addresses, "record_id", "l"), (locations, "location_id", "r"))]
        return sides[0].crossJoin(sides[1])
    return _expanded(addresses, locations, config).select("record_id", "location_id", "l", "r")


def _expanded(addresses: DataFrame, locations: DataFrame, config: MatchConfig) -> DataFrame:
    records, left = shapes(addresses)
    index = index_locations(locations)
    pairs = all_pairs(left, index, config)
    rows = split_join(pairs, index.members.select("gid", "location_id", F.col("components").alias("r")), ["gid"], "lid", "location_id")
    return split_join(rows, records.select("lid", "record_id", F.col("components").alias("l")), ["lid"], "location_id", "record_id")


def scored_pairs(addresses: DataFrame, locations: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """record_id, location_id, confidences of the three strategies and the breakdown of every pair that reaches a threshold.  Runs jobs when called."""
    rows = _expanded(addresses, locations, config)
    return rows.select("record_id", "location_id", "canonical", "structured", "fuzzy", breakdown("l", "r", pair_parts()).alias("breakdown"))


def pair_parts() -> dict[str, Column]:
    """Scores of the components of the structs l and r, with the similarities in n and c."""
    known = {"street_name": F.col("n"), "city": F.col("c")}
    return {k: known.get(k, v) for k, v in component_scores("l", "r").items()}


def score_pairs(pairs: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Confidences of the three strategies for pairs with both structs (l, r), each distance where it stands."""
    for name, key in (("n", "street_name"), ("c", "city")):
        pairs = once(pairs, name, similarity_ratio(F.col(f"l.{key}"), F.col(f"r.{key}")))
    parts = pair_parts()
    pairs = pairs.withColumn("structured_score", structured_score(parts))
    pairs = once(pairs, "fuzzy_score", fuzzy_score(F.col("structured_score"), parts, zip_bonus(F.col("l.postal_code"), F.col("r.postal_code"))))
    same_key = (F.col("l.canonical_key") == F.col("r.canonical_key")) & (F.col("l.canonical_key") != "")
    hold = (lambda c: F.least(c, F.lit(1.0))) if config.clamp_confidence else (lambda c: c)
    s = F.col("structured_score")
    return pairs.select(
        "record_id",
        "location_id",
        F.when(same_key, F.when(s >= 0.9, 1.0).otherwise(s)).alias("canonical"),
        F.when(s >= config.structured_min, hold(s)).alias("structured"),
        F.when(F.col("fuzzy_score") >= config.fuzzy_min, F.col("fuzzy_score")).alias("fuzzy"),
        breakdown("l", "r", parts).alias("breakdown"),
    )


def canonical_candidates(addresses: DataFrame, locations: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Pairs with the same canonical key: an equi-join."""
    key = F.col("components.canonical_key")
    sides = [df.where(key != "").select(key.alias("key"), i, F.col("components").alias(x)) for df, i, x in ((addresses, "record_id", "l"), (locations, "location_id", "r"))]
    scored = score_pairs(split_join(*sides, ["key"], "record_id", "location_id"), config)
    return scored.select("record_id", "location_id", F.col("canonical").alias("confidence"), F.lit("canonical").alias("strategy"), F.lit("canonical_key_match").alias("reason"), "breakdown")


def _one(scored: DataFrame, column: str, reason: str) -> DataFrame:
    return scored.where(F.col(column).isNotNull()).select("record_id", "location_id", F.col(column).alias("confidence"), F.lit(column).alias("strategy"), F.lit(reason).alias("reason"), "breakdown")


def structured_candidates(scored: DataFrame) -> DataFrame:
    return _one(scored, "structured", "weighted_component_score")


def fuzzy_candidates(scored: DataFrame) -> DataFrame:
    return _one(scored, "fuzzy", "approximate_text_similarity")
