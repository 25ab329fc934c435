"""Shortlists by tiers against all pairs, split joins, plans of the pair stages."""

import random

import pytest
from pyspark.sql import functions as F

from addrweave.config import MatchConfig
from addrweave.operators import candidates as C
from addrweave.operators import match as M
from addrweave.operators import skew
from addrweave.operators.parse import parse_addresses, parse_distinct
from addrweave.storage import scratch


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def crowded(spark):
    """One street with many numbers, ids with several addresses, ZIPs of 5 to 10 digits, repeated records."""
    draw = random.Random(6)
    zips = ["33101", "33102", "331011", "33101-1234", "33101-1235", "33101-", ""]
    streets = ["N OAK ST", "N OAK AVE", "S OAK ST", "N OAKS ST", "N ELM ST", "E BISCAYNE BLVD"]
    cities = ["MIAMI", "MIAMY", "TAMPA", ""]
    place = lambda: f"{draw.choice([1, 1, 2, 3, 40, 41])} {draw.choice(streets)}, {draw.choice(cities)}, FL {draw.choice(zips)}"
    places = [(f"p{k:03}", place()) for k in range(220)] + [(f"p{k % 7:03}", place()) for k in range(60)]
    records = [(k, place()) for k in range(60)] + [(k, place()) for k in range(5)] + [(100, ", ,"), (101, None)]
    parsed = lambda rows, schema: parse_addresses(spark.createDataFrame(rows, schema), "raw_address").persist()
    return parsed(records, "record_id long, raw_address string"), parsed(places, "location_id string, raw_address string")


def rows(df):
    return sorted((r["record_id"], r["rank"], r["location_id"], round(r["confidence"], 9), r["strategy"], str(r["breakdown"])) for r in df.collect())


@pytest.mark.parametrize("config", [MatchConfig(), MatchConfig(max_candidates=2, clamp_confidence=False, fuzzy_min=0.7)])
def test_shortlists_are_those_of_all_pairs(spark, crowded, config):
    with scratch(spark):
        mine = rows(M.find_candidates(*crowded, config))
        theirs = rows(M.find_candidates(*crowded, config, "cross"))
    plain = lambda t: [r[:5] for r in t]
    assert plain(mine) == plain(theirs) and len(mine) > 100
    # where two shapes or variants tie, either breakdown explains the row
    assert sum(a == b for a, b in zip(mine, theirs, strict=True)) > 0.9 * len(mine)


def test_shortlists_by_shuffles(spark, crowded, no_broadcast, monkeypatch):
    monkeypatch.setattr(skew, "PAIRS", 50)
    with scratch(spark):
        assert [r[:5] for r in rows(M.find_candidates(*crowded))] == [r[:5] for r in rows(M.find_candidates(*crowded, method="cross"))]


def test_heavy_keys_are_split(spark, no_broadcast):
    """Half of the rows of both sides have one number; pairs of no task are over twice the median."""
    left = spark.range(4000).select(F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 400).alias("key"))
    right = spark.range(2000).select(F.col("id").alias("b"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 400).alias("key"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = skew.split_join(left, right, ["key"], "a", "b", pairs=5_000)
        tasks = sorted(r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect())
        plain = left.join(right, "key")
        assert got.count() == plain.count() and got.exceptAll(plain.select(got.columns)).isEmpty()
        heavy = skew.heavy_keys(left, right, ["key"], 5_000).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r["key"] for r in heavy] == [0] and len(tasks) == 8 and tasks[-1] <= 2 * tasks[4]


def test_distances_stand_before_the_pair_joins(spark, crowded):
    with scratch(spark):
        _, left = C.shapes(crowded[0])
        index = C.index_locations(crowded[1])
        scored = C.with_scores(C.keyed_pairs(left, index.groups, "number", MatchConfig()), MatchConfig())
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein") <= 4  # those of the bonus for long ZIPs alone


def test_conditions_reach_the_source(spark, tmp_path):
    spark.createDataFrame([(k, f"{k} N OAK ST, RENO, NV 89501") for k in range(20)], "record_id long, raw_address string").write.parquet(f"{tmp_path}/a")
    read = spark.read.parquet(f"{tmp_path}/a")
    for parse in (parse_addresses, parse_distinct):
        one = parse(read).where("record_id = 7 and components.city = 'RENO'")
        assert "EqualTo(record_id,7)" in one._jdf.queryExecution().executedPlan().toString()
        assert [r["components"]["street_number"] for r in one.collect()] == ["7"]
    plan = parse_addresses(read).where("components.city = 'RENO' and components.state = 'NV'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == parse_addresses(read)._jdf.queryExecution().optimizedPlan().toString().count("split(")


def test_distinct_texts(spark):
    texts = [None, "", "  ", ", ,", "1 N OAK ST, RENO, NV 89501", "1 N OAK ST, RENO, NV 89501", "x" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id long, raw_address string").selectExpr("*", "1 as key", "2 as components")
    mine, theirs = parse_distinct(df), parse_addresses(df)
    assert mine.columns == theirs.columns and sorted(map(str, mine.collect())) == sorted(map(str, theirs.collect()))


def test_pairs_are_merged_where_they_stand(spark, crowded, monkeypatch):
    """One row a pair needs no shuffle of all pairs; ids that stand there twice are grouped as before."""
    records, places = (df.where("components is not null").dropDuplicates([i]).persist() for df, i in zip(crowded, ("record_id", "location_id"), strict=True))
    plain = lambda df: sorted((r["record_id"], r["location_id"], r["confidence"], r["strategy"], r["reason"]) for r in df.collect())
    with scratch(spark):
        for a, b in ((records, places), crowded):
            scored = C.scored_pairs(a, b).persist()
            each = [C._one(scored, name, M.REASONS[name]) for name in ("canonical", "structured", "fuzzy")]
            theirs = plain(M.merge_candidates(C._union(each)))
            with monkeypatch.context() as patch:
                if b is places:
                    patch.setattr(M, "merge_candidates", None)
                assert plain(M.merge_pairs(scored, a, b)) == theirs and len(theirs) > 100
