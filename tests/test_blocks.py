"""Shapes and groups scored in blocks: distances, cuts of keys, and how few pairs Spark joins."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from addrweave.config import MatchConfig
from addrweave.functions import edits
from addrweave.operators import blocks
from addrweave.operators import candidates as C
from addrweave.operators import match as M
from addrweave.operators.parse import parse_addresses
from addrweave.storage import scratch


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("pairs", [7, 1 << 16])
def test_similarities_against_plain_loops(monkeypatch, pairs):
    monkeypatch.setattr(edits, "PAIRS", pairs)
    draw = random.Random(3)
    words = lambda n: ["".join(draw.choice("abÄ€ ") for _ in range(draw.choice([0, 1, 4, 9, 30, 63, 64, 65, 90]))) for _ in range(n)]
    x, y = [*words(20), "same"], [*words(17), "same"]
    found = edits.similarities(pa.array(x), pa.array(y))
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            p, q = a.encode(), b.encode()
            assert found[i, j] == (1.0 - distance(p, q) / max(len(p), len(q)) if p and q else 0.0)


@pytest.fixture(scope="module")
def street(spark):
    """Many locations of few numbers, ZIPs and names."""
    draw = random.Random(8)
    place = lambda: f"{draw.choice([7, 8, 90])} {draw.choice('NS')} {draw.choice(['OAK', 'OAKS', 'ELM', 'ELM PARK', 'PINE'])} {draw.choice(['ST', 'AVE'])}, {draw.choice(['RENO', 'RENOS', 'OMAHA'])}, NV {draw.choice(['89501', '89502', '89501-1234', '89501-1235', ''])}"
    parsed = lambda rows, ident: parse_addresses(spark.createDataFrame(rows, f"{ident}, raw_address string"), "raw_address").persist()
    return parsed([(k, place()) for k in range(80)], "record_id long"), parsed([(f"p{k % 290:03}", place()) for k in range(300)], "location_id string")


@pytest.mark.parametrize("rows", [5, 1 << 14])
def test_cut_keys_lose_nothing(spark, street, monkeypatch, rows):
    """Keys of more rows than stay together; chunks and values of a few pairs."""
    monkeypatch.setattr(blocks, "ROWS", rows)
    plain = lambda df: sorted((r["record_id"], r["rank"], r["location_id"], r["confidence"], r["strategy"]) for r in df.collect())
    with scratch(spark):
        assert plain(M.find_candidates(*street)) == plain(M.find_candidates(*street, method="cross"))


def test_blocks_are_scored_as_pairs(spark, street):
    """Every confidence, strategy and similarity of a block, bit by bit, in chunks of any size."""
    config = MatchConfig(max_candidates=16)
    with scratch(spark):
        _, left = C.shapes(street[0])
        index = C.index_locations(street[1])
        for tier in ("number", "zip"):
            a, b = (df.withColumn("block", F.col("on")).toArrow() for df in C.keyed_sides(left, index.groups, tier))
            theirs = C.with_scores(C.keyed_pairs(left, index.groups, tier, config), config)
            theirs = M._first(M._best_strategy(theirs), config).select(*M.FOUND).collect()
            for pairs in (300, 1 << 18):
                with pytest.MonkeyPatch.context() as patch:
                    patch.setattr(blocks, "PAIRS", pairs)
                    patch.setattr(blocks, "VALUES", pairs)
                    mine = blocks.score_blocks(a, b, tier == "number", config).to_pylist()
                free = lambda rows: sorted(tuple(r[c] for c in M.FOUND) for r in rows if r["own"] is None)
                assert free(mine) == free(theirs) and len(mine) > 100


def test_pairs_of_a_number_stay_in_their_block(spark, street, monkeypatch):
    """Shortlists join no shapes and groups by number or ZIP in Spark: that makes a row of every pair."""
    monkeypatch.setattr(C, "keyed_pairs", None)
    with scratch(spark):
        records, left = C.shapes(street[0])
        index = C.index_locations(street[1])
        found = M.first_of_blocks(*C.keyed_sides(left, index.groups, "number"), True, MatchConfig())
        assert found.groupBy("lid", "own").count().where("own is null").agg(F.max("count")).first()[0] <= 5


def test_values_that_no_shortlist_needs(spark):
    """Of six streets in one city the one that is alike has enough names; far ones go, near ones stay."""
    values = spark.createDataFrame([("OAK", "RENO", "OAK", "RENO", 1.0, 1.0), ("OAK", "RENO", "OAKS", "RENO", 0.8, 1.0), ("OAK", "RENO", "OAT", "RENO", 0.6, 1.0), ("ELM", "RENO", "OAT", "RENO", 0.6, 1.0)], "l_street string, l_city string, r_street string, r_city string, n double, c double")
    heads = spark.createDataFrame([("OAK", "RENO", None)] * 5 + [("OAT", "RENO", None), ("OAKS", "RENO", "p1")], "r_street string, r_city string, own string")
    kept = C.first_values(values, heads, MatchConfig()).collect()
    assert sorted((r["l_street"], r["r_street"]) for r in kept) == [("ELM", "OAT"), ("OAK", "OAK"), ("OAK", "OAKS")]
