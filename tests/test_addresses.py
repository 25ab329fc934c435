"""Cleaning, parsing, scores and matching against rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from addrweave.config import MatchConfig
from addrweave.functions.scores import component_scores, fuzzy_score, similarity_ratio, structured_score, zip_bonus
from addrweave.functions.text import canonicalize_zip, clean_pasted_text, expand_abbreviations
from addrweave.functions.vocab import COMPONENTS, EXPANSIONS, ORDINALS
from addrweave.operators import candidates as C
from addrweave.operators import match as M
from addrweave.operators.parse import parse_addresses
from addrweave.operators.report import explain_matches
from addrweave.operators.rerank import parse_rerank_decisions
from addrweave.plans import fixtures as X
from addrweave.sources.tables import load_locations, read_table, write_documents

from .conftest import SF

PARSED = {
    "601 NE 1 AVE, Miami, FL 33132": "601/NE/1/AVE//MIAMI/FL/33132",
    "601 NE 1ST AVE, MIAMI, FL 33132": "601/NE/FIRST/AVE//MIAMI/FL/33132",
    "601 NE 1ST AVE MIAMI FL 33132": "601/NE/FIRST/AVENUE//MIAMI/FL/33132",
    "123 Main St, Miami, FL 33101": "123/MAIN//ST//MIAMI/FL/33101",
    "123 N Main St., Miami, FL 33101-1234": "123/N/MAIN/STREET//MIAMI/FL/33101-1234",
    "100 Ocean View Dr Apt 5B, Miami Beach, FL 33139": "100/OCEAN/VIEW/DRIVE/APARTMENT 5B/MIAMI BEACH/FL/33139",
    "500 W 51st Street, New York, NY 10019": "500/W/51/STREET//NEW YORK/NY/10019",
    "12345 SW 8 St, Miami, FL": "8/SW//ST//MIAMI/FL/12345",
    "1200 Broadway, New York, NY 10001": "1200/BROADWAY/NEW YORK////NY/10001",
    "77 E Oak Ave, Omaha, NE 68102": "77/E/OAK/AVE//OMAHA/NO/68102",
    "10 S Elm Ct, Hartford, CT 06103": "10/S/ELM/CT//HARTFORD/CO/06103",
    "45A NW 7th Ave #12, Miami, FL 33128": "45/A/NORTHWEST SEVENTH/AVENUE/#12/MIAMI/FL/33128",
    "12 N Oak St Unit 4 LA Jolla CA 92037": "12/N/OAK/STREET/UNIT 4 LA/JOLLA/CA/92037",
    "9 E 5TH, Reno, NV 89501": "9/E/5 RENO////NV/89501",
    "601 NE 1 AVE, Miami": "601/NE/1/AVE///MI/",
    "601 NE 1 AVE, Miami, FL 33132 USA": "601/NE/1/AVE/FL/MIAMI/US/33132",
    "Main": "//////MA/",
}
SCORES = {
    "601 NE 1 AVE, MIAMI, FL 33132": (1.0000000000000002, 1.0),
    "601 NE 1ST AVE, MIAMI, FL 33132": (0.75, 0.65),
    "601 NE 2 AVE, MIAMI, FL 33132": (0.75, 0.65),
    "602 NE 1 AVE, MIAMI, FL 33132": (0.65, 0.8400000000000001),
    "601 NE 1 AVE, MIAMI, FL ": (0.9000000000000001, 0.9400000000000001),
    "601 NE 1 AVE, HIALEAH, FL 33010": (0.7928571428571429, 0.7685714285714286),
    "601 NW 1 AVE, MIAMI, FL 33128": (0.8500000000000001, 0.91),
    "601 NE 1 AVE, MIAMI, FL 33132-1234": (0.9000000000000001, 0.9400000000000001),
}


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "clean"), [("  Acme Corp\t601 NE 1 AVE\tMiami\tFL 33132\n", "601 NE 1 AVE Miami FL 33132"), ("Suite 5, 12 Oak", "5, 12 Oak"), ("#5 12 Oak", "12 Oak"), ("A1 B2", "A1 B2"), (None, "")])
def test_clean(spark, raw, clean):
    assert one(spark, raw, clean_pasted_text) == clean


@pytest.mark.parametrize(("raw", "zip_"), [("33132-1234", "33132-1234"), ("FL 33132", "33132"), ("331-32", "33132"), ("331-321-234", "331321-234"), ("33132 1234", "331321234"), ("33132--1", "33132--1"), ("3313", "3313")])
def test_zip(spark, raw, zip_):
    assert one(spark, raw, canonicalize_zip) == zip_


def test_parse(spark):
    rows = parse_addresses(spark.createDataFrame([(k,) for k in PARSED], "raw_address string")).collect()
    for r in rows:
        parts = [r["components"][c] for c in COMPONENTS[:-1]]
        assert "/".join(parts) == PARSED[r["raw_address"]], r["raw_address"]
        number, name = parts[0], parts[2]
        key = "|".join(parts[:4] + parts[5:]) if number and name else ""
        assert r["components"]["canonical_key"] == key
    empty = parse_addresses(spark.createDataFrame([(", ,",), ("",), (None,)], "raw_address string")).collect()
    assert [r["components"] for r in empty] == [None] * 3


def test_scores(spark):
    left = parse_addresses(spark.createDataFrame([("601 NE 1 AVE, Miami, FL 33132",)], "raw_address string")).select(F.col("components").alias("l")).persist()
    right = parse_addresses(spark.createDataFrame([(k,) for k in SCORES], "raw_address string")).select("raw_address", F.col("components").alias("r")).persist()
    parts = component_scores("l", "r")
    s = structured_score(parts)
    f = fuzzy_score(s, parts, zip_bonus(F.col("l.postal_code"), F.col("r.postal_code")))
    for r in left.crossJoin(right).select("raw_address", s.alias("s"), f.alias("f")).collect():
        assert (r["s"], r["f"]) == pytest.approx(SCORES[r["raw_address"]], abs=1e-15)


@pytest.mark.parametrize(("a", "b", "ratio"), [("", "A", 0), ("OAK", "OAKS", 0.75), ("MIAMI", "HIALEAH", 0.2857142857142857), ("33132", "33133", 0.8), ("33132-1234", "33132-1235", 0.9), ("é", "e", 0.0)])
def test_similarity(spark, a, b, ratio):
    assert one(spark, a, lambda c: similarity_ratio(c, F.lit(b))) == pytest.approx(ratio, abs=1e-12)


def test_config():
    assert MatchConfig(structured_min=1.5, max_candidates=17) == MatchConfig()
    assert MatchConfig(max_candidates=3).max_candidates == 3
    texts = {"X_FUZZY_MIN": "0.4", "X_STRUCTURED_MIN": "2", "X_RERANK_MIN": "high", "X_MAX_CANDIDATES": "16", "X_CLAMP_CONFIDENCE": "false"}
    assert MatchConfig.from_mapping(texts, "X_") == MatchConfig(fuzzy_min=0.4, max_candidates=16, clamp_confidence=False)


def test_locations_without_a_part_are_left_out(spark):
    rows = [("a", "1 n oak st", "reno", "nv", None), ("", "x", "y", "z", "1"), ("b", None, "y", "z", "1"), ("c", "x", "", "z", "1")]
    got = load_locations(spark.createDataFrame(rows, "location_id string, street string, city string, state string, zip_code string")).collect()
    assert [(r["location_id"], r["address"]) for r in got] == [("a", "1 N OAK ST, RENO, NV ")]


@pytest.fixture(scope="module")
def sides(spark):
    records = X.addresses(spark, SF).orderBy("record_id").limit(600).persist()
    return records, X.locations(spark, SF)


@pytest.mark.parametrize("config", [MatchConfig(), MatchConfig(structured_min=0.5, fuzzy_min=0.4), MatchConfig(structured_min=0.9, fuzzy_min=0.8), MatchConfig(structured_min=0.14, fuzzy_min=0.1)])
def test_pruned_is_cross(spark, sides, config):
    records = sides[0].limit(60) if config.fuzzy_min < 0.2 else sides[0]
    scored = lambda how: C.score_pairs(C.candidate_pairs(records, sides[1], config, how), config).where("coalesce(canonical, structured, fuzzy) is not null")
    pairs = lambda how: sorted((r[0], r[1]) for r in scored(how).select("record_id", "location_id").collect())
    assert pairs("pruned") == pairs("cross")


def test_similar_pairs(spark):
    import random

    draw = random.Random(2)
    some = ["".join(draw.choice("ABé ") for _ in range(draw.randint(0, 14))) for _ in range(120)]
    a, b = spark.createDataFrame([(x,) for x in set(some[:60])], "x string"), spark.createDataFrame([(x,) for x in set(some[40:])], "y string")
    every = a.crossJoin(b).withColumn("similarity", similarity_ratio(F.col("x"), F.col("y"))).collect()
    for least in (0.3, 0.5, 0.6, 0.725, 0.9, 1.0):
        assert sorted(map(tuple, C.similar_pairs(a, b, least).collect())) == sorted(tuple(r) for r in every if r["similarity"] >= least - 1e-9)


def test_winners(spark, sides):
    for clamp, counts in ((True, {"canonical": 132, "fuzzy": 390, "structured": 13, "none": 65}), (False, {"structured": 132, "canonical": 13, "fuzzy": 390, "none": 65})):
        top = M.find_candidates(*sides, MatchConfig(clamp_confidence=clamp)).persist()
        best = M.best_match(sides[0], top)
        assert {r[0]: r[1] for r in best.groupBy("selected_strategy").count().collect()} == counts
        assert top.count() == 609


def test_expansion_is_a_chain_of_replacements(spark):
    import random

    draw = random.Random(3)
    words = ["ST", "ST.", "N", "N.", "NE", "1st", "21ST", "ave", "AVE.", "x", "", "ST,", "ST.ST.", "CT", "é", "ST.LOUIS", "\t", "a.b", "HWY.", "PKY."]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 12))) for _ in range(400)] + ["N " * k for k in range(8)] + [" ".join(draw.choice(words) for _ in range(300)) for _ in range(20)]

    def plain(t):
        out = bytes(c - 32 if 97 <= c <= 122 else c for c in f" {t} ".encode())[:511].decode(errors="ignore").encode()
        for short, long in (*EXPANSIONS, *ORDINALS):
            out = out.replace(short.encode(), long.encode())
        return out

    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", expand_abbreviations(F.col("t")).cast("binary").alias("x")).collect()
    assert all(bytes(r["x"]) == plain(texts[r["k"]]) for r in got)


def test_caps_count_bytes(spark):
    assert one(spark, "é" * 300, clean_pasted_text) == "é" * 255
    row = load_locations(spark.createDataFrame([("a", "é" * 100, "c", "s", None)], "location_id string, street string, city string, state string, zip_code string")).select(F.octet_length("street")).first()
    assert row[0] == 126


def test_bars_in_values(spark):
    left = parse_addresses(spark.createDataFrame([(1, "12 N OAK|ELM ST, RENO, NV 89501")], "record_id long, raw_address string"))
    right = parse_addresses(spark.createDataFrame([("a", "12 N OAK|ELM ST, RENO, NV 89501")], "location_id string, raw_address string"))
    top = M.find_candidates(left, right)
    rows = {r["component"]: (r["address_value"], r["location_value"]) for r in explain_matches(M.best_match(left, top)).collect()}
    assert rows["street_name"] == ("OAK|ELM", "OAK|ELM")


def test_nothing_need_be_kept(spark):
    """Parsed tables that nobody persists are joined by a plan as long as its parts."""
    plan = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    records = parse_addresses(X.read_addresses(X.raw_addresses(spark, SF)), "address")
    places = parse_addresses(X.load_locations(X.raw_locations(spark, SF)), "address")
    top = M.find_candidates(records, places)
    assert plan(top) < 20 * (plan(records) + plan(places))


def test_jdbc_source(spark):
    url = "jdbc:derby:memory:places;create=true"
    rows = spark.createDataFrame([("a", "1 N OAK ST", "RENO", "NV", "89501")], "location_id string, street string, city string, state string, zip_code string")
    types = ", ".join(f"{c} VARCHAR(99)" for c in rows.columns)
    rows.write.option("createTableColumnTypes", types).jdbc(url, "places", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    got = load_locations(read_table(spark, "", "jdbc", url=url, dbtable="places", driver="org.apache.derby.jdbc.EmbeddedDriver")).collect()
    assert [r["address"] for r in got] == ["1 N OAK ST, RENO, NV 89501"]


def test_documents_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"a": 1}')], "record_id long, document string")
    write_documents(df, f"{tmp_path}/out")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()] == ['{"a": 1}']


def test_control_bytes_and_escapes(spark):
    from addrweave.operators.report import clean, number

    row = spark.createDataFrame([('a"b\\c\td\x01e', 0.9285, 0.125)], "t string, c double, w double").select(F.to_json(F.struct(clean(F.col("t")).alias("t"), number(F.col("c"), "0.000").alias("c"), number(F.col("w"), "0.00").alias("w")))).first()
    assert row[0] == '{"t":"a\\"b\\\\c\\tde","c":0.928,"w":0.12}'


def test_decisions(spark):
    rows = [(1, "location_id=a confidence=0.82"), (2, "location_id=a confidence=0.1"), (3, "location_id=a"), (4, "x location_id=a location_id=b confidence=0.9z\nlocation_id=c"), (5, None), (6, "confidence=0.9")]
    got = parse_rerank_decisions(spark.createDataFrame(rows, "record_id long, response string")).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 0.82), (4, "b", 0.9)]
