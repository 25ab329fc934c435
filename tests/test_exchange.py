"""Stored keys, versions of locations, partitioned reads, failing scorers, counts on the way."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from addrweave.operators.keys import KeyIndex
from addrweave.operators.match import best_match, find_candidates, match_addresses, match_outcome
from addrweave.operators.parse import canonical_key_index, parse_addresses
from addrweave.operators.report import with_outcome_counts
from addrweave.operators.rerank import exchange, parse_rerank_decisions, score_payloads
from addrweave.sources.tables import load_locations, read_addresses, read_location_table
from addrweave.storage import scratch
from addrweave.streaming.snapshot import latest, publish, versions
from addrweave.streaming.stream import match_stream

PLACE = "location_id string, street string, city string, state string, zip_code string"


def places(spark, rows):
    return parse_addresses(load_locations(spark.createDataFrame(rows, PLACE)), "address")


def test_two_inserts_equal_one(spark, tmp_path):
    texts = [f"{k % 30} N OAK ST, RENO, NV 89501" for k in range(90)] + ["", "Main", None]
    parsed = parse_addresses(spark.createDataFrame(list(enumerate(texts)), "record_id long, raw_address string")).persist()
    one, two = KeyIndex(spark, "one", f"{tmp_path}/one", 4), KeyIndex(spark, "two", f"{tmp_path}/two", 4)
    one.insert(parsed)
    for part in ("record_id < 40", "record_id >= 40"):
        two.insert(parsed.where(part))
    asked = parse_addresses(spark.createDataFrame([(1, texts[3]), (2, "999 N OAK ST, RENO, NV 89501"), (3, "Main"), (4, texts[3])], "record_id long, raw_address string"))
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(one.read()) == plain(two.read()) == plain(canonical_key_index(parsed, "record_id"))
    assert len(two.parts()) == 2
    want = [(1, "3|N|OAK|ST|RENO|NV|89501", 3, 3), (2, "999|N|OAK|ST|RENO|NV|89501", None, 0), (4, "3|N|OAK|ST|RENO|NV|89501", 3, 3)]
    assert plain(one.seen(asked)) == plain(two.seen(asked)) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = two.seen(asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange ") == 1 and plan.count("SortMergeJoin") == 2
    two.compact()
    assert len(two.parts()) == 1 and plain(two.seen(asked)) == want
    two.insert(parsed.where("record_id = 3"))
    assert plain(two.seen(asked))[0][2:] == (3, 4)
    with pytest.raises(ValueError, match="nothing"):
        KeyIndex(spark, "none", f"{tmp_path}/none").read()


def test_versions_take_effect_between_batches(spark, tmp_path):
    root = f"{tmp_path}/places"
    text = "601 N OAK ST, RENO, NV 89501"
    assert versions(spark, root) == []
    publish(places(spark, [("a", "601 N OAK ST", "RENO", "NV", "89501")]), root)
    schema = "record_id long, raw_address string"

    def arrive(number):
        spark.createDataFrame([(number, text), (number + 1, ", ,")], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        arriving = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        match_stream(arriving, root, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()

    arrive(0)
    publish(places(spark, [("a", "601 N OAK ST", "RENO", "NV", "89501"), ("B", "601 N OAK ST", "RENO", "NV", "89501")]), root)
    assert latest(spark, root)[0] == 1
    arrive(10)
    got = sorted((r["record_id"], r["location_id"], r["version"], r["selected_strategy"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, "a", 0, "canonical"), (1, None, 0, "none"), (10, "B", 1, "canonical"), (11, None, 1, "none")]
    with scratch(spark) as folder:
        asked = parse_addresses(read_addresses(spark.read.schema(schema).json(f"{tmp_path}/in")), "address")
        best = best_match(asked, find_candidates(asked, latest(spark, root)[1])).select("record_id", "location_id").collect()
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        assert place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    assert {r[0]: r[1] for r in best} == {0: "B", 1: None, 10: "B", 11: None}
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def test_partitioned_jdbc_read(spark):
    options = {"url": "jdbc:derby:memory:parts;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = [(f"loc-{k:05}", f"{k} N OAK ST", "RENO", "NV", "" if k % 2 else "89501") for k in range(200)]
    rows += [("", "x", "y", "z", "1"), ("loc-2", "x", "", "z", "1"), ("it's", "x", "y", "z", "1"), ("Ünit", "x", "y", "z", "1"), ("loc-00007", "twice", "y", "z", "1")]
    df = spark.createDataFrame(rows, PLACE)
    df.write.option("createTableColumnTypes", ", ".join(f"{c} VARCHAR(99)" for c in df.columns)).jdbc(options["url"], "parts", properties={"driver": options["driver"]})
    db = spark._jvm.java.sql.DriverManager.getConnection(options["url"])
    db.createStatement().execute("INSERT INTO parts VALUES ('loc-3', NULL, 'y', 'z', '1'), (NULL, 'x', 'y', 'z', '1'), ('loc-00009', 'x', 'y', 'z', NULL)")
    db.close()
    df = df.unionByName(spark.createDataFrame([("loc-00009", "x", "y", "z", None)], PLACE))
    got = read_location_table(spark, "parts", 4, **options)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(str, load_locations(got).collect())) == sorted(map(str, load_locations(df).collect()))
    assert len(got.collect()) == 204  # the others never left the database
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 52
    assert read_location_table(spark, "(SELECT * FROM parts WHERE \"city\" = 'none') x", 4, **options).collect() == []


def test_a_failing_scorer_loses_its_votes_alone(spark, tmp_path):
    df = spark.createDataFrame([(k, f"payload {k}") for k in range(40)], "record_id long, payload string").repartition(3)
    log = f"{tmp_path}/asked"

    def moody(broken):
        def scorer(texts):
            with open(log, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            if any(t in broken for t in texts):
                raise RuntimeError("no answer")
            return [f"location_id=a confidence=0.{t.split()[1]:0>2}" for t in texts]

        return scorer

    rows = score_payloads(df, moody({"payload 7", "payload 9"}), tries=2).collect()
    assert len(rows) == 40 and {r["record_id"]: r["error"] for r in rows if r["response"] is None} == dict.fromkeys((7, 9), "RuntimeError: no answer")
    short = score_payloads(df, lambda texts: texts[1:]).collect()
    assert all(r["response"] is None and r["error"] == "0 responses to 1 payloads" for r in short)
    path = f"{tmp_path}/answers"
    first = exchange(df, moody({"payload 7"}), path).collect()
    assert len(first) == 40 and [r["record_id"] for r in first if r["error"]] == [7]
    open(log, "w").close()
    changed = df.withColumn("payload", F.when(F.col("record_id") == 3, "payload 33").otherwise(F.col("payload")))
    second = {r["record_id"]: r["response"] for r in exchange(changed, moody(set()), path).collect()}
    assert set(open(log).read().split("\n")) == {"payload 7", "payload 33", ""}
    assert second[7].endswith("0.07") and second[3].endswith("0.33") and len(second) == 40 and None not in second.values()


def test_words_are_split_at_spaces(spark):
    rows = [(1, "location_id=a\tconfidence=0.9"), (2, "  location_id=b   confidence=0.9 "), (3, "location_id=c confidence=0.9\t")]
    got = parse_rerank_decisions(spark.createDataFrame(rows, "record_id long, response string")).collect()
    assert sorted(map(tuple, got)) == [(2, "b", 0.9), (3, "c", 0.9)]


def test_counts_come_with_the_job(spark):
    rows = [("a", "601 N OAK ST", "RENO", "NV", "89501"), ("b", "", "RENO", "NV", "89501"), (None, "x", "y", "z", "1"), ("c", "7 S ELM ST", "RENO", "NV", None)]
    loaded, outcomes = Observation("loaded"), Observation("outcomes")
    kept = load_locations(spark.createDataFrame(rows, PLACE), loaded)
    assert kept.count() == 2 and loaded.get == {"loaded": 2, "dropped": 2}
    asked = parse_addresses(read_addresses(spark.createDataFrame([(1, "601 N OAK ST, RENO, NV 89501"), (2, " "), (3, ", ,"), (4, "nowhere")], "record_id long, raw_address string")), "address")
    found = parse_addresses(kept, "address")
    with scratch(spark):
        with_outcome_counts(match_addresses(asked, found), outcomes).write.format("noop").mode("overwrite").save()
        plain = {r[0]: r[1] for r in match_outcome(asked, find_candidates(asked, found)).groupBy("outcome").count().collect()}
    assert outcomes.get == {"empty": 1, "matched": 1, "no_match": 2} == plain
