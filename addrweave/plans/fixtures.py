"""Addresses and locations derived from the driver's tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import parse_addresses
from ..sources.tables import load_locations, read_addresses
from ..storage import spread

#: Fixed values of the test inputs.
DIRECTIONS = "N S E W NE NW SE SW".split()
STREETS = "OAK MAPLE 1ST 5TH 22ND 51ST OCEAN BISCAYNE FLAGLER CORAL BRICKELL COLLINS WASHINGTON LINCOLN PALM SUNSET BIRD KENDALL MILLER GRANADA ALHAMBRA PONCE 7".split()
ENDINGS = "VIEW PARK HILL LAKE CREEK RIDGE POINT GROVE SPRING FOREST HARBOR GARDEN VALLEY".split()
SUFFIXES = "ST AVE BLVD DR LN CT RD PL WAY TER".split()
CITIES = ["MIAMI", "HIALEAH", "MIAMI BEACH", "CORAL GABLES", "DORAL", "TAMPA", "ORLANDO", "NAPLES", "ATLANTA", "MACON", "SAVANNAH", "AUSTIN", "DALLAS", "HOUSTON", "EL PASO", "ALBANY", "BUFFALO", "YONKERS", "RENO", "OMAHA", "LINCOLN", "HARTFORD", "BOSTON", "SALEM", "PORTLAND"]
STATES = ["FL"] * 8 + ["GA"] * 3 + ["TX"] * 4 + ["NY"] * 3 + ["NV"] + ["NE"] * 2 + ["CT", "MA"] + ["OR"] * 2


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def raw_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    ending = F.when(k % 3 == 0, F.concat(F.lit(" "), _pick(ENDINGS, k % 13))).otherwise("")
    street = F.concat((100 + 37 * k % 900).cast("string"), F.lit(" "), _pick(DIRECTIONS, k % 8), F.lit(" "), _pick(STREETS, 7 * k % 23), ending, F.lit(" "), _pick(SUFFIXES, 3 * k % 10))
    customers = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey"), "c_custkey")  # one file each
    return customers.select(
        F.concat(F.lit("loc-"), F.lpad(k.cast("string"), 7, "0")).alias("location_id"),
        street.alias("street"),
        _pick(CITIES, nation).alias("city"),
        _pick(STATES, nation).alias("state"),
        F.when(k % 11 != 0, (10000 + 1000 * nation + k % 97).cast("string")).alias("zip_code"),
        k.alias("k"),
    )


def raw_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    z = F.coalesce("zip_code", F.lit(""))
    s, c, t = F.col("street"), F.col("city"), F.col("state")
    typed = lambda street, city=c, zip_=z: F.concat(street, F.lit(", "), city, F.lit(", "), t, F.lit(" "), zip_)
    n = F.length(s)
    typo = F.concat(F.substring(s, F.lit(1), n - 5), F.substring(s, n - 3, F.lit(4)))
    odd = F.when(o % 30 == 9, " , ,").when(o % 30 == 19, "UNKNOWN ADDRESS").otherwise("   ")
    raw = (
        F.when(o % 10 == 0, typed(s))
        .when(o % 10 == 1, F.lower(F.concat_ws(" ", s, c, t, z)))
        .when(o % 10 == 2, typed(typo))
        .when(o % 10 == 3, F.concat(s, F.lit(", "), c, F.lit(", "), t))
        .when(o % 10 == 4, typed(F.concat(F.lit("9"), s)))
        .when(o % 10 == 5, typed(s, c, F.concat(F.coalesce("zip_code", F.lit("00000")), F.lit("-1234"))))
        .when(o % 10 == 6, F.concat(F.lit("Customer "), c, F.lit("\t"), typed(s), F.lit("\n")))
        .when(o % 10 == 7, typed(F.concat(s, F.lit(" APT "), (o % 50).cast("string"), F.lit("B")), F.substring(c, 2, 100)))
        .when(o % 10 == 8, typed(F.concat(s, F.lit("."))))
        .otherwise(odd)
    )
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), "o_orderkey")  # one file each
    return orders.join(raw_locations(spark, sf_dir), F.col("o_custkey") == F.col("k")).select(o.alias("record_id"), raw.alias("raw_address"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_addresses(load_locations(raw_locations(spark, sf_dir)), "address")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_addresses(read_addresses(raw_addresses(spark, sf_dir)), "address")


def responses(best: DataFrame, top: DataFrame) -> DataFrame:
    """Votes of an outside scorer: for the second candidate, or the first one."""
    r = F.col("record_id")
    voted = top.where("rank <= 2").groupBy("record_id").agg(F.max_by("location_id", "rank").alias("voted"))
    place = F.when(r % 50 == 0, "loc-9999999").otherwise(F.col("voted"))
    tail = F.when(r % 4 == 0, " confidence=0.69").when(r % 4 == 1, " confidence=0.82").when(r % 4 == 2, " confidence=0.99").otherwise("")
    return voted.select("record_id", F.concat(F.lit("location_id="), place, tail).alias("response"))
