"""Sources and sinks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_upper, canonicalize_zip, cap, clean_pasted_text

LOCATION_COLUMNS = ("location_id", "street", "city", "state", "zip_code")


def read_table(spark: SparkSession, source: str, fmt: str = "parquet", **options) -> DataFrame:
    """Any Spark source; for ``jdbc`` all options, credentials too, come from the caller."""
    reader = spark.read.format(fmt).options(**options)
    return reader.load() if fmt == "jdbc" else reader.load(source)


def read_location_table(spark: SparkSession, table: str, parts: int, **options) -> DataFrame:
    """The usable rows of a location table in a database, read by ``parts`` tasks.

    ``options`` are those of Spark's ``jdbc`` source (url, driver, user, ...).  The
    database is asked for its number of usable rows and for the ids at equal
    distances in its own order (``OFFSET`` and ``FETCH``); each task then reads the
    rows between two of them.  Rows with a null or empty part never leave it.
    """
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier
    name = quoted("location_id")
    usable = " AND ".join(f"{quoted(c)} IS NOT NULL AND {quoted(c)} <> ''" for c in LOCATION_COLUMNS[:4])
    source = {k: v for k, v in options.items() if k != "url"}
    first = lambda query: spark.read.jdbc(options["url"], query, properties=source).first()
    n = first(f"(SELECT COUNT(*) AS n FROM {table} WHERE {usable}) counted")[0]
    places = sorted({n * k // parts for k in range(1, parts)} - {0})
    cuts = [first(f"(SELECT {name} AS cut FROM {table} WHERE {usable} ORDER BY {name} OFFSET {k} ROWS FETCH NEXT 1 ROWS ONLY) cut_{k}")[0] for k in places]
    cuts = list(dict.fromkeys(cuts))
    text = lambda v: "'" + v.replace("'", "''") + "'"
    between = [[*[f"{name} >= {text(a)}" for a in cuts[max(k - 1, 0) : k]], *[f"{name} < {text(b)}" for b in cuts[k : k + 1]]] for k in range(len(cuts) + 1)]
    return spark.read.jdbc(options["url"], table, predicates=[" AND ".join([usable, *b]) for b in between], properties=source).select(*LOCATION_COLUMNS)


def load_locations(df: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Usable locations, upper-cased, with the text that is parsed.

    Rows with a null or empty id, street, city or state are left out.  ``counts``
    gets how many rows were ``loaded`` and ``dropped`` by the first job that reads
    the result.
    """
    rows = df.select(*LOCATION_COLUMNS)
    if counts is not None:
        usable = reduce(and_, [F.coalesce(F.col(c) != "", F.lit(False)) for c in LOCATION_COLUMNS[:4]])
        rows = rows.observe(counts, F.count_if(usable).alias("loaded"), F.count_if(~usable).alias("dropped"))
    for c in LOCATION_COLUMNS[:4]:
        rows = rows.where(F.col(c).isNotNull() & (F.col(c) != ""))
    caps = {"street": 127, "city": 127, "state": 15}
    rows = rows.withColumns({c: ascii_upper(cap(F.col(c), n)) for c, n in caps.items()} | {"location_id": cap(F.col("location_id"), 63)})
    rows = rows.withColumn("postal_code", canonicalize_zip(ascii_upper(F.col("zip_code"))))
    text = F.concat("street", F.lit(", "), "city", F.lit(", "), "state", F.lit(" "), "postal_code")
    return rows.select("location_id", "street", "city", "state", "postal_code", text.alias("address"))


def read_addresses(df: DataFrame, id_col: str = "record_id", text_col: str = "raw_address") -> DataFrame:
    """record_id, raw_address and the cleaned address."""
    return df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("raw_address"), clean_pasted_text(F.col(text_col)).alias("address"))


def read_rerank_decisions(spark: SparkSession, path: str) -> DataFrame:
    """record_id and response from files of lines ``record_id<TAB>response``."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(F.expr("try_cast(split(value, '\t', 2)[0] as bigint)").alias("record_id"), F.get(parts, F.lit(1)).alias("response"))


def write_documents(documents: DataFrame, path: str, column: str = "document") -> None:
    """One JSON document a line."""
    documents.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
