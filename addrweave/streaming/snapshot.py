"""Versions of the location index that streams read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.candidates import LocationIndex, index_locations, read_index


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions under ``root`` that are whole: their last table has been committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    found = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()]
    done = lambda n: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v{n}/{LocationIndex.TABLES[-1]}/_SUCCESS"))
    return sorted(n for n in found if done(n))


def publish(locations: DataFrame, root: str) -> int:
    """Store parsed locations as the next version under ``root``; streams take it up with their next batch."""
    known = versions(locations.sparkSession, root)
    number = known[-1] + 1 if known else 0
    index_locations(locations, f"{root}/v{number}")
    return number


def latest(spark: SparkSession, root: str) -> tuple[int, LocationIndex]:
    known = versions(spark, root)
    if not known:
        raise ValueError(f"no version of the locations under {root}")
    return known[-1], read_index(spark, f"{root}/v{known[-1]}")
