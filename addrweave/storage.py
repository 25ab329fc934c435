"""Tables that later jobs read, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_ROOT: ContextVar[str | None] = ContextVar("root", default=None)
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on one machine a new one if none is set."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession) -> str:
    return f"{_ROOT.get() or shared_dir(spark)}/{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables stored inside go to one folder, which is deleted at the end: write results before."""
    root = new_folder(spark)
    token = _ROOT.set(root)
    try:
        yield root
    finally:
        _ROOT.reset(token)
        delete_folder(spark, root)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table and read it back: a lost executor costs no earlier job, plans stay short, sizes are known.

    The job's shuffle files go when it ends.
    """
    spark = df.sparkSession
    path = path or new_folder(spark)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt to as many partitions as shuffles have, however few bytes they are: for work that costs more than its bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later job reads."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_folder(df.sparkSession, name)


def delete_folder(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
