"""What the corpus operators share: input columns, splits, shared folders."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text

BITMAP_BITS = 28
_PART = 18
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators read, whatever else the table holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def remainder(id_col: str | Column, divisor: int) -> Column:
    """crc32 of an id as text, modulo: splits that need no state (null ids: 0)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string")) % divisor, F.lit(0))


def per_block(df: DataFrame, function, schema: str, column: str = "text", size: int = text.BLOCK_BYTES) -> DataFrame:
    """Apply ``function(block) -> RecordBatch`` to blocks of rows of bounded size."""

    def run(batches):
        for block in text.blocks(batches, column, size):
            yield function(block)

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is set: a new folder on one machine, an error on a cluster.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """Write a table that several later jobs read, and read it back.

    It is kept in the shared folder, so a lost executor costs no recomputation,
    and the plans of iterative jobs stay short.  The job's shuffle files go when
    it ends, so the disk holds those of one job at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of 64-bit keys by their low bits, 16 times as many as keys and 2**BITMAP_BITS at most.

    However many keys there are, it stays a filter that loses none of them.
    """
    size = min(BITMAP_BITS, max(_PART, (16 * keys.count()).bit_length()))
    bit = F.col(column).bitwiseAND((1 << size) - 1)

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _PART, bool)
        bits[table.column("bit").to_numpy() & ((1 << _PART) - 1)] = True
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    parts = keys.select(bit.alias("bit"), F.shiftright(bit, _PART).alias("part")).groupBy("part").applyInArrow(fill, "part long, bits binary")
    out = np.zeros((1 << (size - _PART), 1 << (_PART - 6)), np.uint64)
    for row in parts.toLocalIterator():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint64)
    return out.ravel()


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later job reads."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
