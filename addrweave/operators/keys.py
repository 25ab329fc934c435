"""A stored index of canonical keys: which addresses were seen before.

Rows of the index are bucketed by their key and sorted in the buckets, so a lookup
shuffles the asked addresses to the index's buckets and never the index.  An
insert reads and writes what is new: its rows become another part of the index, a
table of the same buckets, and a lookup folds the parts bucket by bucket.
``compact`` makes one part of many.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete_folder
from .parse import canonical_key_index


@dataclass(frozen=True)
class KeyIndex:
    """An index under a name in the session's catalog, with its files under ``path``.

    Parts are the tables ``name_<generation>_<number>``; those of the last generation
    count.  One writer at a time.
    """

    spark: SparkSession
    name: str
    path: str
    buckets: int = 64

    def _tables(self) -> list[tuple[int, int]]:
        found = [re.fullmatch(rf"{self.name}_(\d+)_(\d+)", t.name) for t in self.spark.catalog.listTables()]
        return sorted((int(m[1]), int(m[2])) for m in found if m)

    def parts(self) -> list[str]:
        known = self._tables()
        return [f"{self.name}_{g}_{k}" for g, k in known if g == known[-1][0]]

    def _write(self, rows: DataFrame, generation: int, number: int) -> None:
        rows = rows.repartition(self.buckets, "canonical_key")  # one file a bucket
        table = f"{self.name}_{generation}_{number}"
        rows.write.bucketBy(self.buckets, "canonical_key").sortBy("canonical_key").option("path", f"{self.path}/{table}").mode("overwrite").format("parquet").saveAsTable(table)

    def insert(self, parsed: DataFrame, id_col: str = "record_id") -> None:
        """Add parsed rows; rows without a key are left out.

        The same rows inserted twice count twice.  A part is seen when it is whole.
        """
        known = self._tables() or [(0, -1)]
        self._write(canonical_key_index(parsed, id_col), known[-1][0], known[-1][1] + 1)

    def read(self) -> DataFrame:
        """canonical_key, the smallest id that has it and how many rows do, over all parts."""
        parts = self.parts()
        if not parts:
            raise ValueError(f"nothing was inserted in {self.name}")
        rows = self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts])  # not as buckets, which a union of tables would not fold
        return rows.groupBy("canonical_key").agg(F.min("representative").alias("representative"), F.sum("members").alias("members"))

    def compact(self) -> None:
        """One part in place of all.  It is the next generation's first, so readers change over at once; the old parts go afterwards."""
        known = self._tables()
        if not known:
            return
        self._write(self.read(), known[-1][0] + 1, 0)
        for g, k in known:
            self.spark.sql(f"DROP TABLE {self.name}_{g}_{k}")
            delete_folder(self.spark, f"{self.path}/{self.name}_{g}_{k}")

    def seen(self, parsed: DataFrame, id_col: str = "record_id") -> DataFrame:
        """Of parsed rows the id, key, and for keys of the index the representative and members (else null and 0).

        Each part is looked up by itself, so none of it is shuffled; a row meets at
        most one row of a part, and the answers are folded in the row.
        """
        rows = parsed.select(id_col, F.col("components.canonical_key").alias("canonical_key")).where("canonical_key <> ''")
        rows = rows.repartition(self.buckets, "canonical_key")
        low, members = [F.lit(None)], [F.lit(0)]
        for k, p in enumerate(self.parts()):
            part = self.spark.table(p).select("canonical_key", F.col("representative").alias(f"low_{k}"), F.col("members").alias(f"members_{k}"))
            rows = rows.join(part, "canonical_key", "left")
            low.append(F.col(f"low_{k}"))
            members.append(F.coalesce(f"members_{k}", F.lit(0)))
        return rows.select(id_col, "canonical_key", F.least(*low, F.lit(None)).alias("representative"), reduce(add, members).cast("long").alias("members"))
