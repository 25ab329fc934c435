"""Joins whose heavy keys are split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of one key beyond which the key is split.
PAIRS = 2_000_000


def heavy_keys(left: DataFrame, right: DataFrame, keys: list[str], pairs: int | None = None) -> DataFrame:
    """Keys with more pairs than ``pairs``, with the number of pieces of each side.

    The larger side is cut to as many pieces as it has rows at most, and the
    other side then takes the rest.
    """
    pairs = pairs or PAIRS
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = count(left, "_rows_l").join(count(right, "_rows_r"), keys).where(F.col("_rows_l").cast("double") * F.col("_rows_r") > pairs)
    pieces = F.ceil(F.col("_rows_l").cast("double") * F.col("_rows_r") / pairs)
    big = F.least(pieces, F.greatest("_rows_l", "_rows_r"))
    small = F.ceil(pieces / big)
    sides = {"cuts_l": F.when(F.col("_rows_l") >= F.col("_rows_r"), big).otherwise(small), "cuts_r": F.when(F.col("_rows_l") >= F.col("_rows_r"), small).otherwise(big)}
    return both.select(*keys, *[c.cast("int").alias(name) for name, c in sides.items()])


def broadcastable(*sides: DataFrame) -> bool:
    """Whether one side's size is known to be below the session's limit for broadcasts."""
    spark = sides[0].sparkSession
    limit = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    return any(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit for df in sides)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, pairs: int | None = None) -> DataFrame:
    """Inner equi-join in which the rows of a heavy key are dealt by their ids to pieces.

    Each row of one side meets every piece of the other once, so the result is
    that of a plain join.  Where a side is small enough to be broadcast, no key
    is anybody's and the join is a plain one.
    """
    if broadcastable(left, right):
        return left.join(right, keys)
    heavy = heavy_keys(left, right, keys, pairs)

    def dealt(df: DataFrame, own: str, other: str, ident: str, mine: str, theirs: str) -> DataFrame:
        rows = df.join(heavy, keys, "left")
        piece = F.pmod(F.xxhash64(ident), F.coalesce(own, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return rows.select(*df.columns, piece.alias(mine), every.alias(theirs))

    a = dealt(left, "cuts_l", "cuts_r", left_id, "piece_l", "piece_r")
    b = dealt(right, "cuts_r", "cuts_l", right_id, "piece_r", "piece_l")
    return a.join(b, [*keys, "piece_l", "piece_r"]).drop("piece_l", "piece_r")
