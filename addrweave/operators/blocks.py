"""The first groups of each shape among those with an equal key, scored in blocks of Arrow rows.

Shapes and groups of one key (a number, a ZIP) are a block; blocks are dealt to
buckets, and a bucket's shapes and groups meet in one task.  There each pair of
different streets and cities is measured once, and the pairs of a block are scored
as arrays, with the arithmetic of ``scores`` in the same order, so that equal
scores stay equal.  Only the first groups of each shape leave the task.  A key with
more than ``ROWS`` shapes or groups is cut to pieces that meet each other once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.edits import similarities
from ..functions.vocab import WEIGHTS
from ..storage import stored

#: Shapes or groups of one key that stay together.
ROWS = 1 << 14
#: Shapes and groups of a bucket, about.
BUCKET = 1 << 17
#: Pairs that are scored at a time.
PAIRS = 1 << 18
#: Pairs of distinct values that are measured for a whole bucket at once.
VALUES = 1 << 22

STRATEGIES = ("canonical", "structured", "fuzzy")
RESULT = "lid string, gid string, own string, rid string, confidence double, strategy string, n double, c double"
_EMPTY = pa.schema([(name, pa.string() if kind == "string" else pa.float64()) for name, kind in (x.split() for x in RESULT.split(", "))]).empty_table()
_WEIGHT = dict(WEIGHTS)


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the texts are, and -1 for empty texts of the first."""
    both = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks()
    coded = (both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int32)
    empty = coded.dictionary.index("").as_py()
    left = code[: len(a)].copy()
    if empty >= 0:
        left[left == empty] = -1
    return left, code[len(a) :]


def _values(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    whole = column.combine_chunks()
    coded = (whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


class _Likeness:
    """Similarities of the values of two columns, for the rows of a block."""

    def __init__(self, left: pa.ChunkedArray, right: pa.ChunkedArray, blocks: list[tuple[np.ndarray, np.ndarray]]):
        (self.a, self.x), (self.b, self.y) = _values(left), _values(right)
        apart = sum(len(np.unique(self.a[l])) * len(np.unique(self.b[r])) for l, r in blocks)
        self.whole = similarities(self.x, self.y) if len(self.x) * len(self.y) <= min(VALUES, 2 * apart) else None

    def __call__(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        mine, of = np.unique(self.a[rows], return_inverse=True)
        if self.whole is not None:
            return self.whole[mine[:, None], self.b[columns][None, :]][of]
        theirs, at = np.unique(self.b[columns], return_inverse=True)
        return similarities(self.x.take(pa.array(mine)), self.y.take(pa.array(theirs)))[:, at][of]


def _first(value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest values of each row that aren't negative; of equal ones the earlier columns."""
    if value.shape[1] > k:
        least = np.partition(value, value.shape[1] - k, axis=1)[:, value.shape[1] - k]
        row, column = np.nonzero(value >= np.maximum(least, 0.0)[:, None])
    else:
        row, column = np.nonzero(value >= 0)
    order = np.lexsort((column, -value[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _alike_zips(left: pa.ChunkedArray, right: pa.ChunkedArray):
    """Of rows and columns of a block, whether different ZIPs are more than 0.8 alike; None where none is long enough."""
    (a, x), (b, y) = _values(left), _values(right)
    size_x, size_y = (pc.binary_length(v.cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64) for v in (x, y))

    def alike(rows: np.ndarray, columns: np.ndarray) -> np.ndarray | None:
        mine, of = np.unique(a[rows], return_inverse=True)
        theirs, at = np.unique(b[columns], return_inverse=True)
        low, high = np.minimum(size_x[mine][:, None], size_y[theirs]), np.maximum(size_x[mine][:, None], size_y[theirs])
        near = (high > 5) & (low > 0.8 * high - 1e-9)
        i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(i):
            return None
        found = np.zeros(near.shape, bool)
        found[np.ix_(i, j)] = similarities(x.take(pa.array(mine[i])), y.take(pa.array(theirs[j]))) > 0.8
        return (found & near)[:, at][of]

    return alike


def score_blocks(left: pa.Table, right: pa.Table, number: bool, config: MatchConfig) -> pa.Table:
    """The first groups of each shape of a bucket; ``number`` says whether blocks have equal numbers, or else such pairs are left out."""
    if not left.num_rows or not right.num_rows:
        return _EMPTY
    right = right.sort_by([("rid", "ascending"), ("gid", "ascending")])
    names = {"block": "block", "number": "number", "directional": "direction", "suffix": "suffix", "state": "state", "postal_code": "zip", "key": "key"}
    code = {k: _codes(left.column("block" if v == "block" else f"l_{v}"), right.column("block" if v == "block" else f"r_{v}")) for k, v in names.items()}
    a, b = code["block"]
    street = _values(left.column("l_street"))[0]
    by_a, by_b = np.lexsort((street, a)), np.argsort(b, kind="stable")
    known, at = np.unique(a[by_a], return_index=True)
    at = np.append(at, len(a))
    low, high = np.searchsorted(b[by_b], known, "left"), np.searchsorted(b[by_b], known, "right")
    blocks = [(by_a[at[k] : at[k + 1]], by_b[low[k] : high[k]]) for k in np.flatnonzero(low < high)]
    streets, cities = (_Likeness(left.column(f"l_{c}"), right.column(f"r_{c}"), blocks) for c in ("street", "city"))
    zips = _alike_zips(left.column("l_zip"), right.column("r_zip"))
    owned = right.column("own").is_valid().to_numpy()
    same = lambda k, rows, columns: code[k][0][rows][:, None] == code[k][1][columns][None, :]
    found: list[tuple] = []
    for every, columns in blocks:
        step = max(1, PAIRS // len(columns))
        for rows in (every[k : k + step] for k in range(0, len(every), step)):
            n, c = streets(rows, columns), cities(rows, columns)
            score = _WEIGHT["street_number"] * (1.0 if number else 0.0) + _WEIGHT["street_name"] * n
            equal = same("postal_code", rows, columns)
            for part in ("directional", "suffix"):
                score += _WEIGHT[part] * same(part, rows, columns)
            score += _WEIGHT["city"] * c
            score += _WEIGHT["state"] * same("state", rows, columns)
            score += _WEIGHT["postal_code"] * equal
            fuzzy = 0.6 * score
            fuzzy += 0.25 * n
            fuzzy += 0.15 * c
            alike = zips(rows, columns)
            fuzzy += 0.05 * (equal if alike is None else equal | (alike & (code["postal_code"][0][rows] >= 0)[:, None]))
            np.minimum(fuzzy, 1.0, out=fuzzy)
            held = np.minimum(score, 1.0) if config.clamp_confidence else score
            structured = np.where(score >= config.structured_min, held, -1.0)
            fuzzy = np.where(fuzzy >= config.fuzzy_min, fuzzy, -1.0)
            best = np.maximum(structured, fuzzy)
            i, j = np.nonzero(same("key", rows, columns))
            canonical = np.where(score[i, j] >= 0.9, 1.0, score[i, j])
            keyed = canonical >= best[i, j]
            best[i, j] = np.maximum(best[i, j], canonical)
            if not number:
                best[same("number", rows, columns)] = -1.0
            free = ~owned[columns]
            if free.all():
                row, column = _first(best, config.max_candidates)
            else:
                mine, theirs = np.flatnonzero(free), np.flatnonzero(~free)
                row, column = _first(best[:, mine], config.max_candidates) if len(mine) else (np.zeros(0, np.int64),) * 2
                column = mine[column] if len(mine) else column
                more, of = np.nonzero(best[:, theirs] >= 0)
                row, column = np.append(row, more), np.append(column, theirs[of])
            strategy = np.where(structured[row, column] == best[row, column], 1, 2)
            by_key = np.zeros(best.shape, bool) if len(i) else None
            if by_key is not None:
                by_key[i[keyed], j[keyed]] = True
                strategy[by_key[row, column]] = 0
            found.append((rows[row], columns[column], best[row, column], strategy, n[row, column], c[row, column]))
    if not found:
        return _EMPTY
    row, column, confidence, strategy, n, c = map(np.concatenate, zip(*found, strict=True))
    theirs = right.select(["gid", "own", "rid"]).take(pa.array(column))
    names_of = pa.DictionaryArray.from_arrays(pa.array(strategy.astype(np.int32)), pa.array(STRATEGIES)).cast(pa.string())
    return pa.table([left.column("lid").take(pa.array(row)), *theirs.columns, pa.array(confidence), names_of, pa.array(n), pa.array(c)], _EMPTY.schema)


def first_of_blocks(a: DataFrame, b: DataFrame, number: bool, config: MatchConfig) -> DataFrame:
    """The first groups (``b``) of each shape (``a``) among those with an equal ``on``, stored.

    Of a shape whose key is cut there are as many for each piece of the groups.
    Groups of a location with several addresses (``own``) are all returned.
    """
    spark = a.sparkSession
    over = [df.groupBy("on").count().where(F.col("count") > ROWS).select("on", F.ceil(F.col("count") / ROWS).cast("int").alias(name)) for df, name in ((a, "cuts_l"), (b, "cuts_r"))]
    cuts = stored(over[0].join(over[1], "on", "full"))
    some = not cuts.isEmpty()
    one = F.lit(1)
    own, every = lambda c: F.coalesce(c, one), lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, one) - 1))

    def dealt(df: DataFrame, ident: str, mine: str, theirs: str, names: tuple[str, str]) -> DataFrame:
        if not some:
            return df.withColumn("block", F.col("on"))
        rows = df.join(cuts, "on", "left")
        rows = rows.select(*df.columns, F.pmod(F.xxhash64(ident), own(F.col(mine))).cast("int").alias(names[0]), every(F.col(theirs)).alias(names[1]))
        return rows.withColumn("block", F.concat_ws("/", F.col("piece_l").cast("string"), F.col("piece_r").cast("string"), "on")).drop("piece_l", "piece_r")

    a = dealt(a, "lid", "cuts_l", "cuts_r", ("piece_l", "piece_r")).drop("on")
    b = dealt(b, "gid", "cuts_r", "cuts_l", ("piece_r", "piece_l")).drop("on")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, (a.count() + b.count()) // BUCKET + 1)
    bucket = F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int")
    sides = [df.withColumn("bucket", bucket).repartition(max(tasks, buckets // 4), "bucket").groupBy("bucket") for df in (a, b)]
    return stored(sides[0].cogroup(sides[1]).applyInArrow(lambda left, right: score_blocks(left, right, number, config), RESULT))
