"""SimHash groups, Merkle manifests and hard negatives against plain versions, and their SQL twins."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from addrweave.llm import merkle, negatives, queries
from addrweave.llm.merkle import manifest
from addrweave.llm.negatives import hard_negatives
from addrweave.llm.simhash import close_pairs, simhash_groups

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ASCII = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twin(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, SF).toPandas(), db.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(mine.columns)
    plain = lambda df: df[columns].convert_dtypes().astype(str).sort_values(columns).reset_index(drop=True)
    assert columns == sorted(theirs.columns) and plain(mine).equals(plain(theirs))


def fingerprint(text):
    words = WORD.findall((text or "").translate(ASCII))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def groups(rows):
    """(doc_id, fingerprint, component_id) of (doc_id, text), by all pairs."""
    prints = [fingerprint(t) for _, t in rows]
    known = sorted({p for (i, _), p in zip(rows, prints, strict=True) if i is not None})
    label = {p: p for p in known}

    def top(p):
        while label[p] != p:
            p = label[p]
        return p

    for a in known:
        for b in known:
            if a < b and (a ^ b).bit_count() <= 2:
                label[top(a)] = top(b)
    low: dict = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            low[top(p)] = min(low.get(top(p), i), i)
    return [(i, f"{p:016x}", None if i is None else low[top(p)]) for (i, _), p in zip(rows, prints, strict=True)]


def test_simhash_by_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.QUERIES["op12_simhash"](spark, SF).collect()]
    assert collections.Counter(got) == collections.Counter(groups(docs))


def test_simhash_of_odd_rows(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(1, None), (2, ""), (3, "\t \n"), (4, "word " * 30_000), (4, "word " * 30_000), (9, "word " * 29_999), (5, " ".join(words)), (6, "  ".join(words).upper()), (7, "é ÉÉ"), (8, "é ÉÉ x"), (None, " ".join(words)), (5, "another text of this id"), (10, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"1 as {c}" for c in "fp first label component variant a b low node".split()])
    assert sorted(map(tuple, simhash_groups(df).collect()), key=str) == sorted(groups(rows), key=str)
    assert simhash_groups(df.limit(0)).collect() == []


def test_close_pairs_join_all_that_are_close(spark):
    draw = np.random.default_rng(4)
    some = [int(x) for x in draw.integers(-(2**63), 2**63 - 1, 12)]
    for x in list(some):
        for _ in range(15):
            y = x
            for b in draw.integers(0, 64, int(draw.integers(1, 4))).tolist():
                y ^= -(1 << 63) if b == 63 else 1 << b
            some.append(y)
    some = sorted(set(some))
    nodes = spark.createDataFrame([(x,) for x in some], "fp long")
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    for radius in (0, 2, 4):
        pairs = [tuple(r) for r in close_pairs(nodes, radius).collect()]
        assert all(apart(a, b) <= radius and a < b for a, b in pairs)

        def classes(links):
            label = {x: x for x in some}

            def top(p):
                while label[p] != p:
                    p = label[p]
                return p

            for a, b in links:
                label[max(top(a), top(b))] = min(top(a), top(b))
            return [top(x) for x in some]

        assert classes(pairs) == classes([(a, b) for a in some for b in some if a < b and apart(a, b) <= radius])
    with pytest.raises(ValueError, match="even"):
        close_pairs(nodes, 3)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    by_lang = collections.defaultdict(list)
    for doc_id, source, lang, n, text in rows:
        leaf = H(*map(framed, (doc_id, source, lang, n, text)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
        by_lang[lang].append((doc_id is not None, doc_id or 0, leaf, H(*map(framed, (doc_id, source, lang, n + 1, text))) if hit else leaf))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([v[2] for v in sorted(by_lang[x])]) for x in langs}
    crown = levels([trees[x][-1][0] for x in langs])
    out = []
    for g, x in enumerate(langs):
        for k, (some, doc_id, leaf, other) in enumerate(sorted(by_lang[x])):
            siblings, fold, at = [], other, k
            for tree, start in ((trees[x], k), (crown, g)):
                at = start
                for level in tree[:-1]:
                    there = level[at ^ 1 : (at ^ 1) + 1]
                    siblings += there
                    fold = H(*there, fold) if at % 2 else H(fold, *there)
                    at //= 2
            out.append((doc_id if some else None, leaf, trees[x][-1][0], crown[-1][0], H(*siblings), fold, fold == crown[-1][0]))
    return out


@pytest.mark.parametrize("bits", [(1, 2), (2, 1), (4, 3)])
def test_manifest_of_odd_rows(spark, monkeypatch, bits):
    """Small blocks give several tiers; groups of 1 to 40 rows, nulls, ties, repeated rows, no rows."""
    monkeypatch.setattr(merkle, "BITS", bits[0])
    monkeypatch.setattr(merkle, "DIGITS", bits[1])
    monkeypatch.setattr(merkle, "SPAN", bits[0] * bits[1])
    rows = [(k, "s", f"l{k % 3}", k, f"text {k}") for k in range(70)] + [(k, None, "é", None, "") for k in (100, 101)]
    rows += [(7, "s", "l1", 7, "text 7"), (7, "s", "l1", 7, "text 7"), (7, "t", "l1", 7, "other"), (None, "s", "l1", 7, None), (None, None, None, None, None), (102, "s", "", 1 << 40, "long " * 50_000), (-5, "s", "only", 3, "x")]
    rows += [(200, "", "big", 2**63 - 1, "x"), (203, "", "big", 2**63 - 1, "x"), (204, "", "big", 2**63 - 1, "x"), (205, "", "big", 2**63 - 1, "x")] if bits == (4, 3) else []
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"1 as {c}" for c in "g hash at part rank height node block path root".split()])
    got = [tuple(r) for r in manifest(df.repartition(5)).collect()]
    assert collections.Counter(got) == collections.Counter(plain_manifest(rows))
    if bits == (4, 3):
        assert manifest(df.limit(0)).collect() == []
        one = plain_manifest(rows[:1])
        assert [tuple(r) for r in manifest(df.limit(1).where("doc_id = 0")).collect()] == one and one[0][4] == H()


def mined(rows, positives=5, negatives=10):
    """All results by sorting every anchor's candidates; rows are (id, label, vector of whole numbers)."""
    out = []
    for a, label, x in rows:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, m == label) for i, m, y in rows if i != a and len(y) == len(x))
        for p, i, _ in [s for s in scored if s[2]][:positives]:
            fits = [s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(a, i, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fits)]
    return out


@pytest.mark.parametrize("group", [1 << 13, 60, 7])
def test_negatives_by_brute_force(spark, monkeypatch, group):
    """Small groups let a block hold fewer positives than wanted; many ties and zeros."""
    monkeypatch.setattr(negatives, "GROUP", group)
    monkeypatch.setattr(negatives, "ANCHORS", max(2, group // 20))
    draw = np.random.default_rng(group)
    rows = [(k, int(draw.integers(0, 3)), (draw.integers(-2, 4, 3) * 256).tolist()) for k in range(0, 1500, 5)]
    rows += [(-100, 1, [0, 0, 0]), (-200, 2, [-256, -512, 0]), (2000, 1, [512, 256]), (2001, 1, [256, 256]), (2002, 2, [256, 0]), (2100, 5, [256, 256, 512])]
    df = spark.createDataFrame([(i, label, [x / 256 for x in v]) for i, label, v in rows], "vec_id long, label int, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [tuple(r) for r in hard_negatives(df.repartition(3), F.col("id") % 100 == 0).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = mined(rows)
    assert sorted(got) == sorted(want) and len(want) > 100 and any(r[4] == 0 for r in want)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.25]), (3, 2, [0.25, 0.5]), (4, None, [0.5, 0.25]), (5, 2, None), (6, 2, [0.5, None]), (7, 2, [0.5, nan]), (8, 2, [0.5, inf]), (None, 2, [0.5, 0.25]), (9, 2, []), (2, 3, [9.0, 9.0]), (100, 1, []), (300, 4, [1e18, -1e18]), (301, 4, [1e18, 1e18])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", *[f"1 as {c}" for c in "key same grp part id vec score".split()])
    got = sorted(map(tuple, hard_negatives(df, F.col("id") % 100 == 0).where("anchor_id < 300").collect()))
    assert got == [(0, 1, 1, 2, 81920, 40960), (0, 1, 2, 3, 81920, 32768)]  # of the two rows with id 2 the one with the lesser label counts
    assert hard_negatives(df.limit(0), F.col("id") % 100 == 0).collect() == []
