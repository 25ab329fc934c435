"""Corpus operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrweave.llm import bpe, decontaminate, queries
from addrweave.llm.decontaminate import find_leaks
from addrweave.llm.fmindex import substring_dedup
from addrweave.llm.language import language_id
from addrweave.llm.license_texts import TEXTS
from addrweave.llm.licenses import PHRASES, license_scan
from addrweave.llm.mixing import score_text
from addrweave.llm.neardup import near_duplicates
from addrweave.llm.pfp import byte_dedup
from addrweave.llm.rptrees import nearest
from addrweave.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ASCII = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


ODD = [
    (1, None, "x"),
    (2, "", "x"),
    (3, "one two three", "x"),
    (4, "word " * 30_000, "x"),
    (4, "word " * 30_000, "x"),
    (5, " ".join(f"w{k}" for k in range(40)), None),
    (6, " ".join(f"w{k}" for k in range(40)), "x"),
    (7, "\n\t ", "x"),
    (None, " ".join(f"w{k}" for k in range(40)), "x"),
    (8, "zażółć <|endoftext|> 中文 'll 's \u0085", "x"),
]
ODD_SCHEMA = "doc_id long, text string, lang string"
OPERATORS = {
    "leaks": lambda s, d: find_leaks(d, s.createDataFrame([(1, " ".join(f"w{k}" for k in range(5, 35))), (2, None), (None, "x")], "item_id long, text string")),
    "bpe": lambda s, d: bpe.round_trip(d, queries.tokenizer_path()),
    "toxicity": lambda s, d: toxicity(d, s.createDataFrame([(3, 1), (5, 0), (5, None), (None, 1)], "doc_id long, toxic int")),
    "substrings": lambda s, d: substring_dedup(d),
    "model": lambda s, d: score_text(d),
    "bytes": lambda s, d: byte_dedup(d),
    "near": lambda s, d: near_duplicates(d),
    "licenses": lambda s, d: license_scan(d),
    "language": lambda s, d: language_id(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    columns = "key m fp starts words score n label bucket bands content".split()
    df = spark.createDataFrame(ODD, ODD_SCHEMA).selectExpr("*", *[f"1 as {c}" for c in columns])
    out = OPERATORS[name](spark, df).collect()
    if name == "leaks":
        assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in out) == [(5, 1, 0), (6, 1, 0)]
        return
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(x[0] for x in ODD)
    of = {r["doc_id"]: r for r in out}
    if name == "substrings":
        assert of[6]["n_removed"] == 40 and of[None]["n_removed"] == 40 and of[4]["n_removed"] == 0 and of[1]["n_words"] == 0
    if name == "near":
        assert of[6]["component_id"] == 5 and not of[6]["kept"] and of[1]["kept"] and of[None]["component_id"] is None
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = {x[0]: len((x[1] or "").encode()) for x in ODD}
    if name == "bpe":
        assert [of[k]["n_tokens"] for k in (1, 2)] == [0, 0] and all(of[x[0]]["decoded_sha256"] == sha(x[1]) for x in ODD)
    if name == "toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    if name == "model":
        assert {k: of[k]["n_tokens"] for k in of} == {x[0]: len(WORD.findall(x[1] or "")) + 1 for x in ODD}
    if name == "bytes":
        assert {k: of[k]["n_bytes"] for k in of} == size
        assert {k: r["n_removed"] for k, r in of.items() if r["n_removed"]} == {6: size[6], None: size[6]}
    if name == "licenses":
        assert [of[k]["n_words"] for k in (1, 2, 3, 4, 7)] == [0, 0, 3, 30_000, 0]
        assert all((r["n_base"], r["first_word"], r["labels"], r["score"]) == (0, None, "", 0) for r in out)
    if name == "language":
        assert of[1]["lang_pred"] == of[2]["lang_pred"] == of[7]["lang_pred"] == "und"


def test_clashing_columns_are_kept(spark):
    df = spark.createDataFrame(ODD, ODD_SCHEMA).selectExpr("*", *[f"1 as {c}" for c in ("starts", "copy", "found", "n_words", "n_removed", "kept", "m", "fp")])
    got = substring_dedup(df, keep=True)
    assert got.columns == [*"doc_id text lang starts copy found m fp".split(), "n_words", "n_removed", "kept"]
    assert sum(r["n_removed"] for r in got.collect()) == 80


def test_probabilities_of_a_stream():
    """What the bits of a text cost does not depend on what stands beside it, and both bits' shares add up to one."""
    import pyarrow as pa

    from addrweave.llm import mixing as X

    draw = np.random.default_rng(1)
    texts = [" ".join(draw.choice(["aa", "ab", "b", "cc", "é"], 40)) for _ in range(30)]
    mixer = X.Mixer([np.zeros(16 << b, np.float32) for b in X.ROW_BITS])
    stream = X.Stream(pa.array(texts))
    for j in range(X.CONTEXTS):
        for half, value in enumerate((stream.bytes >> 4, stream.bytes & 15)):
            np.add.at(mixer.counts[j], stream.rows(j, half) + value, 1)
    mixer.learn(stream)
    mixer.finish()
    assert (mixer.one > 0).all() and (mixer.one < 1).all()  # of a bit 1; a bit 0 has the rest
    whole = np.add.reduceat(mixer.score(stream), stream.begin)
    alone = [mixer.score(X.Stream(pa.array([t]))).sum() for t in texts]
    assert np.allclose(whole, alone, rtol=1e-5) and (-whole * math.log2(10) / 8 / np.diff(np.append(stream.begin, len(stream.bytes)))).mean() < 0.6
    item, of, s = stream.stretches()
    assert (np.diff(of) >= 0).all() and set(of) == set(range(30))


def test_scores_against_plain_counts(spark):
    """Context shares of stretches, by plain counting over the same stretches."""
    import pyarrow as pa

    from addrweave.llm import mixing as X

    draw = np.random.default_rng(5)
    lines = [" ".join(f"w{k}" for k in draw.integers(0, 300, 30)) for _ in range(12)]
    texts = [(k, " ".join(draw.choice(lines, 3))) for k in range(60)] + [(100 + k, lines[k]) for k in range(3)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in score_text(df).collect()}
    pairs = {}
    for k, t in texts:
        _, _, s = X.Stream(pa.array([t])).stretches()
        pairs[k] = list(zip(s[:-1].tolist(), s[1:].tolist(), strict=True))
    learned = {k for k in pairs if zlib.crc32(str(k).encode()) % 5 != 1}
    n = collections.Counter(p for k in learned for p in pairs[k])
    n_c = collections.Counter(c for k in learned for c, _ in pairs[k])
    shares: dict = {}
    for (c, _), times in n.items():
        if n_c[c] > 1:
            hit, every = shares.get(int(math.log2(n_c[c] - 1)), (0, 0))
            shares[int(math.log2(n_c[c] - 1))] = (hit + times * (times > 1), every + times)
    mixer = X.train(X.keyed(df).where(F.col("doc_id").isin(sorted(learned))))
    for k, t in texts:
        stream = X.Stream(pa.array([t]))
        item, _, s = stream.stretches()
        bits = np.add.reduceat(mixer.score(stream, np.array([k in learned])).astype(np.float64), stream.items[item])
        own, own_c = collections.Counter(pairs[k] if k in learned else []), collections.Counter(c for c, _ in (pairs[k] if k in learned else []))
        total = bits[0]
        for (c, x), b in zip(pairs[k], bits[1:], strict=True):
            others = n_c[c] - own_c[c]
            hit, every = shares.get(int(math.log2(others)), (0, 1)) if others else (0, 1)
            share = min(max(hit / every, 0.01), 0.99) if others else 0
            total += math.log10(share * (n[c, x] - own[c, x]) / max(others, 1) + (1 - share) * 10**b)
        assert got[k]["score"] == pytest.approx(total, rel=1e-4), k


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], ODD_SCHEMA)).collect() == []


def test_leaks(spark, docs):
    plain = lambda t: " " + " ".join(re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())) + " "
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    exact = {(i, j) for i, t in docs.items() for j, x in items.items() if x in plain(t)}
    got = rows(spark, "op1_decontaminate")
    assert exact <= set(zip(got.doc_id, got.item_id, strict=True))
    assert (got.edits <= 0.2 * got.n_words).all()


def test_edited_leak(spark):
    rng = np.random.default_rng(1)
    words = [f"v{k}" for k in rng.integers(0, 400, 4000)]
    item = words[1000:1040]
    edited = item[:9] + ["new"] + item[9:20] + item[21:30] + ["other"] + item[31:]
    docs = [(k, " ".join([*words[k * 40 : k * 40 + 60], *edited, *words[k * 41 : k * 41 + 50]])) for k in range(3)] + [(9, " ".join(words[2000:2200]))]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["edits"]) for r in got) == [(0, 3), (1, 3), (2, 3)]


def edited(item, times, draw, vocabulary):
    words = list(item)
    for _ in range(times):
        kind, k = draw.integers(0, 3), int(draw.integers(0, len(words)))
        if kind == 0:
            words[k] = str(draw.choice(vocabulary))
        elif kind == 1 and len(words) > 1:
            del words[k]
        else:
            words.insert(k, str(draw.choice(vocabulary)))
    return words


def word_edits(item, words):
    """Least edit distance of the item to a stretch of the words, by the textbook table."""
    row = [0] * (len(words) + 1)
    for k, x in enumerate(item, 1):
        new = [k]
        for j, w in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_of_all_lengths(spark):
    """Every pair within a fifth of edits, by brute force; exact ones are never lost."""
    draw = np.random.default_rng(8)
    vocabulary = [f"v{k}" for k in range(2000)]
    some = lambda n: [str(w) for w in draw.choice(vocabulary, n)]
    lengths = [1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10, 12, 14, 15, 16, 20, 24, 31, 40, 59, 100, 160]
    items = {k: some(n) for k, n in enumerate(lengths)}
    docs = {}
    for k, item in items.items():
        for part in (0, 0.1, 0.2):
            for _ in range(2):
                docs[len(docs)] = some(12) + edited(item, int(part * len(item)), draw, vocabulary) + some(12)
    near = {(d, k): word_edits(item, words) for d, words in docs.items() for k, item in items.items()}
    near = {pair: e for pair, e in near.items() if e <= int(0.2 * len(items[pair[1]]))}
    as_table = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in find_leaks(as_table(docs, "doc_id"), as_table(items, "item_id")).collect()}
    assert got.items() <= near.items()
    assert {p for p, e in near.items() if e == 0} <= set(got)
    assert len(got) >= decontaminate.TARGET * len(near) and len(near) > 100


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    for r in rows(spark, "op2_bpe").itertuples():
        ids = t.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pieces_follow_every_character():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t, v = Tokenizer.from_file(path), bpe.Vocabulary(path)
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)} '{chr(c)}" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    found, number, first = bpe.distinct(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), list(v.special))
    lists = v.encode(found)
    for k, text in enumerate(texts):
        assert [x for p in number[first[k] : first[k + 1]] for x in lists[p]] == t.encode(text, add_special_tokens=False).ids, hex(ord(text[1]))


def test_toxicity(spark):
    got = rows(spark, "op3_toxicity").merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert ((got.score >= 0) & (got.score <= 1)).all()
    clean = got[got.toxic == 0]
    assert clean.predicted.mean() < 0.05 and got[(got.toxic == 1) & ~got.held_out].score.mean() > clean.score.mean()


def test_substrings(spark, docs):
    words = {i: WORD.findall(t) for i, t in docs.items()}
    low: dict = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            low.setdefault(tuple(words[i][k : k + 13]), i)
    for r in rows(spark, "op4_substrings").itertuples():
        w = words[r.doc_id]
        gone = {j for k in range(len(w) - 12) if low[tuple(w[k : k + 13])] < r.doc_id for j in range(k, k + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_base_score(spark, docs):
    words = {i: [*WORD.findall(t.translate(ASCII)), None] for i, t in docs.items()}
    counts = collections.Counter(x for i, w in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for x in w)
    n, v = sum(counts.values()), len(counts)
    for r in rows(spark, "op5_language_model").itertuples():
        w = words[r.doc_id]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_long_words_cost_their_length(spark):
    draw = np.random.default_rng(2)
    texts = [(k, "some plain words of a text " * 5) for k in range(40) if k not in (3, 5)]
    texts += [(k, bytes(draw.integers(97, 123, n).tolist()).decode()) for k, n in ((3, 1_000), (5, 4_000))]
    got = {r["doc_id"]: r for r in score_text(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[3]["held_out"] and got[5]["held_out"]
    assert got[3]["bits_per_byte"] > 3 and got[5]["bits_per_byte"] == pytest.approx(got[3]["bits_per_byte"], rel=0.2)


def test_order_of_words_counts(spark):
    words = "every good driver knows where old roads turn toward distant hills".split()
    shuffled = words[::-1]
    texts = [(k, " ".join(words)) for k in range(40) if k not in (3, 5)] + [(3, " ".join(words)), (5, " ".join(shuffled))]
    got = {r["doc_id"]: r for r in score_text(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[3]["held_out"] and got[5]["held_out"] and got[3]["base_score"] == pytest.approx(got[5]["base_score"])
    assert got[3]["score"] > got[5]["score"] + 1


def test_bytes(spark, docs):
    data = {i: t.encode() for i, t in docs.items()}
    low: dict = {}
    for i in sorted(data):
        for k in range(len(data[i]) - 49):
            low.setdefault(data[i][k : k + 50], i)
    for r in rows(spark, "op6_suffix_array").itertuples():
        d = data[r.doc_id]
        gone = np.zeros(len(d) + 2, int)
        for k in range(len(d) - 49):
            if low[d[k : k + 50]] < r.doc_id:
                gone[k + 1 : k + 51] = 1
        kept = bytes(x for x, g in zip(d, gone[1:-1], strict=True) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(d), gone.sum(), (np.diff(gone) == 1).sum(), hashlib.sha256(kept).hexdigest())


def test_neighbours(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.array(e.embedding.tolist(), np.float64), e.vec_id.to_numpy()
    got = rows(spark, "op7_neighbours")
    near = got.groupby("query_id").vec_id.apply(set)
    hit = 0
    asked = ids[ids % 20 == 0]
    for q in asked:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & near[q])
    assert hit / (20 * len(asked)) >= 0.9


def test_neighbours_are_ranked(spark):
    """With every leaf searched: ranks, ties and scores against all products."""
    draw = np.random.default_rng(9)
    x = draw.integers(-2, 3, (300, 4)).astype(np.float32)
    x[250:] = x[:50]
    x = x[(x != 0).any(1)]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(40, [9.0, 9.0, 9.0, 9.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("cells", F.lit(2)), k=7).toPandas()
    assert not got.duplicated(["query_id", "vec_id"]).any()
    of = {k: np.array(v) for k, v in rows[:-1]}
    if got[got.vec_id == 40].score.max() > 20:  # one of the two vectors of this id counts
        of[40] = np.full(4, 9.0)
    for q, part in got.groupby("query_id"):
        best = sorted((-float(of[q] @ v), k) for k, v in of.items() if k != q)[:7]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 8))
        assert list(zip((-part.score).tolist(), part.vec_id.tolist(), strict=True)) == best
    assert set(got.query_id) == {k for k in of if k % 20 == 0}


def test_large_leaves_are_dealt(spark, monkeypatch):
    from addrweave.llm import rptrees as R

    x = np.random.default_rng(3).normal(size=(1500, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    plain = sorted(map(tuple, nearest(df).collect()))
    monkeypatch.setattr(R, "BUCKET", 37)
    assert sorted(map(tuple, nearest(df).collect())) == plain


def test_buckets_return_what_can_still_be_near(spark, monkeypatch):
    """Rows that buckets return grow with queries and rounds, not with queries times buckets."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    from addrweave.llm import rptrees as R

    x = np.random.default_rng(8).normal(size=(1500, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    union, returned = Frame.unionByName, []
    monkeypatch.setattr(Frame, "unionByName", lambda found, other: returned.append(found.count()) or union(found, other))
    monkeypatch.setattr(R, "BUCKET", 90)
    nearest(df).count()
    assert len(returned) >= 4 and sum(returned) < len(returned) * 75 * (20 + 1 + R.SPARE), returned


def test_searched_share_of_larger_tables():
    from addrweave.llm import rptrees as R

    for n in (10**4, 10**5, 10**6, 10**8):
        assert R.LEAVES / (R.TREES << R.depth_for(n)) >= R.SHARE
    x = np.random.default_rng(0).normal(size=(130_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = R.Forest(x[: R.SAMPLE], R.depth_for(len(x)), R.TREES)
    leaf = np.concatenate([forest.leaves(x[k : k + 10_000]) for k in range(0, len(x), 10_000)])
    hit = 0
    for q in range(len(x) - 40, len(x)):
        seen = np.zeros(len(x), bool)
        for tree, at in forest.search(x[q], R.LEAVES):
            seen |= leaf[:, tree] == at
        hit += seen[np.argpartition(-(x @ x[q]), 21)[:21]].sum()
    assert hit / (40 * 21) >= 0.92


def test_odd_vectors(spark):
    good = [(k, [1.0, float(k % 3)]) for k in range(0, 60, 5)]
    odd = [(100, None), (120, [0.0, 0.0]), (140, [None, 1.0]), (160, [float("nan"), 1.0])]
    got = nearest(spark.createDataFrame(good + odd, "vec_id long, embedding array<float>")).toPandas()
    assert set(got.query_id) == {0, 20, 40} and set(got.vec_id) <= {k for k, _ in good}
    assert (got.groupby("query_id").size() == len(good) - 1).all()
    assert nearest(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).collect() == []
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_near_duplicates(spark, docs):
    sets = {}
    for i, t in docs.items():
        w = WORD.findall(t.translate(ASCII))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    for r in rows(spark, "op8_near_duplicates").itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), top(r.doc_id) == r.doc_id)


def test_licenses(spark):
    texts = [(1, "x the MIT License and mit license. Apache License"), (2, "permission is hereby granted free of charge to any person getting a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"), (3, "nothing")]
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 2, 7, "apache,mit")
    assert (got[2]["labels"], got[2]["base_labels"], got[3]["labels"]) == ("mit", "", "")


def test_edited_licenses(spark):
    """A license is found with words changed all over it and with fifty words put in."""
    draw = np.random.default_rng(4)
    some = lambda n: " ".join(f"x{k}" for k in draw.integers(0, 500, n))
    rows, wanted = [], {}
    for k, (label, body) in enumerate(TEXTS):
        words = body.split()
        changed = [w if j % 9 else "changed" for j, w in enumerate(words)]
        middle = len(words) // 2
        for part, own in enumerate((words, changed, [*words[:middle], *some(50).split(), *words[middle:]])):
            if part < 2 or len(words) > 110:
                rows.append((10 * k + part, f"{some(30)} {' '.join(own)} {some(30)}"))
                wanted[10 * k + part] = label
    rows += [(900 + k, some(400)) for k in range(5)]
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in wanted.items():
        assert label in got[k]["labels"].split(","), (k, label)
    assert all(got[k]["labels"] == "" and got[k]["score"] == 0 for k in range(900, 905))


def test_license_base_columns(spark, docs):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(ASCII))
    for r in rows(spark, "op9_licenses").to_dict("records"):
        words = split(docs[r["doc_id"]])
        places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted({label for _, label in places})))
        if places:
            assert (r["first_word"], r["last_word"]) == (min(places)[0], max(places)[0])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_language(spark):
    got = rows(spark, "op10_language_id").merge(spark.read.parquet(f"{SF}/documents.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.85


def test_language_needs_a_letter(spark):
    rows = [(k, "plain words of a text", "en") for k in range(8)] + [(10, "½ ² Ⅷ ①", None), (11, "12 %", "en"), (12, "ª", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[10], got[11], got[12]) == ("und", "und", "en")


def test_many_languages(spark):
    draw = np.random.default_rng(6)
    word = lambda: bytes(draw.integers(97, 123, 7).tolist()).decode()
    known = {f"l{k:03}": [word() for _ in range(40)] for k in range(300)}
    rows = [(k, " ".join(draw.choice(known[f"l{k % 300:03}"], 60)), f"l{k % 300:03}") for k in range(900)]
    got = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)).where("not held_out").collect()
    assert sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in got) > 0.9 * len(got)


def test_language_behind_equal_openings(spark):
    draw = np.random.default_rng(4)
    word = lambda: bytes(draw.integers(97, 123, 6).tolist()).decode()
    opening = " ".join(word() for _ in range(100))
    known = {lang: [word() for _ in range(60)] for lang in ("aa", "bb")}
    rows = []
    for k in range(80):
        lang = ("aa", "bb")[k % 2]
        own = " ".join(draw.choice(known[lang], 150))
        rows.append((k, own if zlib.crc32(str(k).encode()) % 4 == 2 else f"{opening} {own}", lang))
    got = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert got and all(r["lang_pred"] == rows[r["doc_id"]][2] for r in got)


def _scattered(words, kind, draw):
    """A license's words with ``kind`` edits."""
    x = lambda: f"x{draw.integers(0, 500)}"
    name, share = kind
    out = []
    for j, w in enumerate(words):
        hit = draw.random() < share if isinstance(share, float) else j % share == share - 1
        if name == "put in":
            out += [w, x()] if hit else [w]
        elif name == "changed":
            out.append(x() if hit else w)
        elif not hit:
            out.append(w)
    return out


KINDS = [("put in", 1), ("put in", 2), ("put in", 3), *((kind, share) for kind in ("put in", "changed", "left out") for share in (0.0, 0.05, 0.1, 0.15))]


def test_scattered_edits_of_licenses(spark):
    """Words put in behind every word, every second and every third; random edits of up to 15 %.

    A text is wanted if its words hold 0.8 of the template's by plain dynamic programming.
    """
    from addrweave.llm.licenses import TEMPLATES

    draw = np.random.default_rng(11)
    plain = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(ASCII))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1] / len(b)

    rows, wanted = [], {}
    for t, (label, body) in enumerate(TEMPLATES):
        for k, kind in enumerate(KINDS):
            own = _scattered(plain(body), kind, draw)
            doc_id = 100 * t + k
            rows.append((doc_id, " ".join([*(f"y{j}" for j in range(20)), *own, *(f"z{j}" for j in range(20))])))
            if common(own, plain(body)) >= 0.8:
                wanted[doc_id] = label
    rows.append((9001, "Released under an MIT License."))
    wanted[9001] = "mit"
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(wanted) > 200
    assert [(k, label) for k, label in wanted.items() if label not in got[k]["labels"].split(",")] == []


def test_a_long_text_of_scattered_license_words_is_no_license(spark):
    """The words of a license, in order but far apart, are not one."""
    words = next(body for label, body in TEXTS if label == "mit" and len(body.split()) > 100).split()
    far = " ".join(f"{w} a{j} b{j} c{j} d{j} e{j} f{j}" for j, w in enumerate(words))
    got = license_scan(spark.createDataFrame([(1, far)], "doc_id long, text string")).first()
    assert (got["labels"], got["score"]) == ("", 0.0)


def test_the_better_of_two_licenses_at_one_place(spark):
    bsd = {label: body for label, body in TEXTS if label.startswith("bsd-")}
    texts = ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0. Licensed under CC BY-NC 4.0.", bsd["bsd-2-clause"], bsd["bsd-3-clause"]]
    got = {r["doc_id"]: r["labels"] for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == "cc-by,cc-by-nc-4.0" and got[1] == "cc-by,cc-by-nc-4.0,cc-by-sa-4.0"
    assert "bsd-2-clause" in got[2] and "bsd-3-clause" not in got[2]
    assert "bsd-3-clause" in got[3] and "bsd-2-clause" not in got[3]


def test_heavy_minimizers_by_different_segments(spark):
    """A minimizer is heavy by its different segments, not by their copies."""
    from addrweave.llm.repeats import heavy

    rows = [(1, 7, 60)] * 40 + [(2, k, 60) for k in range(40)] + [(3, k, 50) for k in range(20)] + [(4, k % 21, 50) for k in range(90)]
    made = spark.createDataFrame(rows, "m long, s1 long, bytes int").repartition(3)
    assert sorted(r["m"] for r in heavy(made, 1000).collect()) == [2, 4]


def test_suffixes_by_plain_comparison():
    """Ranks and order, where places fit beside the keys and where they don't."""
    from addrweave.llm.fmindex import ordered, sorted_suffixes

    draw = np.random.default_rng(18)
    for top, depth in ((2, 50), (4, 7), (255, 1), (1 << 20, 13), (1 << 40, 5)):
        symbols = draw.choice(np.unique(draw.integers(1, top + 1, 3)), 400)
        symbols[draw.integers(0, 400, 30)] = 0
        symbols[-1] = 0
        order, rank = sorted_suffixes(symbols, depth)
        whole = [tuple(s[: (s == 0).argmax() + 1][:depth].tolist()) for s in (symbols[k:] for k in range(400))]
        assert sorted(order.tolist()) == list(range(400)) and [whole[k] for k in order] == sorted(whole)
        assert rank.tolist() == [sorted(whole).index(w) for w in whole]
    for top in (9, 1 << 40, (1 << 63) - 1):
        keys = draw.integers(0, top, 500, endpoint=True)
        order, got = ordered(keys, top)
        assert (keys[order] == got).all() and (np.sort(keys) == got).all() and len(np.unique(order)) == 500
