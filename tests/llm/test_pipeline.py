"""Each stage of the corpus pipeline against a plain version, over rows of all kinds."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from addrweave.llm import queries
from addrweave.llm.neardup import near_duplicates
from addrweave.llm.toxicity import toxicity

from .test_corpus import ASCII, WORD, edited, word_edits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents (copies, near copies, passages, edited leaks, odd rows), labels and benchmark."""
    draw = np.random.default_rng(12)
    vocabulary = [f"w{k}" for k in range(900)]
    some = lambda n: [str(w) for w in draw.choice(vocabulary, n)]
    items = {k: some(n) for k, n in enumerate((4, 9, 16, 30, 59))}
    passage, base = some(60), some(80)
    texts: list = [" ".join(some(int(draw.integers(1, 90)))) for _ in range(30)]
    texts += [" ".join(base), " ".join(base), " ".join([*base[:40], "changed", *base[41:]]), " ".join(base[:30])]
    texts += [" ".join([*some(20), *passage, *some(20)]) for _ in range(4)]
    texts += [" ".join([*some(15), *edited(item, times, draw, vocabulary), *some(15)]) for item in items.values() for times in (0, len(item) // 6)]
    texts += [" ".join(["vile", "rotten", *some(20), "vile", "scum"]) for _ in range(60)] + [None, "", " \n", "one two"]
    rows = [(k, t, "en", "a", len(t or "")) for k, t in enumerate(texts)]
    rows += [(None, texts[30], "en", "a", 1), (None, texts[40], "en", "a", 1), (None, texts[60], None, None, None), (3, texts[3], "aa", "b", 7)]
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).withColumn("__row", F.lit(1)).withColumn("kept", F.lit("x")).write.parquet(f"{root}/documents.parquet")
    labels = [(k, int(bool(t) and "vile" in t)) for k, t in enumerate(texts) if k % 3]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(90, None), (None, "x")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, items


def run(spark, corpus, name):
    root, _, _ = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    out = dict(P.STAGES)[name](spark, docs, root)
    if name != "bpe":
        assert out.columns == P.COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_toxicity_stage(spark, corpus):
    root, rows, _ = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    rejected = {hashlib.md5((r["text"] or "").encode()).digest() for r in docs.join(toxicity(docs, spark.read.parquet(f"{root}/labels.parquet")).where("predicted = 1").select("doc_id"), "doc_id").collect()}
    assert run(spark, corpus, "toxicity") == sorted((r for r in rows if hashlib.md5((r[1] or "").encode()).digest() not in rejected), key=str)
    toxic = [r for r in rows if r[1] and "vile" in r[1]]
    left = run(spark, corpus, "toxicity")
    assert sum(r in left for r in toxic) < 0.1 * len(toxic) and len(left) > 0.95 * (len(rows) - len(toxic))


def test_near_copies_stage(spark, corpus):
    _, rows, _ = corpus
    sets = {}
    for doc, text, *_ in rows:
        words = WORD.findall((text or "").translate(ASCII))
        if doc is not None:
            sets[doc] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    low = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
        if all(low[low[k]] == low[k] for k in low):
            break
    named = {(r[0], r[1]): r for r in sorted(rows, key=lambda r: str(r[2:]), reverse=True) if r[0] is not None and low[r[0]] == r[0]}
    assert run(spark, corpus, "near_dedup") == sorted([*named.values(), *(r for r in rows if r[0] is None)], key=str)


def test_substring_stage(spark, corpus):
    _, rows, _ = corpus
    order = lambda doc: 1 << 62 if doc is None else doc
    low: dict = {}
    for doc, text, *_ in rows:
        words = WORD.findall(text or "")
        for k in range(len(words) - 12):
            at = tuple(words[k : k + 13])
            low[at] = min(low.get(at, 1 << 62), order(doc))
    wanted = []
    for doc, text, lang, source, n in rows:
        words = WORD.findall(text or "")
        gone = {j for k in range(len(words) - 12) if low[tuple(words[k : k + 13])] < order(doc) for j in range(k, k + 13)}
        if gone and len(gone) < len(words):
            kept = " ".join(w for k, w in enumerate(words) if k not in gone)
            wanted.append((doc, kept, lang, source, len(kept)))
        elif not gone:
            wanted.append((doc, text, lang, source, n))
    assert run(spark, corpus, "substring_dedup") == sorted(wanted, key=str)


def test_leaks_stage(spark, corpus):
    _, rows, items = corpus
    words = lambda t: re.findall("[0-9a-z]+", (t or "").lower())
    clean = [r for r in rows if not any(word_edits(item, words(r[1])) <= int(0.2 * len(item)) for item in items.values())]
    assert len(rows) - len(clean) >= 10
    assert run(spark, corpus, "decontamination") == sorted(clean, key=str)


def test_token_stage(spark, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    _, rows, _ = corpus
    wanted = sorted((str(r[0]), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((str(r[0]), r[1]) for r in run(spark, corpus, "bpe")) == wanted


def test_all_stages(spark, corpus):
    root, rows, _ = corpus
    out = P.run(spark, root).toPandas()
    assert 0 < len(out) < len(rows) and set(out.doc_id.dropna()) <= {r[0] for r in rows}


def test_empty_corpus(spark, corpus):
    root, _, _ = corpus
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, empty, root).collect() == []


def test_two_texts_under_one_id(spark):
    """One of the two sets is the document's, and the same one in every run."""
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(5, a), (5, b), (1, a), (2, b), (None, a)]
    got = [sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()), key=str) for n in (1, 4)]
    assert got[0] == got[1] and {c for d, c, _ in got[0] if d == 5} in ({1}, {2})
    assert (None, None, True) in got[0]


def test_held_out_toxic_documents(spark):
    """Documents that the model never saw: most toxic ones are rejected, clean ones aren't."""
    sf = "/root/testdata/sf0.1"
    got = toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    got = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert held[held.toxic == 1].predicted.mean() >= 0.7 and held[held.toxic == 0].predicted.mean() <= 0.01
