"""The trained models, feature by feature and bit by bit, against plain loops."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from addrweave.llm import mixing, toxicity
from addrweave.llm.language import language_id
from addrweave.llm.repeats import keyed

SPLIT = lambda k, divisor: zlib.crc32(str(k).encode()) % divisor


def _features(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return [*{(w,) for w in words}, *{(1, a, b) for a, b in zip(words, words[1:])}, *{(2, a, b) for a, b in zip(words, words[2:])}, "bias"]


def test_ftrl_by_plain_loops(spark):
    draw = np.random.default_rng(11)
    plain, foul = [f"w{k}" for k in range(8)], ["foul", "vile", "Mean"]
    texts, labels = [], []
    for k in range(240):
        bad = k % 3 == 0
        texts.append((k, None if k == 100 else " ".join(draw.choice(plain + foul * bad, 20))))
        labels.append((k, int(bad)))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}

    learn = [(_features(t), y) for (k, t), (_, y) in zip(texts, labels, strict=True) if SPLIT(k, 3) != 1]
    z, n = collections.Counter(), collections.Counter()

    def weight(f):
        rest = z[f] if f == "bias" else math.copysign(max(abs(z[f]) - toxicity.L1, 0), z[f])
        return -rest / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(learn)):
            found, y = learn[k]
            w = {f: weight(f) for f in found}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (toxicity.POSITIVE_WEIGHT if y else 1)
            for f in found:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
                n[f] += g * g
    assert 1 < sum(weight(f) != 0 for f in n) < len(n) / 2  # most weights are zero
    for k, t in texts:
        assert got[k] == pytest.approx(1 / (1 + math.exp(-sum(map(weight, _features(t))))), abs=1e-5), k


def _letters(text):
    return (" " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))).encode()


def test_language_is_the_smallest_compressed_size(spark):
    draw = np.random.default_rng(12)
    word = lambda: "".join(draw.choice(list("abcdeéłшд"), 6))
    known = {lang: [word() for _ in range(80)] for lang in ("aa", "bb", "cc")}
    rows = [(k, " ".join(draw.choice(known[("aa", "bb", "cc")[k % 3]] + known["aa"][:40], 30 + 40 * (k % 7))) + " 12!", ("aa", "bb", "cc")[k % 3]) for k in range(90)]
    rows.append((90, " ".join(draw.choice(known["bb"] + known["cc"], 6000)), "bb"))  # several pieces
    got = {r["doc_id"]: r["lang_pred"] for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()}
    least: dict = {}
    for k, text, lang in rows:
        if SPLIT(k, 4) != 2:
            data = _letters(text)
            step = math.ceil(len(data) / math.ceil(len(data) / 512))
            for part in (data[a : a + step] for a in range(0, len(data), step)):
                key = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)
                slots = least.setdefault(lang, {})
                slots[key % 512] = min(slots.get(key % 512, (key, part)), (key, part))
    contents = {lang: b"".join(slots[s][1] for s in sorted(slots)) for lang, slots in least.items()}
    for k, text, _ in rows:
        data, sizes = _letters(text), []
        for lang, content in contents.items():
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            one = zstandard.ZstdCompressor(level=3, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append((sum(len(one.compress(data[a : a + 16384])) for a in range(0, len(data), 16384)), lang))
        assert got[k] == min(sizes)[1], k


def _places(text):
    """Of each byte of a text's stream: the byte, its contexts and its place in the word."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    data, before = b"", b""
    for item in [w + b" " for w in words] + [b"\n"]:
        for k, byte in enumerate(item):
            yield byte, (data[-3:], item[:k], (before, item[:k])), min(k, 3)
            data += item[k : k + 1]
        before = item[:-1]


def _cells(byte, contexts):
    """The counters of a byte: context, first half byte (behind it), and the half byte met."""
    for j, c in enumerate(contexts):
        yield j, (j, c, None), byte >> 4
        yield j, (j, c, byte >> 4), byte & 15


def test_mixing_bit_by_bit(spark):
    """Costs of whole texts by a mixer of one bit after the other, with its own counters and contexts."""
    draw = np.random.default_rng(13)
    texts = [" ".join(draw.choice(["ab", "ba", "B"], n)) for n in (3, 60, 400, 1500, 80, 5)] + [""]
    rows = list(enumerate(texts))
    learned = [SPLIT(k, 2) == 0 for k in range(len(texts))]
    assert len(set(learned)) == 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = mixing.train(keyed(df).where(F.col("doc_id").isin([k for k in range(len(texts)) if learned[k]])))
    seen = collections.defaultdict(collections.Counter)
    for t in (t for t, known in zip(texts, learned, strict=True) if known):
        for byte, contexts, _ in _places(t):
            for _, row, value in _cells(byte, contexts):
                seen[row][value] += 1
    grid = np.linspace(-8, 8, mixing.STEPS)
    stream = mixing.Stream(pa.array(texts))
    got = np.add.reduceat(model.score(stream, np.array(learned)).astype(float), stream.begin)
    for k, t in enumerate(texts):
        places = list(_places(t))
        factor, slope, total, begin, end = [1.0] * 3, [0.0] * 3, 0.0, 0, 256
        for at, (byte, contexts, place) in enumerate(places):
            if at == end:
                factor = [min(max(f + 0.5 * s / (8 * (end - begin)), 0.25), 3) for f, s in zip(factor, slope, strict=True)]
                slope, begin = [0.0] * 3, end
                end += min(end, mixing.STEP)
            for b in range(8):
                bit = byte >> (7 - b) & 1
                given = []
                for j, c in enumerate(contexts):
                    row = seen[j, c, None if b < 4 else byte >> 4]
                    half = byte >> 4 if b < 4 else byte & 15
                    both = [0.2, 0.2]
                    for value, times in row.items():
                        if value >> (4 - b % 4) == half >> (4 - b % 4):
                            both[value >> (3 - b % 4) & 1] += times
                    both[bit] -= learned[k]  # the bit's own count
                    given.append(float(model.weights[4 * b + place, j]) * math.log(both[1] / both[0]))
                x = min(max(sum(f * s for f, s in zip(factor, given, strict=True)), -8), 8)
                p = min(max((1 / (1 + math.exp(-x)) + np.interp(x, grid, model.map[4 * b + place])) / 2, 1e-6), 1 - 1e-6)
                total += math.log10(p if bit else 1 - p)
                slope = [s + g * (bit - p) for s, g in zip(slope, given, strict=True)]
        assert got[k] == pytest.approx(total, rel=5e-3), k


def test_training_texts_cost_what_others_cost(spark):
    """Texts of one distribution cost as much a byte whether they were learned from or not."""
    draw = np.random.default_rng(14)
    words = ["".join(draw.choice(list("abcdefgh"), 5)) for _ in range(200)]
    rows = [(k, " ".join(draw.choice(words, 60))) for k in range(300)]
    got = mixing.score_text(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("held_out").agg(F.avg("bits_per_byte").alias("cost")).collect()
    cost = {r["held_out"]: r["cost"] for r in got}
    assert cost[False] == pytest.approx(cost[True], rel=0.02)


def test_weights_are_fitted_on_all_texts(spark):
    """Weights and map are those of all whole training texts, however many and however long they are."""
    draw = np.random.default_rng(15)
    texts = [" ".join(draw.choice(["ab", "ba", "cab"], 3)) + f" {k}" for k in range(900)]
    texts += [" ".join(["abc"] * 1500 + draw.choice(["x", "yx", "zy"], 1500).tolist()) + f" {k}" for k in range(3)]
    docs = keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).repartition(3)
    got, want = mixing.train(docs), mixing.Mixer(mixing.count(docs))
    for t in texts:
        want.learn(mixing.Stream(pa.array([t])))
    assert want.met.sum() == 8 * sum(len(t) + 2 for t in texts)  # every bit; a space and the end more
    want.finish()
    assert np.allclose(got.weights, want.weights, atol=1e-4) and np.allclose(got.map, want.map, atol=1e-4)


def test_contexts_that_stand_once_stay_out_of_the_joins(spark, monkeypatch):
    """Of stretches those whose context stands in two places or more, whatever tasks hold at a time; gains are those of all."""
    monkeypatch.setattr(mixing, "HELD", 16)
    monkeypatch.setattr(mixing, "RANGE", 256)
    draw = np.random.default_rng(16)
    rows, seen = [], collections.Counter()
    for k in range(120):
        own = [int(c) for c in draw.choice([*range(-40, 40), *(1 << 62, -(1 << 63), (1 << 63) - 1)], int(draw.integers(0, 9)))] + [10_000 + k]
        seen.update(own)
        rows.append((k, SPLIT(k, 5) != 1, [(c, int(draw.integers(0, 3)), 0, 0, -3.0) for c in own]))
    rows.append((120, True, []))
    scored = spark.createDataFrame(rows, f"row long, learn boolean, stretches array<struct<{mixing._STRETCH}>>").repartition(5)
    met = [r["c"] for r in mixing.met_again(scored).collect()]
    assert sorted(met) == sorted(c for c, n in seen.items() if n > 1)
    got = {r["row"]: r["gain"] for r in mixing._gain(scored).collect()}
    n, n_c = collections.Counter(), collections.Counter()
    for _, learn, places in rows:
        n.update((c, s) for c, s, *_ in places if learn)
        n_c.update(c for c, *_ in places if learn)
    share = collections.defaultdict(lambda: [0, 0])
    for (c, _), times in n.items():
        if n_c[c] > 1:
            share[int(math.log2(n_c[c] - 1))][0] += times * (times > 1)
            share[int(math.log2(n_c[c] - 1))][1] += times
    want = {}
    for row, _, places in rows:
        for c, s, *_ in places:
            if n_c[c] and seen[c] > 1:  # own counts are 0 here
                g = int(math.log2(n_c[c]))
                w = min(max(share[g][0] / share[g][1], 0.01), 0.99) if g in share else 0.01
                want[row] = want.get(row, 0) + math.log10(w * n[c, s] / n_c[c] + (1 - w) * 1e-3) + 3
    assert got == pytest.approx(want)


def test_a_last_step_costs_what_a_moved_one_costs(spark):
    """Texts whose mixture moves no further are costed alike, and levels are those of the paths."""
    draw = np.random.default_rng(17)
    texts = pa.array([" ".join(draw.choice(["ab", "ba", "cab", "B"], n)) for n in (3, 60, 400, 1500)] + [""])
    stream = mixing.Stream(texts)
    counts = [np.zeros(16 << bits, np.float32) for bits in mixing.ROW_BITS]
    for j in range(mixing.CONTEXTS):
        for half, value in enumerate((stream.bytes >> 4, stream.bytes & 15)):
            np.add.at(counts[j], stream.rows(j, half) + value, 1)
    model = mixing.Mixer(counts)
    model.learn(stream)
    assert model.met.sum() == 8 * len(stream.bytes)
    model.finish()
    part, of, factors = np.arange(len(stream.bytes)), np.repeat(np.arange(5), np.diff(np.append(stream.begin, len(stream.bytes)))), np.full((3, 5), 0.7, np.float32)
    last, moved = (model._bits(stream, part, of, factors, np.zeros(5, np.int32), m) for m in (False, True))
    assert last[1] is None and moved[1].shape == (3, 5) and (last[0] == moved[0]).all()
