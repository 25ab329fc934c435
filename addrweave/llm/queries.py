"""Queries over the driver's tables, one for each corpus operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .decontaminate import find_leaks
from .fmindex import substring_dedup
from .language import language_id
from .licenses import license_scan
from .merkle import manifest
from .mixing import score_text
from .neardup import near_duplicates
from .negatives import hard_negatives
from .pfp import byte_dedup
from .rptrees import nearest
from .simhash import simhash_groups
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The byte-level tokenizer file among the installed public ones."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_text(_table(spark, sf_dir, "documents"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, similarity=0.85)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_table(spark, sf_dir, "documents"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can express."""
    out = license_scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can express."""
    out = score_text(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_substrings": op4_substrings,
    "op5_language_model": op5_language_model,
    "op6_suffix_array": op6_suffix_array,
    "op7_neighbours": op7_neighbours,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_licenses": op9_licenses,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_simhash": op12_simhash,
    "op13_merkle": op13_merkle,
    "license_phrases": license_phrases,
    "word_scores": word_scores,
}

_CRC = """crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab)"""
_CRC_OF = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_FRAMED = "coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = " || ".join(_FRAMED.format(c=c) for c in ("doc_id", "source", "lang", "{n}", "text"))

#: What SQL can't express is held against brute force, round trips or held-out labels in tests.
ORACLE_SQL: dict[str, str] = {
    "op4_substrings": r"""
WITH texts AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS t FROM documents),
starts AS (SELECT doc_id, t, unnest(range(1, len(t) - 11)) AS i FROM texts WHERE len(t) >= 13),
windows AS (SELECT doc_id, i, array_to_string(t[i:i + 12], ' ') AS w FROM starts),
lowest AS (SELECT w, min(doc_id) AS low FROM windows GROUP BY w),
gone AS (SELECT DISTINCT doc_id, i + o AS k FROM windows JOIN lowest USING (w) CROSS JOIN (SELECT unnest(range(0, 13)) AS o) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(t) AS word, unnest(range(1, len(t) + 1)) AS k FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(len(t) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)""",
    "op6_suffix_array": """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2 * 1049) AS piece FROM texts, unnest(range(0, CAST(greatest(len(h) // 2 - 49, 0) AS BIGINT), 1000)) AS r(o)),
windows AS (SELECT doc_id, o + j AS i, md5_number(substr(piece, 2 * j + 1, 100)) AS w FROM pieces, unnest(range(0, CAST(least(len(piece) // 2 - 49, 1000) AS BIGINT))) AS r(j)),
lowest AS (SELECT w, min(doc_id) AS low FROM windows GROUP BY w),
hits AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS fresh FROM windows JOIN lowest USING (w) WHERE low < doc_id),
runs AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
before AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS free FROM spans),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * free + 1, 2 * (a - free)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS left_over FROM before JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)""",
    "op8_near_duplicates": f"""
WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS} AS t FROM documents),
nodes AS (SELECT t, min(doc_id) AS node FROM texts WHERE len(t) > 0 GROUP BY t),
shingles AS (SELECT DISTINCT node, array_to_string(t[i:i + 2], ' ') AS s FROM nodes, unnest(range(1, greatest(len(t) - 2, 1) + 1)) AS r(i)),
sizes AS (SELECT node, count(*) AS n FROM shingles GROUP BY node),
each AS (SELECT node, s, n FROM shingles JOIN sizes USING (node)),
links AS (SELECT a.node AS x, b.node AS y FROM each a JOIN each b ON a.s = b.s AND a.node <> b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (SELECT node, node AS component FROM nodes UNION SELECT y, component FROM reached JOIN links ON x = node),
lowest AS (SELECT node, min(component) AS component FROM reached GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM texts LEFT JOIN nodes USING (t) LEFT JOIN sizes USING (node) LEFT JOIN lowest USING (node)""",
    "license_phrases": rf"""
WITH texts AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS t FROM documents),
words AS (SELECT doc_id, unnest(t) AS w, unnest(range(0, len(t))) AS k FROM texts),
ahead AS (SELECT doc_id, w, k, lead(w, 1) OVER each AS w1, lead(w, 2) OVER each AS w2, lead(w, 3) OVER each AS w3 FROM words WINDOW each AS (PARTITION BY doc_id ORDER BY k)),
met AS (SELECT doc_id, k, CASE WHEN w = 'gnu' AND w1 = 'general' AND w2 = 'public' AND w3 = 'license' THEN 'gpl' WHEN w = 'apache' AND w1 = 'license' THEN 'apache' WHEN w = 'cc' AND w1 = 'by' THEN 'cc-by' WHEN w = 'mit' AND w1 = 'license' THEN 'mit' END AS label FROM ahead),
found AS (SELECT doc_id, count(*) AS n, min(k) AS a, max(k) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM met WHERE label IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels
FROM texts LEFT JOIN found USING (doc_id)""",
    "word_scores": f"""
WITH {_CRC},
texts AS (SELECT doc_id, {_CRC_OF} % 5 = 1 AS held_out, list_append({_WORDS}, '') AS t FROM documents, crc),
words AS (SELECT doc_id, held_out, unnest(t) AS w FROM texts),
counts AS (SELECT w, count(*) AS c FROM words WHERE NOT held_out GROUP BY w),
facts AS (SELECT sum(c) AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 4) AS base_score
FROM words LEFT JOIN counts USING (w), facts GROUP BY doc_id, held_out""",
    "op11_hard_negatives": """
WITH rows AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score FROM rows a JOIN rows b ON a.id % 100 = 0 AND a.id <> b.id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
    "op13_merkle": f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab),
marked AS (SELECT *, doc_id IS NOT NULL AND xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 7 = 0 AS hit FROM documents, crc),
hashed AS (SELECT doc_id, lang, sha256({_LEAF.format(n="n_chars")}) AS leaf, CASE WHEN hit AND n_chars IS NOT NULL THEN sha256({_LEAF.format(n="(n_chars + 1)")}) ELSE sha256({_LEAF.format(n="n_chars")}) END AS other FROM marked),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM leaves
  UNION ALL SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, n, pos // 2),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM subroots
  UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, n, pos // 2),
walk AS (SELECT doc_id, lang, leaf, pos AS seat, 0 AS lvl, pos, n, other AS folded, '' AS proof FROM leaves
  UNION ALL SELECT doc_id, w.lang, leaf, seat, w.lvl + 1, w.pos // 2, (w.n + 1) // 2, sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || folded ELSE folded || coalesce(s.h, '') END), proof || coalesce(s.h, '')
  FROM walk w LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM w.lang AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
climb AS (SELECT doc_id, w.lang, leaf, seat, subroot, 0 AS lvl, r.pos, r.n, folded, proof FROM walk w JOIN subroots r ON r.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL SELECT doc_id, c.lang, leaf, seat, subroot, c.lvl + 1, c.pos // 2, (c.n + 1) // 2, sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || folded ELSE folded || coalesce(s.h, '') END), proof || coalesce(s.h, '')
  FROM climb c LEFT JOIN tops s ON s.lvl = c.lvl AND s.pos = xor(c.pos, 1) WHERE c.n > 1)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.h AS verified FROM climb c JOIN tops t ON t.n = 1 AND c.n = 1""",
}
