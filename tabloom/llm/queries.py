"""Registered queries of the operators in this folder, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import ensure_checkpoint_dir
from . import (
    ann,
    bisector,
    decontaminate,
    jaccard_join,
    language_id,
    licenses,
    line_dedup,
    merkle,
    packing,
    pii,
    quality,
    token_counts,
    toxicity,
)
from .common import crc_bucket

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer() -> str:
    return str(public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in documents: (doc_id, item_id, cosine, lcs, answer)."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License of every document. Its path is source / thousands / hundreds / id."""
    docs = table(spark, folder, "documents")
    number = F.col("doc_id")
    path = F.concat_ws(
        "/", F.coalesce("source", F.lit("unknown")), F.floor(number / 1000).cast("string"),
        F.floor(number / 100).cast("string"), number.cast("string"),
    )
    found = licenses.inherit(licenses.scan(docs, "doc_id", path))
    return found.withColumnRenamed("id", "doc_id")


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents, through a cache that this run makes and fills."""
    cache = f"{ensure_checkpoint_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    return token_counts.count_tokens(table(spark, folder, "documents"), cache, tokenizer())


@query
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without lines of templates that recur across documents."""
    return line_dedup.remove(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))


@query
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer())


@query
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, folder, "documents")))


#: All pairs that share a shingle; components by a recursive query.
ORACLES["op8_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
      range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, m.component_id FROM sets
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""


@query
def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(table(spark, folder, "documents"))


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score", "predicted",
    )


@query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_id.identify(docs, language_id.learn(docs)).select(
        "doc_id", F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "lang_pred", "score", "accepted",
    )


#: Fields of a leaf, in the order of the contract.
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in LEAF_FIELDS[:-1]]
    parts.append(f"coalesce(strlen({text}) || ':' || {text}, '-')")
    return f"sha256({' || '.join(parts)})"


#: crc32 of the id's digits, bit by bit; levels of both trees by recursion.
ORACLES["op11_merkle_manifest"] = rf"""
WITH RECURSIVE marked AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda r, z: xor(r >> 1, (r & 1) * 3988292384)))) % 5 AS bucket
  FROM documents),
leaves AS (
  SELECT doc_id, coalesce('+' || source, '') AS src, {_leaf_sql('text')} AS leaf,
    CASE WHEN bucket = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other
  FROM marked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY src) AS n FROM leaves),
nodes(src, lvl, pos, d, n) AS (
  SELECT src, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT src, lvl + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos)), (n + 15) // 16
  FROM nodes WHERE n > 1 GROUP BY src, lvl, pos // 16, n),
subroots AS (
  SELECT src, d, row_number() OVER (ORDER BY src) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, pos, d, n) AS (
  SELECT 0, pos, d, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos)), (n + 15) // 16
  FROM tops WHERE n > 1 GROUP BY lvl, pos // 16, n),
inner_steps AS (
  SELECT p.src, p.pos, s.lvl,
    coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos < p.pos // (16 ** s.lvl)::BIGINT), '') AS l,
    coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos > p.pos // (16 ** s.lvl)::BIGINT), '') AS r
  FROM placed p JOIN nodes s
    ON s.src = p.src AND s.n > 1 AND s.pos // 16 = p.pos // (16 ** (s.lvl + 1))::BIGINT
  GROUP BY p.src, p.pos, s.lvl),
outer_steps AS (
  SELECT p.src, 1000 + s.lvl AS lvl,
    coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos < p.pos // (16 ** s.lvl)::BIGINT), '') AS l,
    coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos > p.pos // (16 ** s.lvl)::BIGINT), '') AS r
  FROM subroots p JOIN tops s ON s.n > 1 AND s.pos // 16 = p.pos // (16 ** (s.lvl + 1))::BIGINT
  GROUP BY p.src, s.lvl),
steps AS (
  SELECT src, pos, l, r, row_number() OVER (PARTITION BY src, pos ORDER BY lvl) AS ord FROM (
    SELECT src, pos, lvl, l, r FROM inner_steps
    UNION ALL SELECT p.src, p.pos, o.lvl, o.l, o.r FROM placed p JOIN outer_steps o USING (src))),
proofs AS (
  SELECT src, pos, sha256(string_agg(l || r, '' ORDER BY ord)) AS proof, max(ord) AS height FROM steps GROUP BY src, pos),
folds(src, pos, ord, d) AS (
  SELECT src, pos, 0::BIGINT, coalesce(other, leaf) FROM placed
  UNION ALL
  SELECT f.src, f.pos, s.ord, sha256(s.l || f.d || s.r)
  FROM folds f JOIN steps s ON s.src = f.src AND s.pos = f.pos AND s.ord = f.ord + 1)
SELECT p.doc_id, p.leaf, sr.d AS subroot, t.d AS root, coalesce(pr.proof, sha256('')) AS proof_sha256,
  f.d AS folded_root, f.d = t.d AS verified
FROM placed p JOIN subroots sr USING (src) CROSS JOIN (SELECT d FROM tops WHERE n = 1) t
LEFT JOIN proofs pr ON pr.src = p.src AND pr.pos = p.pos
JOIN folds f ON f.src = p.src AND f.pos = p.pos AND f.ord = coalesce(pr.height, 0)
"""


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Witness of every document; every fifth is verified with its text in lower case."""
    docs = table(spark, folder, "documents")
    fields = [F.col(c) for c in LEAF_FIELDS]
    lowered = merkle.leaf(*fields[:-1], F.translate("text", UPPER, LOWER))
    tampered = F.when(crc_bucket("doc_id", 5) == 0, lowered)
    return merkle.build(docs, merkle.leaf(*fields), tampered).proofs().withColumnRenamed("id", "doc_id")


@query
def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score", "predicted", "difference",
    )


#: Rounds by recursion: distances of all pairs of vector and centroid, the nearest, exact means rounded down.
ORACLES["op13_centroid_clusters"] = """
WITH RECURSIVE kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
seeds AS (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept
  ORDER BY sha256('3:' || vec_id), v LIMIT 8),
centers(round, c, m) AS (
  SELECT 0, c, v FROM seeds
  UNION ALL
  SELECT round + 1, c, CASE WHEN bool_or(own) THEN list(means ORDER BY i) ELSE any_value(m) END
  FROM (
    SELECT x.round, x.c, x.m, i, count(k.vec_id) > 0 AS own,
      floor(sum(k.v[i])::DECIMAL(38, 0) / nullif(count(k.vec_id), 0))::BIGINT AS means
    FROM centers x CROSS JOIN range(1, 65) AS g(i)
    LEFT JOIN (
      SELECT vec_id, v, arg_min(c, d * 8 + c) AS c FROM (
        SELECT vec_id, v, y.c,
          list_sum(list_transform(list_zip(v, y.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM kept, centers y)
      GROUP BY vec_id, v) k ON k.c = x.c
    GROUP BY x.round, x.c, x.m, i)
  WHERE round < 10 GROUP BY round, c),
last AS (SELECT c, m FROM centers WHERE round = 10),
nearest AS (
  SELECT vec_id, arg_min(c, d * 8 + c) AS cluster, min(d) AS distance FROM (
    SELECT vec_id, c,
      list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM kept, last)
  GROUP BY vec_id)
SELECT vec_id, cluster::INTEGER AS cluster, distance,
  (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM nearest JOIN last ON last.c = nearest.cluster
"""


@query
def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return bisector.cluster(table(spark, folder, "embeddings"))
