"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import stored, table
from . import bytebpe, collocations, ctph, htmltext, lm, mpegts, negatives, packing, pii, quality, sharding, simhash, warc

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))
    return placed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(mpegts.mux(table(spark, sf_dir, "documents")), "media")
    kept = media.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    parsed = mpegts.parse(kept)
    return parsed.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        mpegts.feature().alias("feature"),
    )


def op5_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compared(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents"), count="n_replaced")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), public_tokenizers.PATTERN)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.written(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, list_dot_product(a.c, b.c)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""

COLLOCATIONS_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), n AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), x AS MATERIALIZED (
  SELECT lang, unnest(ws) AS w1, unnest(ws[2:]) AS w2, unnest(ws[3:]) AS w3, unnest(ws[4:]) AS w4 FROM w
), g AS (
  SELECT lang, 1 AS m, w1 AS phrase FROM x
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM x WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM x WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM x WHERE w4 IS NOT NULL
), f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE m > 1
), cut AS (
  SELECT c.lang, c.phrase, k, a, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM c JOIN range(1, 4) t(k) ON k < m
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')
), low AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM c, range(2, 4) s(k), range(1, 4) t(i) WHERE k < m AND i + k - 1 <= m GROUP BY ALL
)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score
FROM low JOIN n USING (lang) LEFT JOIN inside USING (lang, phrase)
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER w <= 2000
"""

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_mpegts": op4_mpegts,
    "op5_ctph": op5_ctph,
    "op6_pii": op6_pii,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_html": op10_html,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_sharding": op12_sharding,
    "op13_collocations": op13_collocations,
}
ORACLE: dict[str, str] = {"op11_hard_negatives": NEGATIVES_SQL, "op13_collocations": COLLOCATIONS_SQL}
