"""The registered queries of this subpackage, each over the whole of its table, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, hard_negatives, language_model, licences, media, mixing, ngram_join, quality, simhash, token_counts, token_output, toxicity, vector_codes
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limits(token_counts.histogram(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.write_and_read(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, shifted)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_token_counts, op3_quality, op4_simhash, op5_decontamination, op6_media, op7_licences, op8_language_model, op9_token_output, op10_toxicity, op11_hard_negatives, op12_ngram_join, op13_vector_codes)}

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_VALID = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"


def _scaled(scale: int) -> str:
    return f"list_transform(embedding, lambda c: floor({scale} * CAST(c AS DOUBLE)))"


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assignment and averaging; distances and indexes are minimised as one number."""
    with_parts = f"""
v AS (SELECT vec_id, label, {_scaled(1024)} AS x FROM embeddings WHERE {_VALID}),
p AS (SELECT vec_id, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < {entries})"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, CAST(min(d * {entries} + entry) AS BIGINT) AS best
  FROM (SELECT p.vec_id, p.part, p.x, c.entry, list_dot_product(p.x, p.x) + list_dot_product(c.x, c.x) - 2 * list_dot_product(p.x, c.x) AS d
        FROM p JOIN c{r} c USING (part)) GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT part, entry, list(s ORDER BY i) AS x FROM (
  SELECT part, best % {entries} AS entry, i, floor(sum(x[i]) / count(*)) AS s FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY ALL) GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (part, entry))""")
    return f"""WITH {",".join([with_parts, *steps])},
coded AS (SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(CAST(CAST(s AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), book"""


ORACLES = {
    "op5_decontamination": f"""
WITH items AS (SELECT item_id, regexp_extract_all({_FOLD}, {_ALNUM}) AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
         FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, {_ALNUM}) AS w FROM documents),
seen AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
         FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wins))),
hits AS (SELECT s.r, s.i, s.n, v.item_id FROM seen s JOIN wins v ON s.n = v.n AND s.win = v.win),
spots AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN spots USING (r) LEFT JOIN named USING (r)""",
    "op11_hard_negatives": f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_scaled(256)} AS x
  FROM embeddings WHERE label IS NOT NULL AND {_VALID}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
    "op12_ngram_join": f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, {_SPACED}) AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM docs WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
shared AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.r < y.r GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM docs UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM docs LEFT JOIN n USING (r) JOIN (SELECT a AS r, min(d.doc_id) AS component_id FROM reach JOIN docs d ON d.r = b GROUP BY a) USING (r)""",
    "op13_vector_codes": _codes_sql(),
}
