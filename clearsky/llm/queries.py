"""The operators over the driver's whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from clearsky.llm import (
    bpe,
    decontamination,
    divergence,
    exact_dedup,
    jaccard_join,
    language,
    packing,
    pii,
    quality,
    ranked_search,
    sharding,
    substring_dedup,
    toxicity,
)
from clearsky.llm.base import crc_of_id, documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is the host, the language section its path."""
    docs = documents(spark, sf_dir)
    classifier = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, classifier, F.col("source"), F.col("lang"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contaminated(documents(spark, sf_dir), benchmark)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_documents(documents(spark, sf_dir), ranks)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_of_id(F.col("doc_id")) % 3 == 1
    model = language.fit(docs.where(~held_out))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(documents(spark, sf_dir))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(documents(spark, sf_dir), k=4, percent=85)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_of_id(F.col("doc_id")) % 4 == 2
    grammar = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    return toxicity.score(docs, grammar).withColumn("held_out", held_out)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_language": op6_language,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_toxicity": op10_toxicity,
    "op11_divergence": op11_divergence,
    "op12_bpe": op12_bpe,
    "op13_ranked_search": op13_ranked_search,
    "pipeline": corpus_pipeline.run,
}

_OP7 = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT *, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) AS nth
  FROM t
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""

_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents
), t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d
), kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
tot AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS nn FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT tot.lang, tot.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (nn + v) AS p
  FROM tot JOIN kept k ON k.lang = tot.lang JOIN v ON v.lang = tot.lang
  LEFT JOIN c ON c.lang = tot.lang AND c.source = tot.source AND c.term = k.term
), lp AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(ln) + any_value(v)) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(nn) AS ln FROM tot GROUP BY lang) USING (lang) GROUP BY lang, term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN lp USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_OP13 = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY r, doc_id, term),
d AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM i) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, s),
sc AS (
  SELECT item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN tf USING (term) JOIN w USING (term) JOIN d USING (r), s
  GROUP BY item_id, r, doc_id
), k AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS nth FROM sc WHERE score > 0
)
SELECT item_id, nth::INT AS rank, doc_id, score FROM k WHERE nth <= 10
"""

ORACLES: dict[str, str] = {"op7_exact_dedup": _OP7, "op11_divergence": _OP11, "op13_ranked_search": _OP13}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
