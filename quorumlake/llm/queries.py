"""The registered queries ``opN_<name>`` of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, id_crc, table

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .matroska import media_digest, text_media

    return media_digest(text_media(table(spark, sf_dir, "documents")))


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import shard_documents, write_shards

    return shard_documents(write_shards(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), Scratch(spark)))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls, rules_frame

    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark, URL_RULES))


OP5_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path,
  (SELECT max_by(u.host || u.path, length(u.host || u.path)) FROM rules u WHERE (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path)) AS rule,
  coalesce((SELECT max_by(u.verdict, length(u.host || u.path)) FROM rules u WHERE (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path)), 'allow') AS verdict
FROM parts p
"""


def fold(n: int, k: int) -> Column:
    """Whether a row is in fold k of n by the crc32 of its doc_id."""
    return F.pmod(id_crc("doc_id"), F.lit(n)) == k


def quality_model(spark: SparkSession, sf_dir: str):
    from .quality import fit

    return fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~fold(5, 0)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir)).select("doc_id", fold(5, 0).alias("held_out"), "score", "predicted")


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_fst import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def language_model(spark: SparkSession, sf_dir: str):
    from .lang_mix import fit

    return fit(table(spark, sf_dir, "documents").where(~fold(4, 2)))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_mix import predict

    return predict(table(spark, sf_dir, "documents"), language_model(spark, sf_dir)).select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .itq_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight 1 for documents labelled good, 1/4 for others; ``mix_sources`` gives unlabelled ones 1."""
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, 0.25).otherwise(1.0).alias("w"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir)).drop("copies")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    -ln((('0x' || substr(md5('mix-1' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / coalesce((SELECT max(CASE WHEN l.quality = 0 THEN 0.25 ELSE 1.0 END) FROM labels l WHERE l.doc_id = documents.doc_id), 1.0) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
l AS (SELECT *, sum(source_size) OVER () * 3 AS budget,
    coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4 AS capped,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM w WINDOW o AS (ORDER BY source_size / w, source ASC NULLS LAST)),
c AS (SELECT *, source_size * 4 * w_left <= (budget - capped) * w AS cap FROM l),
v AS (SELECT budget - capped AS left_, w_left FROM c WHERE NOT cap ORDER BY source_size / w, source ASC NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN cap THEN (source_size * 2)::DOUBLE ELSE (SELECT left_ FROM v)::DOUBLE * w / ((SELECT w_left FROM v) * 2) END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS left_,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (epochs + CASE WHEN 2 * before + size <= 2 * left_ THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op10_mix_sources": OP10_SQL}
