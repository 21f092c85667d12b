"""Queries of the training-data operators, as the driver runs them, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, html_extract, langid, license_scan, packing, sharding, simhash, substring_dedup, toxicity
from .shared import id_crc, table, text_or_empty

SHARDS = 24


def op1_hypergeometric_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law of row counts; equal texts are not kept together."""
    raw = F.encode(text_or_empty("text"), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text_or_empty("text")) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return sharding.shard(docs, SHARDS).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 34], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM rep),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
         FROM words ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(id_crc("doc_id"), F.lit(5))
    model = langid.train(langid.sample(docs.where(fold != 0)))
    out = langid.predictions(docs, model)
    return out.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def op7_mss_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = F.pmod(id_crc("doc_id"), F.lit(4)) != 2
    model = toxicity.fit(docs.where(learn), labels.where(learn))
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", (F.pmod(id_crc("doc_id"), F.lit(4)) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
grams AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS g
          FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM b WHERE len(ws) > 0)),
win AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS g
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM grams) WHERE len(ws) >= n)),
found AS (SELECT doc_id, s, win.n, item_id FROM win JOIN grams USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM found) GROUP BY doc_id),
who AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)
"""


QUERIES = {f.__name__: f for f in (op1_hypergeometric_shard, op2_recompression_dedup, op3_ppm_language, op4_license_rules, op5_simhash_gray, op6_exact_dedup, op7_mss_extract, op8_decontaminate, op9_lp_packing, op10_subword_toxicity)}
SQL = {"op2_recompression_dedup": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op8_decontaminate": OP8_SQL}
