"""The registered queries of the operators: production parameters, whole tables, whole results."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fingerprints, language, negatives, packing, pii, quality, repeats, sharding, simhash, urls, whitening
from .common import read


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file: below ``$TOKENIZERS_DIR`` if set, else in the installed package."""
    folder = os.environ.get("TOKENIZERS_DIR") or os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(folder, name)


# Key of the surrogates; a production run passes its own secret.
SURROGATE_KEY = os.environ.get("SURROGATE_KEY", "surrogates-1")

URL_RULES = [
    urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/"),
]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.without_repeats(read(spark, sf_dir, "documents"), depth=200, with_kept=False)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 5, 0.8)
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.replaced(read(spark, sf_dir, "documents"), SURROGATE_KEY)
    return done.select("doc_id", "text", "n_entities", F.to_json("entity_types").alias("entity_types"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.best_fit(read(spark, sf_dir, "documents"), vocabulary(), size=2048, end_id=0, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(sharding.sized(read(spark, sf_dir, "documents")), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_windows(turns, vocabulary(), budget=512, history=2), in_order=True)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whitening.whitened(read(spark, sf_dir, "embeddings"), components=4, scale=256)
    return done.withColumn("deviation", F.col("deviation").cast("long"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_of_edits(read(spark, sf_dir, "documents"), shingle=5, parts=4)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_decontamination, op3_pii_surrogates, op4_language_id, op5_best_fit_packing, op6_url_filter, op7_byte_shards,
    op8_chat_windows, op9_quality_rules, op10_simhash, op11_whitening, op12_fingerprints, op13_hard_negatives)}

ORACLES = {
    "op2_decontamination": """
WITH plain AS (
  SELECT 'd' AS side, doc_id AS id, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM documents
  UNION ALL
  SELECT 'i', item_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) FROM benchmark
), listed AS (
  SELECT side, id, string_split(t, ' ') AS w FROM plain WHERE t <> ''
), shingled AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM listed WHERE len(w) >= 5
), sizes AS (
  SELECT id AS item_id, count(*) AS n_shingles FROM shingled WHERE side = 'i' GROUP BY id
), shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM shingled d JOIN shingled i ON d.s = i.s WHERE d.side = 'd' AND i.side = 'i' GROUP BY ALL
)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared / n_shingles >= 0.8 - 1e-9
""",
    "op13_hard_negatives": """
WITH numbers AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS alike, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM numbers a JOIN numbers b ON a.id <> b.id WHERE a.id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER best <= 10
""",
    "op12_fingerprints": f"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS n FROM documents
), edits AS (
  SELECT a.place, a.doc_id, a.text, b.place AS next, length(a.text) AS n_chars,
    substr(a.text, 1, length(a.text) - length(a.text) // 2) || substr(b.text, 1, length(a.text) // 2) AS edited
  FROM rows a JOIN rows b ON b.place = a.place % a.n + 1
), plain AS (
  SELECT 'own' AS kind, place, text AS t FROM edits UNION ALL SELECT 'edited', place, edited FROM edits
), listed AS (
  SELECT kind, place, list_filter(string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM plain
), hashed AS (
  SELECT kind, place, list_transform(w, lambda x: CAST('0x' || substr(md5(x), 1, 15) AS HUGEINT)) AS h FROM listed
), shingles AS (
  SELECT DISTINCT kind, place, (
    {" + ".join(f"coalesce(h[i + {k}] * {number}, 0)" for k, number in enumerate(fingerprints.factors(5)))}
    ) % 18446744073709551616 AS s
  FROM (SELECT kind, place, h, unnest(range(1, greatest(2, len(h) - 3))) AS i FROM hashed WHERE len(h) > 0)
), kept AS (
  SELECT kind, place, s FROM shingles
  QUALIFY s < 4611686018427387904 OR s = min(s) OVER (PARTITION BY kind, place)
), sketches AS (
  SELECT kind, place, count(*) AS size, string_agg(printf('%016x', CAST(s AS UBIGINT)), '' ORDER BY s) AS f,
    list(s) AS hashes FROM kept GROUP BY kind, place
), judged AS (
  SELECT e.*, coalesce(o.f, '') AS fingerprint, coalesce(c.f, '') AS edited_fingerprint,
    CASE WHEN o.size IS NULL OR c.size IS NULL THEN CAST(o.size IS NULL AND c.size IS NULL AS DOUBLE)
      ELSE len(list_intersect(o.hashes, c.hashes)) / least(o.size, c.size) END AS near_edited,
    CASE WHEN o.size IS NULL OR x.size IS NULL THEN CAST(o.size IS NULL AND x.size IS NULL AS DOUBLE)
      ELSE len(list_intersect(o.hashes, x.hashes)) / least(o.size, x.size) END AS near_next
  FROM edits e LEFT JOIN sketches o ON o.kind = 'own' AND o.place = e.place
    LEFT JOIN sketches c ON c.kind = 'edited' AND c.place = e.place
    LEFT JOIN sketches x ON x.kind = 'own' AND x.place = e.next
)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next FROM judged
""",
}
