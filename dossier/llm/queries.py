"""The registered queries of the corpus operators: thin calls that give the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .block_topk import top_products
from .byte_cnn import fit_quality, quality
from .hard_negatives import hard_negatives
from .hnsw import nearest
from .labelled import held_out
from .mixing import mix_sources
from .near_dup import near_duplicates
from .piece_sampling import sample_pieces
from .ranked_search import ranked_search
from .repeats import remove_repeats
from .sharding import shard_documents
from .storage import short_batches
from .string_kernel import fit_languages, language
from .token_files import read_token_files, write_token_files
from .warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    out = shard_documents(_table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source targets."""
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in packed files, read back."""
    path, files = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), vocab=50_257)
    return read_token_files(spark, path, files)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every whole text; the model never sees labels of held-out ids."""
    short_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    out = held_out("doc_id", 3, 1)
    model = fit_quality(docs, _table(spark, sf_dir, "labels"), ~out)
    scored = docs.select("doc_id", out.alias("held_out"), quality(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every whole text, with inclusion scores, decoded again."""
    return sample_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; the model never sees held-out documents."""
    short_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    model = fit_languages(docs, ~out)
    return docs.select("doc_id", out.alias("held_out"), language(model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back by the salvage reader."""
    path, files = write_warc(_table(spark, sf_dir, "pages"), min_bytes=0)
    return read_warc(spark, path, files, payload=False).where("kind = 'record'").select(
        F.col("record_id").try_cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of four-word shingles are 80 % alike."""
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query vector's ten nearest, by graph search."""
    return nearest(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query vector's ten largest integer inner products."""
    return top_products(_table(spark, sf_dir, "embeddings"), k=10, scale=1024, every=100)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each anchor's positives and, for each, its ten best negatives; every seventh row has a wrong label by contract."""
    rows = _table(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for each benchmark item."""
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages of twenty words and more that are found earlier."""
    return remove_repeats(_table(spark, sf_dir, "documents"), words=20).drop("removed")


OP10_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, {TERMS_SQL} AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), c AS (
  SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0
), g AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM c
), i AS (
  SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM c) WHERE term IN (SELECT term FROM i) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, g GROUP BY term
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term), g GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), x AS (
  SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i : i + 19], ' ') END AS win FROM t
), r AS (
  SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS later FROM x
), c AS (
  SELECT doc_id, i, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r
), k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM c GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_token_files": op2_token_files,
        "op3_quality": op3_quality,
        "op4_mixing": op4_mixing,
        "op5_pieces": op5_pieces,
        "op6_language": op6_language,
        "op7_warc": op7_warc,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_nearest": op9_nearest,
        "op10_top_products": op10_top_products,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_ranked_search": op12_ranked_search,
        "op13_repeats": op13_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_top_products": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_repeats": OP13_SQL}
