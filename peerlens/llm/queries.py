"""The text operators as registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.session import scratch_path

from . import (
    decontamination, fuzzy_passages, hard_negatives, language_id, mixing, phrases, pii, quality, recurrent_lm, sharding,
    substring_removal, tokens,
)
from .ngram_join import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Other operators learn a model, sample, cut trees or search strings in ways that plain
# SQL does not express or not at this size; tests compare them with brute force.
SQL["op9_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""

SQL["op12_era_phrases"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
one AS (SELECT lang, ws[i] AS x, count(*) AS f FROM g GROUP BY ALL),
two AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, count(*) AS f FROM g WHERE i + 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z, count(*) AS f FROM g WHERE i + 2 <= len(ws) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
cut AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, 1 AS k, p.f AS l, q.f AS r
  FROM two t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN one q ON q.lang = t.lang AND q.x = t.y
  WHERE NOT EXISTS (
    SELECT 1 FROM three h WHERE h.lang = t.lang AND 100 * h.f >= 50 * t.f AND ((h.x = t.x AND h.y = t.y) OR (h.y = t.x AND h.z = t.y)))
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, p.f, q.f
  FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, p.f, q.f
  FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z
), scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cut),
least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
FROM least_cut JOIN n USING (lang) QUALIFY rank <= 2000
"""
SQL["op13_hilbert_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


def query(run):
    QUERIES[run.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing every repeated 400-byte string leaves of each document."""
    return substring_removal.removal_digest(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


@query
def op2_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 40 words or more that documents share, 75 % of their words equal."""
    return fuzzy_passages.find_fuzzy_passages(documents(spark, sf_dir))


@query
def op3_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang").withColumn(
        "size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    ).withColumn("text_crc32", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    return sharding.shard_documents(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op4_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    model = language_id.train_language_model(docs.where(~language_id.held_out()))
    return language_id.predict_languages(
        docs.select("doc_id", language_id.held_out().alias("held_out"), "text"), model
    ).drop("text")


@query
def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and those that the trees add."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.find_pii(docs, pii.train_pii_model(docs))
    of = lambda kind: F.filter("pii", lambda x: x["base"] & (x["kind"] == kind))
    return found.select(
        "doc_id", *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.spans_text(F.filter("pii", lambda x: x["base"])), 256).alias("base_sha256"), pii.spans_text(F.col("pii")).alias("spans"),
    )


@query
def op6_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to shards and read back from them."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    tokens.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_boundaries(spark, path)


@query
def op7_cube_sampling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    key = F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")
    copies, targets = mixing.sampled_mix(documents(spark, sf_dir), key=key)
    of = targets.withColumnRenamed("source", "of")
    return copies.join(of, copies.source.eqNullSafe(of.of)).select(
        F.decode("key", "UTF-8").try_cast("long").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source",
    )


@query
def op8_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality signals of every document and the verdict of its group's thresholds."""
    return quality.judge_quality(documents(spark, sf_dir).select("doc_id", "text", "lang", "source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 75 % of their five-word shingles."""
    return near_duplicates(documents(spark, sf_dir))


@query
def op10_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which passages of benchmark items occur, with the best place of each item."""
    return decontamination.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op11_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document under unigrams and under the recurrent model."""
    of_id = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10))
    docs = documents(spark, sf_dir).select("doc_id", (of_id == 0).alias("held_out"), "text")
    return recurrent_lm.score_documents(docs, ~F.col("held_out")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op12_era_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of each language."""
    return phrases.collocations(documents(spark, sf_dir))


@query
def op13_hilbert_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every hundredth vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
