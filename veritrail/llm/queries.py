"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import (
    bpe, filter_audit, fingerprint, html_text, langid, neardup, pfair, secret_scan, sharding, simhash, token_alignment, toxicity, word_bpe,
)
from veritrail.llm.common import table

TOKENIZER = "byte_bpe_50k.tiktoken"


def public_codec(name: str = TOKENIZER) -> bpe.Codec:
    import public_tokenizers

    return bpe.codec_for(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a mix whose weights follow the square root of each source's size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    mixed = pfair.mix(docs, pfair.tempered_weights(docs))
    return mixed.select("doc_id", "source", *[F.col(c).alias(c.removeprefix("mix_")) for c in pfair.OUT])


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_codec())


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = word_bpe.vocabulary_of(public_tokenizers.path("byte_bpe_50k.json"))
    return word_bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(table(spark, sf_dir, "documents"), *public_sides())


def public_sides() -> tuple[token_alignment.ByteLevelSide, token_alignment.PieceSide]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return token_alignment.ByteLevelSide(a.read()), token_alignment.PieceSide(b.read())


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_main_text, op3_near_vectors, op4_simhash_dedup, op5_fingerprints, op6_secret_scan, op7_toxicity,
        op8_shards, op9_language_id, op10_byte_bpe, op11_word_bpe, op12_token_alignment, op13_filter_audit, pipeline,
    )
}

#: Hashing, merges, trained models, random permutations and page rules are not expressible in SQL; tests hold
#: those queries against brute force. Near vectors are: every pair of a label, and the smallest id reachable.
LLM_SQL: dict[str, str] = {
    "op13_filter_audit": filter_audit.AUDIT_SQL,
    "op3_near_vectors": """
WITH RECURSIVE vecs AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, p.b FROM reached r JOIN pairs p ON r.other = p.a),
classes AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY 1),
links AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM classes LEFT JOIN links USING (vec_id)""",
}
