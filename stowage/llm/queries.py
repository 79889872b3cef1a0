"""The registered queries of the operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import merkle, source_mix, vector_codes
from stowage.llm.additive_quant import nearest
from stowage.llm.common import table
from stowage.llm.decontaminate import contamination
from stowage.llm.license_scan import duckdb_sql, license_scan
from stowage.llm.ngram_join import jaccard_components
from stowage.llm.html_text import main_text
from stowage.llm.lang_id import predict
from stowage.llm.packing import best_fit_packing
from stowage.llm.pii import pseudonyms
from stowage.llm.token_counts import byte_vocabulary, token_counts
from stowage.llm.toxicity import held_out_sql, toxicity


def pseudonym_key(spark: SparkSession) -> bytes:
    """The secret that the session sets under spark.stowage.pseudonymKey; without one, an example key that protects nothing."""
    return spark.conf.get("spark.stowage.pseudonymKey", "stowage example key").encode()


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match counts over the public byte-level vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), byte_vocabulary(tokenizer_path("byte_bpe_50k.json")))


def op3_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, 100 * intersection >= 90 * union."""
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens of the public word-end BPE; token 1 ends each document."""
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the documents with crc32(doc_id) mod 4 other than 2; all documents are predicted."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.expr(held_out_sql("doc_id", 4, 2))
    found = predict(docs, docs.where(~F.coalesce(held_out, F.lit(False))))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dice 0.8 over word bigrams, lines and whole texts against the notices of TEMPLATES."""
    return license_scan(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 benchmark words."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers, dates and addresses permuted within their format."""
    return pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labelled documents with crc32(doc_id) mod 5 other than 0; all documents are scored."""
    found = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.expr(held_out_sql("doc_id", 5, 0)).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3 in turn; no document comes more than 3 times."""
    plan = source_mix.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 parts of 64 entries, two rounds, components times 256."""
    found, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree per source and one over all; documents with an even crc32 of their id are tampered with, by deleting line ends."""
    fields = lambda text: merkle.leaf_digest(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(even & F.col("text").contains("\n"), fields(F.replace("text", F.lit("\n"), F.lit(""))))
    leaves = table(spark, sf_dir, "documents").select("doc_id", "source", fields(F.col("text")).alias("leaf"), changed.alias("changed"))
    found = merkle.manifest(leaves, "leaf", "source", ["doc_id"]).withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (op1_page_text, op2_token_counts, op3_additive_quantisation, op4_ngram_jaccard, op5_best_fit_packing, op6_language_id, op7_license_scan, op8_decontaminate, op9_pseudonyms, op10_toxicity, op11_source_mix, op12_vector_codes, op13_merkle_manifest)}
ORACLE: dict[str, str] = {"op7_license_scan": duckdb_sql(), "op11_source_mix": source_mix.duckdb_sql(), "op12_vector_codes": vector_codes.duckdb_sql(), "op13_merkle_manifest": merkle.duckdb_sql()}
