"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, decontam, divergence, importance, language, minhash, pieces, repeats, secrets, simhash, surrogates, token_files, warc
from .frames import checkpoint, sha256_hex
from .oracle import ORACLE_SQL as ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.similarity_components(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_pii(docs, key="agoralake")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"), n=13)
    return kept.select("doc_id", "n_words", "n_removed", sha256_hex(F.col("kept")).alias("kept_sha256"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return found.withColumn("record", warc.record_text()).drop("block")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    return language.identify(docs, model).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.fresh_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), vocabulary=50_257, end_id=2)
    return token_files.read_digests(spark, path)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256_hex(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    same = F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False))
    return pieces.decode(coded, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"), "ids")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.plan(words=3, above=85, of=100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=30, smoothing=5, top=50)


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; n_within, for ids divisible by 100: the documents within 3 bits of its fingerprint, itself included."""
    found = checkpoint(simhash.audit(table(spark, sf_dir, "documents"), words=3))
    asked = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    counts = simhash.count_within(found, found.where(asked), radius=3)
    rows = found.where(asked).join(counts, "fingerprint", "left").unionByName(found.where(~asked), allowMissingColumns=True)
    digits = {name: simhash.hex_digits(F.col(name)) for name in ("fingerprint", "edited_fingerprint")}
    return rows.withColumns(digits).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_within")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_warc_derivatives": op5_warc_derivatives,
    "op6_token_files": op6_token_files,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_source_divergence": op11_source_divergence,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_importance_resampling": op13_importance_resampling,
}
