"""The queries of the operators for training text, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobsieve.llm import alignment, centroids, decontaminate, fingerprints, langid, licenses, neardup, oracle, packing, quality, sharding, suffix_dedup, toxicity, warc
from jobsieve.llm.common import read_table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak, at a similarity of 0.8 or more of five-word shingles."""
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    return warc.derive(warc.responses(read_table(spark, sf_dir, "pages")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op4_sampled_splitter_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"), shards=8)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from two thirds of the labels."""
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), threshold=0.7)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents under a model of the trusted ones."""
    return quality.classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity of 0.85."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, threshold=85)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), path, end_id=1, limit=4096)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that smaller ids already hold in strings of 50, removed."""
    cut = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), span=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from two thirds of them."""
    return langid.identify_languages(read_table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components in 40 clusters after 5 rounds."""
    assigned, clusters = centroids.cluster_vectors(read_table(spark, sf_dir, "embeddings"), k=40, rounds=5)
    hashed = clusters.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256))
    return assigned.join(F.broadcast(hashed.drop("centroid", "n")), "cluster").select(  # at most 40 rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two public tokenizers aligned in all documents."""
    ranks, pieces = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokenizers(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, pieces)[0]


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_license_scan": op3_license_scan,
    "op4_sampled_splitter_sharding": op4_sampled_splitter_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_language_id": op11_language_id,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}
ORACLE = {
    "op1_benchmark_decontamination": oracle.leak_sql(),
    "op2_warc_derivatives": oracle.warc_sql(),
    "op3_license_scan": oracle.license_sql(),
    "op6_document_fingerprints": oracle.fingerprint_sql(),
    "op8_minhash_near_dedup": oracle.near_sql(),
    "op12_centroid_clustering": oracle.centroid_sql(),
}
