"""The numbered queries: each applies its operator, with production parameters, to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, centroids, decontaminate, embedding_neardup, hmm, license_scan, packing, quality, secret_scan, simhash, spelling, substring_dedup, warc
from lattica.llm.common import prepare, table
from lattica.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return embedding_neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def tokenizer_path() -> str:
    """The public vocabulary that op6 and the pipeline encode with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(docs, labels).withColumnRenamed("id", "doc_id")


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = warc.archive_folder(spark)
    manifest = warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"), secret_scan.as_text(F.col("spans")).alias("spans"))


def op10_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return hmm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def packing_tokenizer_path() -> str:
    """The public vocabulary that op12 packs with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pieces = packing.pack(table(spark, sf_dir, "documents"), packing_tokenizer_path())
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_embedding_neardup, op2_simhash_neardup, op3_substring_dedup, op4_license_scan, op5_benchmark_decontamination,
        op6_bpe_round_trip, op7_quality_classifier, op8_warc_archive, op9_secret_scan, op10_hmm_scoring,
        op11_centroid_clustering, op12_sum_of_squares_packing, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    """SQL for those that SQL can express; the others are tested against brute force in tests/llm."""
    return dict(ORACLES)
