"""A corpus pipeline of five stages over ``documents``.

quality classifier -> SimHash near-duplicates -> benchmark decontamination -> secret scan -> BPE.
Each stage takes all rows that the one before kept; a stage's table is written as Parquet before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, decontaminate, quality, secret_scan, simhash
from lattica.llm.common import fold, kept, prepare, small, table, without
from lattica.llm.queries import tokenizer_path

#: The row's own key, for joins back to the texts: an id may be null or repeated.
KEY = "__row_key"

#: Characters whose new words the last stage encodes together: half of what the operator takes, for workers of a session that four stages have used.
TOKEN_CHUNK = 500_000


def _key() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score below 0.5; labels of the held-out fold are not learnt from.  Empty texts are scored too."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    return quality.keep_good(docs, quality.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group, that of smallest id; rows with a null id stay.

    Rows of one id are told apart by their texts, so that only equal or similar texts of an id are dropped.  Rows that
    go are named by their keys; texts stay where they stand, and are only exchanged where a whole row repeats.
    """
    prepare(spark)
    rows = docs.withColumn(KEY, _key())
    groups = kept(simhash.verified_groups(rows, row=KEY).where("id is not null"))
    first = groups.groupBy("component").agg(F.min(F.struct("id", "row"))["row"].alias("first"))
    dropped = kept(groups.join(first, "component").where("row <> first").select(F.col("row").alias(KEY)).distinct())
    repeated = groups.groupBy(F.col("row").alias(KEY)).count().where("count > 1").select(KEY)
    repeated = kept(repeated.join(dropped, KEY, "left_anti"))
    left = without(rows, kept(dropped.union(repeated)), KEY)
    if repeated.limit(1).count():
        left = left.unionByName(rows.join(small(repeated), KEY, "left_semi").dropDuplicates([KEY]))
    return left.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    prepare(spark)
    rows = docs.withColumn(KEY, _key())
    found = kept(decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), KEY).select(F.col("id").alias(KEY)))
    return without(rows, found, KEY).select(*docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every reported secret by a mark; n_chars of such a document is its new length."""
    prepare(spark)
    return secret_scan.without_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): each text's token ids (little-endian, 32 bits each) and the text that they decode to."""
    prepare(spark)
    return bpe.encode_decode(docs, tokenizer_path(), chunk=TOKEN_CHUNK).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_redaction),
    ("bpe", tokens),
]

#: A trained classifier, fingerprint trees and a tokenizer are not SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages a table in the shared folder."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
