"""A corpus prepared in five stages: quality, near-duplicates, repeated passages, contamination, token ids.

Each stage works on all that the one before it kept and takes and returns the
columns of ``documents``; the last returns the ids' digests. Every row is
judged by itself, whatever its id: decisions are joined on a key of each row,
which is its id where ids are distinct and not null; else a filter writes its
input with a key of its own for each row. Empty tables give empty results.
Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmark.llm.byte_bpe import digests
from cairnmark.llm.decontaminate import contamination
from cairnmark.llm.quality import quality
from cairnmark.llm.shared import cut, written
from cairnmark.llm.simhash import near_duplicates
from cairnmark.llm.suffix_dedup import deduplicate, distinct_ids, numbered

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``, unique to each row and the same each time it is read."""
    docs = docs.select(*COLUMNS)
    if distinct_ids(docs):
        return docs.withColumn("key", F.col("doc_id").cast("long"))
    return written(docs.withColumn("key", F.monotonically_increasing_id()), "keyed")


def _by_key(keyed: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``keyed`` whose key is (left_semi) or is not (left_anti) among ``keys`` (key)."""
    return keyed.join(keys.select("key"), "key", how).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the model keep."""
    keyed = _keyed(docs)
    found = quality(keyed.select(F.col("key").alias("doc_id"), "lang", "text")).where("kept")
    return _by_key(keyed, found.withColumnRenamed("doc_id", "key"), "left_semi")


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: of those with the smallest id (null ids last) the first in the input."""
    keyed = _keyed(docs)
    ranked = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "key")
    found = near_duplicates(keyed.select(ranked.alias("doc_id"), "text"))
    return _by_key(keyed, cut(found.where("doc_id.key = component_id.key").select("doc_id.key")), "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in an earlier place too; characters are kept whole."""
    kept = deduplicate(numbered(docs.select(*COLUMNS)), whole_characters=True)
    text = F.decode("kept", "UTF-8")
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def contaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    keyed = _keyed(docs)
    found = contamination(keyed.select(F.col("key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    return _by_key(keyed, found.select(F.col("doc_id").alias("key")), "left_anti")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    import public_tokenizers

    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicate_groups", near_duplicate_groups),
    ("repeated_passages", repeated_passages),
    ("contaminated_documents", contaminated_documents),
    ("token_ids", token_ids),
]

#: The quality model, the near-duplicate components and the token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
