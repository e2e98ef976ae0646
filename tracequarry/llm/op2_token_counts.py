"""Token counts behind a digest cache.

Contents are known by the SHA-256 of their UTF-8 bytes and the tokenizer by the SHA-256 of its file. Stored counts are joined on
both; only the distinct contents without a stored count are encoded, and their counts are appended to the cache.

Nulls and empty texts have 0 tokens. Repeated rows each get their row. A null id stays null. Columns beyond id and text are not
looked at, so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, read, scratch, text_of, written

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
LIMIT = 1024
#: A content in more rows than HOT is joined by broadcast, the HOT_MOST most frequent ones at most (about 60 bytes each).
HOT, HOT_MOST = 200, 50_000


@lru_cache(4)
def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(path: str):
    """A function from texts to token counts for a .json or .model file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from .bpe import fast

    return fast(path).counts


def encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """misses (digest, text) with the count of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in chunks(batches):
            n = pa.array([int(k) for k in count(batch.column(1).to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], ["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """One row per digest that the cache has for this tokenizer; concurrent appends may have written one twice."""
    try:
        table = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        table = spark.createDataFrame([], CACHE_SCHEMA)
    return table.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; the cache at `cache` (a path all executors reach) has grown by the misses.

    Duplicates fold into one row per digest within each task before texts are shuffled, so a content that a third of all rows have
    moves once per task. The rows themselves meet the counts by digest: those of frequent contents where they lie, by a small broadcast
    table, the others by shuffle, where none has a large group.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    have = stored(spark, cache, version)
    misses = rows.select("digest", "text").dropDuplicates(["digest"]).join(have, "digest", "left_anti")
    encode_misses(misses, tokenizer).select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    listed = written(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "token-rows")
    counts = stored(spark, cache, version)
    hot = listed.groupBy("digest").agg(F.count("*").alias("k")).where(F.col("k") > HOT).orderBy(F.desc("k"), "digest").limit(HOT_MOST).select("digest")
    hot = F.broadcast(written(counts.join(F.broadcast(hot), "digest"), "token-hot"))
    told = listed.join(hot, "digest").unionByName(listed.join(hot, "digest", "left_anti").join(counts, "digest"))
    return told.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, with a cache of the run's own that starts empty."""
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-cache"))
