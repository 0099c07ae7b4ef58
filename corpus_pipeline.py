"""A training corpus from raw documents: quality, repeated lines, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
DataFrame; a runner writes it as Parquet and reads it again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lines, minhash, packing, quality, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.keep_rows(docs).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates."""
    return _with_text(lines.dedup_lines(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return minhash.keep_first(docs).select(*COLUMNS)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 bytes and more that an earlier document has. Bytes of a character that a removed passage cut go with it."""
    # the other columns go through with their row: ids may be null or repeated
    removed = suffix_dedup.dedup_substrings(docs, 50, F.to_json(F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))))
    # a kept half of a character becomes a replacement character, which goes; whole texts stay as they are
    whole = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")
    text = F.when(F.col("n_removed") > 0, whole).otherwise(F.col("kept").cast("string"))
    rest = F.from_json("tag", "lang string, source string")
    return _with_text(removed.select("doc_id", text.alias("text"), rest["lang"].alias("lang"), rest["source"].alias("source")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    import public_tokenizers

    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("suffix-array dedup", dedup_passages),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests hold each stage against brute force (the classifier against its own verdicts, packing by its ids).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
