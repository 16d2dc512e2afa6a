"""From raw documents to token ids: language, repeated lines, near copies, source mix, piece encoding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeline.llm import language, line_dedup, mixing, pieces, simhash
from breezeline.session import materialise


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters or with an undecided language go."""
    return language.with_known_language(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that a smaller document has."""
    return line_dedup.without_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs, shingle_words=3, max_bits=2)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that the mix took: doc_id, source, n_tokens, ids (little-endian unsigned 32-bit)
    and whether decoding them gives the text back."""
    model = pieces.read_model(spark, public_tokenizers.path("piece_bpe_32k.model"))
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.translate(text, pieces.SPACE, " ").cast("binary"), 256)
    done = pieces.encode_and_decode(docs, model, F.col("doc_id"), F.col("source"), digest.alias("digest"))
    back = F.sha2(F.col("decoded").cast("binary"), 256) == F.col("digest")
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return done.select("doc_id", "source", n_tokens.alias("n_tokens"), "ids", back.alias("round_trip"))


STAGES = [
    ("known language", known_language),
    ("repeated lines", repeated_lines),
    ("near copies", near_copies),
    ("source mix", source_mix),
    ("piece ids", piece_ids),
]

# Fingerprints, hash thresholds and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
