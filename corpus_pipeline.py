"""A training corpus from raw documents, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame; ``run`` writes it as Parquet and gives the reread table to the
next one.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, mixing, packing, repeats, simhash
from tessera.llm.queries import tokenizer_path
from tessera.sources.shared import forgotten, scratch, small_batches, written

#: Near duplicates: five-word shingles, Jaccard similarity of at least 0.8 on whole texts.
#: 0.8 means about 39 of 256 differing bits, give or take 6, and 10 of 64, give or take 3:
#: 60 of all and 13 in one of two words propose a pair.
NEAR = {"shingle": 5, "radius": 13, "words": 4, "whole_radius": 60, "searched": 2, "similarity": 0.8}
#: The shortest run of words that counts as repeated: more than 50.
REPEATED_WORDS = 51


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the rejected go."""
    return language.accepted_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return simhash.representatives(docs, **NEAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of more than 50 words that occur elsewhere."""
    cut = repeats.removed_word_runs(docs, words=REPEATED_WORDS)
    return cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per document and pass that takes words of it."""
    mixed = mixing.mixed_rows(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096 ids."""
    return packing.packed_pieces(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's intermediate tables go when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark), small_batches(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if before is not None:
            forgotten(before)
        before = docs
    return docs


#: Model fitting, hashing to sketches and packing have no SQL form.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
