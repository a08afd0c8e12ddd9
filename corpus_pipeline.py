"""A corpus from documents to packed sequences, stage by stage.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; what it returns is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightgrid.llm import decontaminate, languages, nearcopies, packing
from nightgrid.session import write_once


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; those without text or letters, and those it is unsure of, go."""
    model = languages.learn(docs.select("doc_id", "text", "lang"))
    return languages.identify(docs, model, into="_language").where("_language.accepted").drop("_language")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one with the smallest doc_id.

    Near-copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    Of repeated rows of that doc_id one stays. A group in which no document has an id is left as it is.
    """
    return nearcopies.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs within its edit budget."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, packed into sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

# Learned languages, fingerprint groups, edit distances and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
