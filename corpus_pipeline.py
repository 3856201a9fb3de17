"""The corpus pipeline: five stages, each on all that the one before it kept.

``run(spark, sf_dir)`` applies STAGES to ``documents``. All stages but the last return the columns of
``documents``; the last returns the mix: what it takes of each document that is left.

Defined results: a row without text, or whose text has no letter, goes with the first stage, as it has no language. Repeated
rows are one group of copies. Rows with a null id are kept or dropped by their own text. A null source is a source of
its own. Extra columns of any name pass through to the last stage. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import decontam, langid, mixing, simhash, spans
from graphloom.llm.common import free_names, materialise, named, table

#: A document whose predicted language holds less of it than this is rejected.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those of which no language has at least half."""
    model = langid.train(docs)
    label, score = free_names(docs.columns, "__lang", "__score")
    found = langid.predict(docs, model, label=label, score=score)
    return found.where((F.col(label) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE)).drop(label, score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document of least id (of repeated rows, one)."""
    return simhash.keep_one(docs)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages; drops documents of which nothing is left, and counts characters anew."""
    cut = spans.dedup(docs)
    cut = cut.where((F.col("n_removed") == 0) | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, n).otherwise(F.col("n_chars")))
    return cut.select(*map(named, docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_spans),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The stages before the mix cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
