"""From raw documents to a training mixture: five stages, each a corpus operator, each written before the next.

Stage 1 drops documents that the line field rejects, stage 2 keeps the document with the smallest id of each group of near
copies, stage 3 drops documents that hold benchmark passages, stage 4 puts kinds in place of personal data, and stage 5
samples to target weights and adds weights. All but the last keep the columns of ``docs`` as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesmith.llm import crf, decontaminate, mixing, near_texts, pii
from tablesmith.llm.common import free_shuffles, written
from tablesmith.plans.base import query, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold; all if ``labels`` has not both labels."""
    return crf.keep_good(docs, crf.train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    free_shuffles(spark)
    return near_texts.drop_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with kinds in place of personal data; n_chars follows the new text."""
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents with topic, tokens, weight and the probability they were drawn with.

    Columns of the caller's named topic, n_tokens, weight, probability or repeat (or so with a leading underscore) are replaced.
    """
    mixed = mixing.mix(docs).where("_kept")
    added = {"_topic": "topic", "_tokens": "n_tokens", "_weight": "weight", "_probability": "probability", "_repeat": "repeat"}
    own = [c for c in docs.columns if c not in {*added, *added.values(), "_source", "_lang", "_kept"}]
    return mixed.select(*own, *[F.col(a).alias(b) for a, b in added.items()])


STAGES = [
    ("quality", quality), ("near_copies", near_copies), ("benchmark", benchmark), ("personal_data", personal_data), ("mixture", mixture)]
#: The line field and XXH64 fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def register() -> None:
    query("pipeline", ORACLE_SQL)(run)
