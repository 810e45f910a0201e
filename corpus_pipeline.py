"""From raw documents to token ids: a clean, deduplicated and mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and reads
it back as the next one's docs. All stages but the last return the columns of ``documents``.

Defined results of all stages: a null text is an empty one; empty texts are kept by every stage; a text of any length is
read whole; rows without doc_id are kept; an empty table gives an empty one; further columns of ``docs`` pass through the
first four stages under their names, whatever these are, and the last stage returns only its own columns. Repeated rows and
ties: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import bpe, mixing, simhash, substring, toxicity
from rillflow.llm.storage import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model trained on the labels takes for toxic go. Repeated rows score alike; a score of 0.5 goes."""
    return toxicity.clean_only(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, with all rows of that doc_id."""
    return simhash.keep_first(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has are cut out; rows of one doc_id never cut each other."""
    return substring.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to the target weights, once for each epoch that takes them; repeated rows are drawn each."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    coded = bpe.transcode(docs.select("doc_id", "lang", "source", "text"), ["ids__", "decoded__"])
    same = F.col("decoded__") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids__").cast("long").alias("n_tokens"), same.alias("round_trip"), F.col("ids__").alias("ids"))


STAGES = [("toxicity", toxicity_stage), ("simhash", simhash_stage), ("substring", substring_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: Learnt scores, fingerprints by XXH64 and byte-pair merges have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
