"""The corpus pipeline: toxicity, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet below the shared folder and reads it back as the next
stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.minhash import near_duplicates
from codeloom.llm.mixing import mixed
from codeloom.llm.packing import pack
from codeloom.llm.pii import redacted
from codeloom.llm.queries import MIX_WEIGHTS, tokenizer_path
from codeloom.llm.shared import stage, table
from codeloom.llm.toxicity import scores

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of their language."""
    verdict = scores(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), extra=COLUMNS)
    return verdict.where(~F.col("flagged")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; empty ones are no duplicates."""
    gone = stage(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    return redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix: file by file, row by row."""
    return mixed(docs.select(*COLUMNS), MIX_WEIGHTS).repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("pii", pii), ("mix", mix), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs


#: The classifier, the trees and the tokenizer can't be put in SQL; tests compare each stage with a plain version.
ORACLE_SQL: dict[str, str] = {}
QUERIES = {"pipeline": run}
