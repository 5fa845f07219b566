"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chain, digests, formatted
from .lattice import near_vectors
from .minhash import near_duplicates
from .mixing import mixed
from .oracles import ORACLE_SQL  # noqa: F401
from .packing import pack
from .pii import report
from .quality import quality
from .sharding import sharded
from .shared import table
from .toxicity import scores
from .warc import archived

#: Target weights of the mix; a source without one has 1.
MIX_WEIGHTS = {"src0": 3.0, "src1": 2.0}
#: File name of the public tokenizer that documents are packed by.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer's file lies on this machine; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return scores(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents", "doc_id", "source"), MIX_WEIGHTS)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


#: Texts full of control strings, formatted with every run.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return digests(formatted(chain(rows.unionByName(probe)))).select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_mix_sources": op5_mix_sources,
    "op6_quality": op6_quality,
    "op7_sharding": op7_sharding,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_near_vectors": op9_near_vectors,
    "op10_chat": op10_chat,
}
