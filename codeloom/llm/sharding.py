"""Weighted rendezvous hashing of record keys to shards.

Each shard draws u in (0, 1) from a hash of (key, shard); the shard with the
least -ln(u) / weight takes the record. A further shard can only take records
into itself, and each shard's share follows its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

SHARDS = 8


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of a key; a null key is a key like any other."""
    best = None
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
        draw = (-F.log((bits.cast("double") + 0.5) / float(1 << 53)) / weight).alias("draw")
        one = F.struct(draw, F.lit(shard).alias("shard"))
        best = [one] if best is None else [*best, one]
    return F.array_min(F.array(*best))["shard"]


def sharded(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    doc_id and the number of shards alone decide the shard; grown_shard is that
    with one more shard of mean weight. Slots are gapless from 0 in each shard.
    Null text: as empty. Rows with a null doc_id go to one shard, as do rows
    that repeat a doc_id. An empty table gives no rows; other columns are
    ignored.
    """
    weights = weights or [1.0] * SHARDS
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, sum(weights) / len(weights)]).alias("grown_shard"),
    )
    return numbered(rows, "shard", "doc_id", "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
