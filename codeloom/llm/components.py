"""Connected components by alternating large-star and small-star steps, on DataFrames only; of few links, in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large(edges: DataFrame) -> DataFrame:
    both = stage(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    down = stage(down, "down")
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    hooked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, root): the smallest node that each linked node reaches.

    Nodes are longs; links are undirected; self-links and nulls are ignored; a
    node without links isn't returned. The number of rounds is logarithmic in
    the longest chain. Both joins have exchanges on either side, so adaptive
    execution splits the links of a hot node over tasks.
    """
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    seen = _fingerprint(edges)
    while seen[0]:
        edges = stage(_small(_large(edges)), "star")
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (u, v) to (node, root), by union and find; the smaller root stays."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in (list(parent), [find(x) for x in list(parent)])], names=["node", "root"])


def few_components(edges: DataFrame) -> DataFrame:
    """As ``components``, by one task that holds all links: for a number of links that the caller has bounded."""
    return edges.select("u", "v").where("u <> v").repartition(1).mapInArrow(_joined, "node long, root long")
