"""Building indexes: pruning, re-rooting paths, merging parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import symbols
from .model import Index


def kept_symbols(index: Index, keep_external: bool = False) -> DataFrame:
    """Symbols that stay: no variables, and defined; or with a type literal, a parameter or a call in the name.

    The second group stays whether it is a variable or not. With
    ``keep_external`` only variables go.
    """
    s = F.col("symbol")
    no_variable = symbols.not_variable_sql(s)
    if keep_external:
        return index.symbols.where(no_variable)
    shape = symbols.like(s, "%typeLiteral%") | symbols.like(s, "%).(%") | symbols.like(s, "%().%")
    defined = index.ranges.select(F.col("symbol_id").alias("id")).distinct().withColumn("defined", F.lit(True))
    rows = index.symbols.join(defined, "id", "left").where((no_variable & F.col("defined").isNotNull()) | shape)
    return rows.drop("defined")


def prune(index: Index, keep_external: bool = False) -> Index:
    """The index without symbols that the queries don't need, nor their mentions and ranges."""
    kept = kept_symbols(index, keep_external).select("id", "symbol", "display_name", "kind")
    ids = kept.select(F.col("id").alias("symbol_id"))
    return Index(index.documents.select("id", "relative_path"), index.chunks, kept, index.mentions.join(ids, "symbol_id", "left_semi").select("chunk_id", "symbol_id", "role"), index.ranges.join(ids, "symbol_id", "left_semi").select(*index.ranges.columns), index.source_lines)


def reroot(index: Index, prefix: str | None) -> Index:
    """The index with ``prefix`` before each path; none or "." changes nothing."""
    if prefix in (None, "", "."):
        return index
    path = F.concat_ws("/", F.lit(prefix.rstrip("/")), F.col("relative_path"))
    lines = index.source_lines
    return Index(index.documents.withColumn("relative_path", path), index.chunks, index.symbols, index.mentions, index.ranges, lines.withColumn("relative_path", path) if lines is not None else None)


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the earliest part, then lowest id, for each key."""
    order = Window.partitionBy(*keys).orderBy("part", "id")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _all(parts: list[Index], table: str) -> DataFrame:
    rows = [getattr(index, table).withColumn("part", F.lit(i)) for i, index in enumerate(parts)]
    return reduce(DataFrame.unionByName, rows)


def merge(parts: list[Index]) -> Index:
    """One index of several: documents by path, symbols by text, chunks by document and number, mentions as a set.

    The first part that has a key gives its other columns. Variables are left
    out of all parts but the first. Ranges that agree in all but their id
    become one. The least id of a key over (part, id) is packed into the new
    id, so ids are distinct without a global sort.
    """
    bits = max(1, (len(parts) - 1).bit_length())
    packed = lambda: F.shiftleft(F.col("id"), bits) + F.col("part")
    docs = _all(parts, "documents")
    doc_new = _first(docs, "relative_path").select(packed().alias("new_doc"), "relative_path")
    doc_map = docs.join(doc_new, "relative_path").select("part", F.col("id").alias("document_id"), "new_doc")

    names = _all(parts, "symbols").where((F.col("part") == 0) | symbols.not_variable_sql(F.col("symbol")))
    name_new = _first(names, "symbol").select(packed().alias("new_symbol"), "symbol", "display_name", "kind")
    every = _all(parts, "symbols").select("part", F.col("id").alias("symbol_id"), "symbol")
    name_map = every.join(name_new.select("symbol", "new_symbol"), "symbol").select("part", "symbol_id", "new_symbol")

    chunks = _all(parts, "chunks").join(doc_map, ["part", "document_id"])
    chunk_new = _first(chunks, "new_doc", "chunk_index").select(packed().alias("new_chunk"), "new_doc", "chunk_index", "start_line", "end_line", "occurrences")
    chunk_map = chunks.join(chunk_new.select("new_doc", "chunk_index", "new_chunk"), ["new_doc", "chunk_index"]).select("part", F.col("id").alias("chunk_id"), "new_chunk")

    mentions = _all(parts, "mentions").join(chunk_map, ["part", "chunk_id"]).join(name_map, ["part", "symbol_id"])
    mentions = mentions.select(F.col("new_chunk").alias("chunk_id"), F.col("new_symbol").alias("symbol_id"), "role").distinct()
    ranges = _all(parts, "ranges").join(doc_map, ["part", "document_id"]).join(name_map, ["part", "symbol_id"])
    shape = ("new_doc", "new_symbol", "start_line", "start_char", "end_line", "end_char")
    ranges = _first(ranges.select("part", "id", *shape), *shape).select(packed().alias("id"), F.col("new_doc").alias("document_id"), F.col("new_symbol").alias("symbol_id"), "start_line", "start_char", "end_line", "end_char")
    lines = [p.source_lines for p in parts if p.source_lines is not None]
    return Index(
        doc_new.select(F.col("new_doc").alias("id"), "relative_path"),
        chunk_new.select(F.col("new_chunk").alias("id"), F.col("new_doc").alias("document_id"), "chunk_index", "start_line", "end_line", "occurrences"),
        name_new.select(F.col("new_symbol").alias("id"), "symbol", "display_name", "kind"),
        mentions,
        ranges,
        reduce(DataFrame.unionByName, lines).dropDuplicates(["relative_path", "line_no"]) if lines else None,
    )
