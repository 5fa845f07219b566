"""Every registered query by name: (spark, sf_dir) to a DataFrame over the derived index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, symbols
from ..operators import etl, graph, lookup, source_text
from ..operators import file_checks as fc
from ..operators import project_checks as pc
from ..operators import symbol_checks as sc
from ..operators.model import Facts, Index
from .fixture import facts, index, with_source

# Names, files and patterns that the lookup queries ask for.
NAMES = (("Class8.method9", None), ("func4", None), ("field3", None), ("Class16", "class"), ("unc12", None), ("method17", "method"))
FILES = ("file3.ts", "src/mod5/file5.ts", "file12", "le7", "od1/file")
PATTERNS = ("Class8", "field1")
FOLDER = "src/mod5"
ROOT = "packages/app"


def _long(df: DataFrame) -> DataFrame:
    """Whole numbers as longs, as the SQL has them."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def _on_facts(operator: Callable[[Facts], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _long(operator(facts(spark, sf_dir)))

    return query


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def symbol_scalars(f: Facts) -> DataFrame:
    s = F.col("symbol")
    return f.names.select(
        "symbol_id", symbols.leaf_name(s).alias("leaf"), symbols.short_name(s).alias("short"), symbols.kind(s).alias("kind"),
        symbols.is_variable(s).alias("is_variable"), symbols.is_parameter(s).alias("is_parameter"), symbols.is_type(s).alias("is_type"),
        symbols.is_runtime_edge(s).alias("is_runtime_edge"), symbols.alias_base(s).alias("alias_base"), symbols.value_base(s).alias("value_base"), symbols.file_path(s).alias("file_path"),
    )


def path_scalars(f: Facts) -> DataFrame:
    p = F.col("path")
    return f.docs.select("path", "is_test", paths.is_generated(p).alias("is_generated"), paths.in_scope(p, FOLDER).alias("in_scope"))


def noise(f: Facts) -> DataFrame:
    p, s = F.col("path"), F.col("symbol")
    return f.defs.select("symbol_id", "path", paths.is_noise(p, s).alias("noise"), paths.is_noise(p, s, True).alias("noise_with_tests"), paths.is_props_type(s).alias("is_props"))


def liveness(f: Facts) -> DataFrame:
    return f.with_liveness(f.defs.select("symbol_id", "doc_id", "symbol")).select("symbol_id", "doc_id", "live")


def affected(f: Facts) -> DataFrame:
    """From the symbol with the most consumers."""
    hub = f.defuse.orderBy(F.desc("consumers"), "symbol_id").limit(1).select("symbol_id")
    return graph.affected(f, hub)


def cycles_longer(f: Facts) -> DataFrame:
    return graph.longer_cycles(f).select(F.array_join("files", " -> ").alias("cycle"))


def components(f: Facts) -> DataFrame:
    return graph.components(graph.file_edges(f))


def resolve_symbol(f: Facts) -> DataFrame:
    return lookup.resolve_symbols(f, list(NAMES)).select("asked", "symbol_id", "symbol")


def resolve_file(f: Facts) -> DataFrame:
    return _union([lookup.resolve_file(f, pattern).select(F.lit(pattern).alias("asked"), "path", "rank") for pattern in FILES])


def outermost(f: Facts) -> DataFrame:
    folders = f.docs.select(F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    return lookup.outermost(folders.unionByName(f.docs.select(F.substring_index("path", "/", 1).alias("path"))))


def _on_index(operator: Callable[[Index], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _long(operator(index(spark, sf_dir)))

    return query


def _halves(whole: Index) -> list[Index]:
    """Two parts that share every third document; the second has ids of its own."""
    parts = []
    for k, test in enumerate(("id % 2 = 0 or id % 3 = 0", "id % 2 = 1 or id % 3 = 0")):
        shift = 10_000_000 * k
        docs = whole.documents.where(test)
        chunks = whole.chunks.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        ranges = whole.ranges.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        mentions = whole.mentions.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
        move = lambda df, *cs, shift=shift: df.withColumns({c: F.col(c) + shift for c in cs})
        parts.append(Index(move(docs, "id"), move(chunks, "id", "document_id"), move(whole.symbols, "id"), move(mentions, "chunk_id", "symbol_id"), move(ranges, "id", "document_id", "symbol_id")))
    return parts


def _merged(table: Callable[[Index], DataFrame]) -> Callable[[Index], DataFrame]:
    return lambda whole: table(etl.merge(_halves(whole)))


def _by_name(ix: Index) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = ix.documents.select(F.col("id").alias("document_id"), F.col("relative_path").alias("path"))
    names = ix.symbols.select(F.col("id").alias("symbol_id"), "symbol")
    return docs, names, ix.chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index").join(docs, "document_id")


def merged_mentions(ix: Index) -> DataFrame:
    _, names, chunks = _by_name(ix)
    return ix.mentions.join(chunks, "chunk_id").join(names, "symbol_id").select("path", "chunk_index", "symbol", "role")


def merged_ranges(ix: Index) -> DataFrame:
    docs, names, _ = _by_name(ix)
    return ix.ranges.join(docs, "document_id").join(names, "symbol_id").select("path", "symbol", "start_line", "end_line")


def merged_chunks(ix: Index) -> DataFrame:
    docs, _, _ = _by_name(ix)
    return ix.chunks.join(docs, "document_id").select("path", "chunk_index", "start_line", "end_line")


def _with_text(operator: Callable[[Facts], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _long(operator(with_source(spark, sf_dir)))

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _on_facts(operator)
    for name, operator in {
        "hotspots": pc.hotspots, "bottlenecks": pc.bottlenecks, "unreferenced": pc.unreferenced, "dead_exports": pc.dead_exports, "stale_types": pc.stale_types,
        "same_file_only": pc.same_file_only, "test_only": pc.test_only, "top_coupling": pc.top_coupling,
        "unreferenced_in_file": fc.unreferenced_in_file, "dead_in_file": fc.dead_in_file, "same_file_only_in_file": fc.same_file_only_in_file, "unused_imports": fc.unused_imports,
        "change_surface": fc.change_surface, "file_consumers": fc.file_consumers, "coupling_for": fc.coupling_for, "imports_summary": fc.imports_summary, "top_symbol_pressure": fc.top_symbol_pressure,
        "consumer_files": sc.consumer_files, "dependencies": sc.dependencies, "symbol_pressure": sc.symbol_pressure, "def_context": sc.def_context, "affected": affected,
        "file_edges": lambda f: graph.file_edges(f).select("from_file", "to_file"), "cycles_two_way": graph.two_way_cycles, "cycles_longer": cycles_longer, "components": components,
        "symbol_scalars": symbol_scalars, "path_scalars": path_scalars, "noise": noise, "live_modules": lambda f: f.live_modules, "live_aliases": lambda f: f.live_aliases.select("base"), "liveness": liveness,
        "files_with_importers": pc.files_with_importers, "fan_out": pc.fan_out, "sym_ref_docs": lambda f: f.use,
        "resolve_symbol": resolve_symbol, "resolve_file": resolve_file, "paths_in_scope": lambda f: lookup.paths_in_scope(f, FOLDER), "outermost": outermost,
        "file_symbols": lookup.file_symbols, "importers": lookup.importers, "members": lookup.members, "def_location": lookup.def_location, "document_path": lookup.document_path,
        "external_ref_count": lookup.external_ref_count, "deps_symbol": lookup.deps_of_symbols, "deps_file": lookup.deps_of_files, "search": lambda f: lookup.search(f, list(PATTERNS)),
    }.items()
} | {
    name: _on_index(operator)
    for name, operator in {
        "prune_symbols": lambda ix: etl.prune(ix).symbols.select("id", "symbol"), "prune_symbols_external": lambda ix: etl.prune(ix, True).symbols.select("id", "symbol"),
        "prune_mentions": lambda ix: etl.prune(ix).mentions, "prune_defs": lambda ix: etl.prune(ix).ranges.select("id", "document_id", "symbol_id"),
        "reroot_paths": lambda ix: etl.reroot(ix, ROOT).documents,
        "merge_documents": _merged(lambda ix: ix.documents.select("relative_path")), "merge_symbols": _merged(lambda ix: ix.symbols.select("symbol", "display_name")),
        "merge_chunks": _merged(merged_chunks), "merge_mentions": _merged(merged_mentions), "merge_ranges": _merged(merged_ranges),
    }.items()
} | {
    name: _with_text(operator)
    for name, operator in {
        "refs_lines": source_text.refs, "code_body": lambda f: source_text.code(f).select("symbol_id", "path", "start_line", "shown_end", "body", "truncated"),
        "fallback_def": source_text.scanned_definitions, "member_lines": source_text.member_lines, "resolved_locations": source_text.resolved_locations,
    }.items()
}
