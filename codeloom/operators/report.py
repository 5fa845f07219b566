"""Checks as sections of text: tiers, a shared budget of rows, one record per line.

Only this layer caps and collects; the operators stay lazy and whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import symbols
from . import file_checks as fc
from . import graph, lookup
from . import project_checks as pc
from . import symbol_checks as sc
from .model import Facts

# Tiers in order, and their short names.
TIERS = ("high", "medium", "low")
TIER_NAMES = {"1": "high", "2": "medium", "3": "low", "h": "high", "m": "medium", "l": "low", "med": "medium"} | {t: t for t in TIERS}

#: What a reader should know before acting on a section that has rows.
HINTS = {
    "dead_exports": "The index knows static mentions only; look for names built at run time before you remove anything.",
    "unreferenced": "Nothing mentions these by name. Loaders and decorators may still reach them.",
    "same_file_only": "In use, but by their own file alone: they need not be exported.",
    "stale_types": "No other file names these types; structural use leaves no mention.",
    "cycles": "Index files that only pass on exports make cycles that cost nothing at run time.",
    "dead_in_file": "The index knows static mentions only; look for names built at run time before you remove anything.",
}


@dataclass(frozen=True)
class Check:
    """A section: key, tier, title, rows, their order (SQL, total), and a line for each row (SQL)."""

    key: str
    tier: str
    title: str
    rows: Callable[[Facts], DataFrame]
    order: str
    line: str


_LINES = "concat_ws(':', start_line + 1, end_line + 1)"

PROJECT = (
    Check("cycles", "high", "Files that import each other in a circle", lambda f: _cycle_lines(f), "line", "line"),
    Check("unreferenced", "high", "Symbols without any mention", pc.unreferenced, "loc desc, path, symbol_id", "concat(name, '  loc=', loc, '  (', path, ')')"),
    Check("dead_exports", "high", "Exports that nothing uses", pc.dead_exports, "loc desc, path, symbol_id", "concat(name, '  loc=', loc, '  (', path, ')')"),
    Check("stale_types", "high", "Types that no other file uses", pc.stale_types, "path, symbol_id", "concat(name, '  consumers=', consumers, '  (', path, ')')"),
    Check("same_file_only", "medium", "Used in their own file alone", pc.same_file_only, "loc desc, path, symbol_id", "concat(name, '  loc=', loc, '  (', path, ')')"),
    Check("test_only", "low", "Used by tests alone", pc.test_only, "path, symbol_id", "concat(name, '  test_consumers=', test_consumers, '  (', path, ')')"),
    Check("top_coupling", "low", "Pairs of files that share most symbols", pc.top_coupling, "shared desc, file1, file2", "concat(file1, '  <->  ', file2, '  shared=', shared)"),
    Check("bottlenecks", "low", "Bottlenecks: used by many, using much", pc.bottlenecks, "score desc, fan_in desc, symbol_id, path", "concat(name, '  score=', score, '  loc=', loc, '  fan_in=', fan_in, '  fan_out=', fan_out, '  (', path, ')')"),
    Check("hotspots", "low", "Most mentioned symbols", pc.hotspots, "refs desc, symbol_id, path", "concat(name, '  refs=', refs, '  files=', files, '  (', path, ')')"),
)

FILE = (
    Check("unreferenced", "high", "Symbols of the file without any mention", fc.unreferenced_in_file, "start_line, symbol_id", f"concat(name, '  ', {_LINES})"),
    Check("dead_in_file", "high", "Exports of the file that nothing uses", fc.dead_in_file, "start_line, symbol_id", f"concat(name, '  ', {_LINES})"),
    Check("unused_imports", "high", "Imports without use", fc.unused_imports, "name, symbol_id, chunk_id", "name"),
    Check("same_file_only", "medium", "Used in this file alone", fc.same_file_only_in_file, "start_line, symbol_id", f"concat(name, '  ', {_LINES})"),
    Check("change_surface", "medium", "What a change reaches", fc.change_surface, "consumers desc, start_line, symbol_id", f"concat(name, '  ', {_LINES}, '  consumers=', consumers, '  risk=', risk)"),
    Check("file_consumers", "medium", "Files that use this one", fc.file_consumers, "symbols desc, consumer", "concat(consumer, '  symbols=', symbols)"),
    Check("coupling", "low", "Files tied to this one", fc.coupling_for, "shared desc, other_file", "concat(other_file, '  shared=', shared)"),
    Check("imports", "low", "Imported symbols", fc.imports_summary, "name, symbol_id, from_file", "concat(name, '  from ', from_file, '  (total imports: ', total, ')')"),
    Check("symbol_pressure", "low", "Symbols under most pressure", fc.top_symbol_pressure, "consumers desc, symbol_id", "concat('consumers=', consumers, '  ', name, '  loc=', loc, '  fan_in=', fan_in, '  fan_out=', fan_out, '  pressure=', pressure)"),
)

SYMBOL = (
    Check("consumer_files", "high", "Files that mention it", sc.consumer_files, "refs desc, path", "concat(path, '  refs=', refs)"),
    Check("dependencies", "high", "What its file uses from others", sc.dependencies, "path, name, callee_id", "concat(name, '  (', path, ')')"),
    Check("affected", "low", "What a change may reach, step by step", lambda f: f.defs.limit(0), "depth, path, symbol_id", "concat('depth=', depth, '  ', name, '  (', path, ')')"),
    Check("symbol_pressure", "low", "Its size, users and uses", sc.symbol_pressure, "symbol_id", "concat(name, '  loc=', loc, '  fan_in=', fan_in, '  fan_out=', fan_out, '  pressure=', pressure)"),
    Check("def_context", "low", "Where it is defined", sc.def_context, "path, start_line", f"concat('name=', name, '  kind=', kind, '  file=', path, '  lines=', {_LINES}, '  display_name=', display_name, '  members≈', members)"),
)


def _cycle_lines(facts: Facts) -> DataFrame:
    pairs = graph.two_way_cycles(facts).select(F.concat_ws(" <-> ", "file1", "file2").alias("line"))
    longer = graph.longer_cycles(facts).select(F.array_join(F.array_append("files", F.get("files", F.lit(0))), " -> ").alias("line"))
    return pairs.unionByName(longer)


def parse_priorities(value: str | None) -> set[str] | None:
    """Tiers named in a comma list by name, number or letter; none means all."""
    if not value:
        return None
    out = set()
    for part in filter(None, value.replace(" ", "").lower().split(",")):
        if part not in TIER_NAMES:
            raise ValueError(f"unknown priority {part!r} (use {', '.join(TIERS)} or 1/2/3)")
        out.add(TIER_NAMES[part])
    return out


def run_checks(checks: tuple[Check, ...], facts: Facts, limit: int, priorities: set[str] | None = None, where: str | None = None) -> list[tuple[str, list[str], str | None]]:
    """(title, lines, hint) of each section, high tiers first, keys in order, until ``limit`` rows are shown in all."""
    out, left = [], limit
    for check in sorted(checks, key=lambda c: (TIERS.index(c.tier), c.key)):
        if left <= 0:
            break
        if priorities is not None and check.tier not in priorities:
            continue
        rows = check.rows(facts)
        rows = rows.where(where) if where else rows
        shown = [r["text"] for r in rows.orderBy(*(F.expr(x.removesuffix(" desc")).desc() if x.endswith(" desc") else F.expr(x) for x in check.order.split(", "))).limit(left).select(F.expr(check.line).alias("text")).collect()]
        left -= len(shown)
        scope = f" [{facts.scope}]" if facts.scope else ""
        out.append((f"[{check.tier}] {check.title}{scope}", shown or ["(none)"], HINTS.get(check.key) if shown else None))
    return out


def analyze_project(facts: Facts, limit: int = 20, priorities: set[str] | None = None) -> list[tuple[str, list[str], str | None]]:
    return run_checks(PROJECT, facts, limit, priorities)


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def analyze_file(facts: Facts, path: str, limit: int = 20, priorities: set[str] | None = None) -> list[tuple[str, list[str], str | None]]:
    return run_checks(FILE, facts, limit, priorities, f"path = {_quote(path)}")


def analyze_symbol(facts: Facts, symbol_id: int, limit: int = 20, priorities: set[str] | None = None) -> list[tuple[str, list[str], str | None]]:
    """As for a file; ``affected`` starts from the symbol."""
    names = facts.defs.select("symbol_id", symbols.short_name(F.col("symbol")).alias("name"), "path").distinct()

    def reached(f: Facts) -> DataFrame:
        start = f.names.where(F.col("symbol_id") == symbol_id)
        return graph.affected(f, start).join(names, "symbol_id").withColumn("symbol_of", F.lit(symbol_id))

    checks = tuple(c if c.key != "affected" else Check(c.key, c.tier, c.title, reached, c.order, c.line) for c in SYMBOL)
    parts = [run_checks((c,), facts, limit, priorities, None if c.key == "affected" else f"symbol_id = {int(symbol_id)}") for c in sorted(checks, key=lambda c: (TIERS.index(c.tier), c.key))]
    out, left = [], limit
    for title, lines, hint in (section for part in parts for section in part):
        if left <= 0:
            break
        lines = lines[:left]
        left -= len(lines) if lines != ["(none)"] else 0
        out.append((title, lines, hint))
    return out


def classify_target(facts: Facts, target: str) -> tuple[str, str]:
    """("dir", path), ("file", path) or ("symbol", name) for a target; ValueError when several files match."""
    text = target.strip()
    if not text:
        raise ValueError("the target is empty")
    folder = text.replace("\\", "/").rstrip("/")
    inside = lookup.paths_in_scope(facts, folder)
    first = inside.orderBy("path").limit(1).collect()
    if first and first[0]["path"] != folder:
        return "dir", folder
    files = [r["path"] for r in lookup.resolve_file(facts, text).orderBy("rank").limit(11).collect()]
    if len(files) > 1:
        raise ValueError(f"several files match {target!r}: " + ", ".join(files[:10]))
    return ("file", files[0]) if files else ("symbol", text)


def printed(sections: list[tuple[str, list[str], str | None]]) -> Iterator[str]:
    """Lines of a report."""
    for title, lines, hint in sections:
        yield f"## {title}"
        if hint:
            yield f"# {hint}"
        yield from lines
