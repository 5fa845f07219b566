"""Path predicates as Column expressions, and scope handling."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .symbols import short_name

# Paths that the checks leave out.
GENERATED_PART, GENERATED_END = "/types/prisma/", "types/resolvers.ts"
CLI_FOLDER = "/commands/"


def _slashes(p: Column) -> Column:
    return F.replace(p, F.lit("\\"), F.lit("/"))


def is_test(path: Column) -> Column:
    """Whether a path follows a usual layout or name of tests."""
    p = F.lower(_slashes(path))
    name = F.substring_index(p, "/", -1)
    inside = p.rlike("(^|/)tests?/") | F.contains(p, F.lit("/__tests__/"))
    return inside | name.rlike("\\.(test|spec)\\.") | name.rlike("^test_.*\\.py$") | (name == "conftest.py")


def is_generated(path: Column) -> Column:
    p = _slashes(path)
    return F.contains(p, F.lit(GENERATED_PART)) | p.endswith(GENERATED_END)


def _ends(path: Column, ends: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for end in ends:
        out = out | path.endswith(end)
    return out


def is_noise(path: Column, symbol: Column, include_tests: bool = False, main_file: str | None = None, dashboards: tuple[str, ...] = ()) -> Column:
    """Rows that the checks leave out: tests, generated code, private names, entry points, dashboard functions.

    ``main_file`` is a path whose ``main`` counts as an entry point beside those
    in command folders; functions in files that end as one of ``dashboards``
    are called by a runner that the index doesn't see.
    """
    p, name = _slashes(path), short_name(symbol)
    entry = F.contains(p, F.lit(CLI_FOLDER)) if main_file is None else F.contains(p, F.lit(CLI_FOLDER)) | (p == main_file)
    out = is_generated(path) | name.startswith("_") | ((name == "main") & entry)
    out = out | (_ends(p, dashboards) & (F.contains(symbol, F.lit("().")) | name.endswith(")")))
    return out if include_tests else out | is_test(path)


def is_props_type(symbol: Column) -> Column:
    name = short_name(symbol)
    return name.endswith("Props") & F.contains(F.substring_index(symbol, "/", -1), F.lit("#"))


def is_stale_noise(path: Column, symbol: Column, consumers: Column, ends: tuple[str, ...] = ()) -> Column:
    """Props types, and capitalised names without consumers in files that end as one of ``ends``."""
    shape = short_name(symbol).rlike("^\\p{Lu}") & _ends(_slashes(path), ends)
    return is_props_type(symbol) | ((consumers == 0) & shape)


def in_scope(path: Column, scope: str | None) -> Column:
    """Whether a path is the scope or below it."""
    if not scope:
        return F.lit(True)
    return (path == scope) | path.startswith(scope.rstrip("/") + "/")


def normalized_scope(path: str | None, root: str | Path) -> str | None:
    """A path argument relative to the project, or ValueError when it leaves the project."""
    if not path:
        return None
    base = Path(root).resolve()
    full = (base / path).resolve()
    if not full.is_relative_to(base):
        raise ValueError(f"path is outside the project: {path}")
    return full.relative_to(base).as_posix() or "."
