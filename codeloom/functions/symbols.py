"""Symbol strings as Column expressions: names, kinds, predicates.

A symbol reads ``scheme manager package version dir/`file`/descriptor``. Predicates
that stand for SQL LIKE fold ASCII case; those that stand for string methods don't.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds a symbol can have.
KINDS = ("function", "method", "class", "property", "unknown")
# Extensions that a bare file name may lack.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py")
# Extensions by which a target is taken for a file.
FILE_TARGETS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rs")


def escape_like(text: str) -> str:
    """``text`` as a literal within a LIKE pattern."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def like(column: Column, pattern: str) -> Column:
    """LIKE that folds case."""
    return column.ilike(pattern)


def last_segment(s: Column) -> Column:
    return F.substring_index(s, "/", -1)


def is_module(s: Column) -> Column:
    return s.endswith("/")


def is_parameter(s: Column) -> Column:
    return F.contains(s, F.lit(").("))


def leaf_name(s: Column) -> Column:
    """The bare name: last path segment without suffixes, containers, quotes and accessor marks."""
    leaf = F.regexp_replace(last_segment(s), "[.#]+$", "")
    leaf = F.regexp_replace(leaf, "\\(\\)$", "")
    leaf = F.substring_index(F.substring_index(leaf, ":", -1), "#", -1)
    return F.regexp_replace(F.replace(leaf, F.lit("`")), "^<[gs]et>", "")


def short_name(s: Column) -> Column:
    leaf = leaf_name(s)
    return F.when(is_module(s), "(module)").when(leaf != "", leaf).otherwise(F.substring(last_segment(s), 1, 60))


def kind(s: Column) -> Column:
    called, member = s.endswith("()."), F.contains(s, F.lit("#"))
    return (
        F.when(called & member, "method")
        .when(called, "function")
        .when(s.endswith("#") & last_segment(s).rlike("^\\p{Lu}"), "class")
        .when(F.contains(s, F.lit("#typeLiteral")) & F.contains(s, F.lit(":")) & s.endswith("."), "property")
        .otherwise("unknown")
    )


def may_be_kind(s: Column, wanted: str) -> Column:
    """The cheap test on the text that goes before the exact kind."""
    tests = {
        "function": like(s, "%().") & ~like(s, "%#%()."),
        "method": like(s, "%#%") & like(s, "%()."),
        "class": like(s, "%#"),
        "property": like(s, "%#typeLiteral%"),
    }
    return tests.get(wanted, F.lit(True))


def is_variable(s: Column) -> Column:
    return s.endswith(".") & ~s.endswith("().") & ~F.contains(s, F.lit("#typeLiteral")) & ~is_parameter(s)


def not_variable_sql(s: Column) -> Column:
    """The exclusion of variables as SQL states it."""
    return ~(like(s, "%.") & ~like(s, "%().") & ~like(s, "%#typeLiteral%") & ~like(s, "%).(%"))


def is_type(s: Column) -> Column:
    literal = F.contains(s, F.lit("#typeLiteral"))
    return ~is_module(s) & ~s.endswith("().") & (literal | F.contains(last_segment(s), F.lit("#")))


def is_runtime_edge(s: Column) -> Column:
    """A mention of the symbol is a dependency at run time."""
    return like(s, "%().") | (~like(s, "%#%") & ~like(s, "%/"))


def is_edge_with_modules(s: Column) -> Column:
    return like(s, "%().") | like(s, "%/") | ~like(s, "%#%")


def alias_base(s: Column) -> Column:
    """The name that an export-object alias stands for, else null."""
    tail = last_segment(s)
    return F.when(tail.endswith("0:") & ~F.contains(tail, F.lit("().")), tail.substr(F.lit(1), F.length(tail) - 2))


def value_base(s: Column) -> Column:
    """The name of a function or type that can be a default export, else null."""
    type_like = s.endswith("#") & ~F.contains(s, F.lit("#typeLiteral")) & ~F.contains(last_segment(s), F.lit("()."))
    return F.when(s.endswith("().") | type_like, F.nullif(leaf_name(s), F.lit("")))


def quoted_file(s: Column) -> Column:
    """The backquoted file name, else null."""
    return F.nullif(F.regexp_extract(s, "`([^`]+)`", 1), F.lit(""))


def file_path(s: Column) -> Column:
    """The path that a symbol names: directory and quoted file, or the part up to .py; else null."""
    name = quoted_file(s)
    words = F.filter(F.split(F.substring_index(s, "`", 1), "\\s+"), lambda w: w != "")
    folder = F.array_join(F.slice(words, 5, F.greatest(F.size(words), F.lit(1))), " ")
    quoted = F.when(F.size(words) >= 5, F.concat(folder, name)).otherwise(name)
    return F.when(name.isNotNull(), quoted).otherwise(F.nullif(F.regexp_extract(s, "(\\S+\\.py)/", 1), F.lit("")))


def is_noisy_in_search(s: Column) -> Column:
    literal = F.contains(s, F.lit("typeLiteral")) & (kind(s) != "property")
    return is_module(s) | s.endswith("/__init__:") | literal | is_parameter(s)


def parse_qualified(name: str) -> tuple[list[str], str]:
    """Qualifier parts and leaf of ``a.b.leaf``."""
    *parts, leaf = name.split(".")
    return parts, leaf


def matches_qualifier(s: Column, parts: list[str], leaf: str) -> Column:
    """Whether a symbol is ``leaf`` within the containers ``parts``."""
    if not parts:
        return F.lit(True)
    tail, last = last_segment(s), parts[-1]
    others = F.lit(True)
    for part in parts[:-1]:
        others = others & F.contains(s, F.lit(part))
    member = f"{last}#{leaf}"
    literal = tail.rlike(f"\\Q{last}\\E#typeLiteral\\d+:\\Q{leaf}\\E\\.")
    return (
        F.contains(tail, F.lit(f"{'#'.join(parts)}#{leaf}"))
        | ((literal | F.contains(tail, F.lit(member))) & others)
        | F.contains(s, F.lit(f"{'.'.join(parts)}.{leaf}"))
        | F.contains(s, F.lit(f"{'.'.join(parts)}/{leaf}"))
        | (F.contains(s, F.lit(".py/")) & F.contains(s, F.lit(member)) & others)
    )


def leaf_patterns(leaf: str) -> list[str]:
    """LIKE patterns of the places where a leaf can stand."""
    e = escape_like(leaf)
    return [f"%/{e}().", f"%/{e}#", f"%/{e}.", f"%#{e}().", f"%#{e}.", f"%typeLiteral%:{e}."]


def is_direct_member(parent: Column, child: Column) -> Column:
    """Whether ``child`` is an immediate child of ``parent``."""
    rest = child.substr(F.length(parent) + 1, F.length(child))
    literal = rest.rlike("^typeLiteral\\d+:[^#]+\\.")
    return child.startswith(parent) & (rest != "") & F.when(rest.startswith("typeLiteral"), literal).otherwise(rest.rlike("^[^#]+#$") | ~F.contains(F.substring_index(rest, "().", 1), F.lit("#")))


def has_word(line: Column, word: Column) -> Column:
    """Whether ``word`` stands in ``line`` as a whole identifier; an empty word never does."""
    quoted = F.regexp_replace(word, "([\\\\^$.|?*+()\\[\\]{}])", "\\\\$1")
    return (word != "") & F.rlike(line, F.concat(F.lit("(?U)(?<![\\w$`])"), quoted, F.lit("(?![\\w$`])")))


def line_range(start: Column, end: Column, sep: str = ":") -> Column:
    """One-based range as text."""
    first = (start + 1).cast("string")
    return F.when(start.isNull(), "??").when(end.isNull(), F.concat(first, F.lit(f"{sep}?"))).otherwise(F.concat(first, F.lit(sep), (end + 1).cast("string")))


def looks_like_file(target: str) -> bool:
    """Whether a target is more likely a file than a symbol."""
    return "/" in target or "\\" in target or re.search(rf"\.({'|'.join(FILE_TARGETS)})$", target, re.I) is not None
