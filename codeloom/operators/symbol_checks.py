"""Checks of single symbols, computed for all symbols at once; one symbol is a filter on ``symbol_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import symbols
from .model import Facts
from .project_checks import fan_out


def _name() -> Column:
    return symbols.short_name(F.col("symbol")).alias("name")


def consumer_files(facts: Facts) -> DataFrame:
    """symbol_id, path, refs: files other than the defining one, by mentions."""
    users = facts.use.where("n_other > 0").withColumnRenamed("doc_id", "u_doc")
    rows = facts.defs.select("symbol_id", "doc_id").join(users, "symbol_id").where("u_doc <> doc_id")
    grouped = rows.groupBy("symbol_id", "u_doc").agg(F.sum("n_other").alias("refs"))
    return grouped.join(facts.docs.withColumnRenamed("doc_id", "u_doc"), "u_doc").select("symbol_id", "path", "refs")


def dependencies(facts: Facts) -> DataFrame:
    """symbol_id, callee_id, name, path: symbols used anywhere in the symbol's file and defined in another."""
    used = facts.use.where("n_use > 0").select(F.col("symbol_id").alias("callee_id"), "doc_id")
    homes = facts.defs.select(F.col("symbol_id").alias("callee_id"), F.col("doc_id").alias("home"), "symbol", "path")
    per_file = used.join(homes, "callee_id").where("home <> doc_id").select("doc_id", "callee_id", _name(), "path").distinct()
    return facts.defs.select("symbol_id", "doc_id").join(per_file, "doc_id").select("symbol_id", "callee_id", "name", "path").distinct()


def symbol_pressure(facts: Facts) -> DataFrame:
    """symbol_id, name, loc, fan_in, fan_out, pressure."""
    rows = facts.defuse.join(fan_out(facts), "doc_id", "left")
    out = F.coalesce("fan_out", F.lit(0)).cast("long")
    return rows.select("symbol_id", _name(), "loc", F.col("consumers").alias("fan_in"), out.alias("fan_out"), (F.col("consumers") * out).alias("pressure"))


def prefixes(names: DataFrame) -> DataFrame:
    """symbol_id, symbol, parent: every proper prefix of a symbol that ends where a descriptor can.

    Descriptors come after four words (scheme, manager, package, version), which
    all symbols of a project share and which are no symbol; a text with fewer
    words is all descriptors.
    """
    s = F.col("symbol")
    words = F.length(F.substring_index(s, " ", 4))
    head = F.when(words < F.length(s), words + 1).otherwise(0)
    tail = s.substr(head + 1, F.length(s))
    cuts = F.filter(F.transform(F.split(tail, ""), lambda c, i: F.when(c.isin("/", "#", ".", ":", ")"), i + 1)), lambda i: i.isNotNull())
    rows = names.select("symbol_id", "symbol", F.explode(cuts).alias("cut")).where(head + F.col("cut") < F.length(s))
    return rows.select("symbol_id", "symbol", s.substr(F.lit(1), head + F.col("cut")).alias("parent"))


def def_context(facts: Facts) -> DataFrame:
    """symbol_id, name, kind, path, lines, display_name, members: how many symbols begin with this one."""
    counts = prefixes(facts.names).groupBy("parent").agg(F.count("*").alias("members"))
    rows = facts.defs.join(counts, F.col("symbol") == F.col("parent"), "left")
    return rows.select("symbol_id", _name(), symbols.kind(F.col("symbol")).alias("kind"), "path", "start_line", "end_line", F.coalesce("display_name", F.lit("-")).alias("display_name"), F.coalesce("members", F.lit(0)).cast("long").alias("members"))
