"""Quality rules with thresholds that adapt to language and source.

Three metrics are whole numbers: symbols per thousand word characters, a
hundredth of the mean word length, repeated lines per thousand lines. Their
quantile sketch keeps, for each (language, source, metric), how many documents
have each value rounded down to seven significant bits: at most 64 places per
power of two, a relative error of 1/64, and sketches merge by adding counts.
Sources with few documents use the merged sketch of their language, languages
with few that of all.

No fence has a fixed cutoff. Word length has a narrow middle, so its fences are
the median plus and minus a multiple of the distance between the quartiles.
Symbols and repeated lines are 0 in most documents, so their quartiles say
nothing; their fence is an upper quantile, beyond which a small share of each
group lies. A fence reaches to the end of its place, the sketch's resolution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stage

WINDOW = 5
#: Base rules: fewer words than this, or more than this percentage of words in repeated windows.
LEAST_WORDS, REPEAT_PERCENT = 10, 20
#: Metrics whose fence is this percentile of the group; larger values fail.
TAILS = {"symbols": 97, "repeated_lines": 99}
#: Metrics whose fences are so many distances between the quartiles away from the median.
SPREADS = {"word_length": 10}
METRICS = (*TAILS, *SPREADS)
#: Documents that a sketch needs before it is used.
ENOUGH = 50
SIGNIFICANT_BITS = 7


def _unit(v: Column) -> Column:
    """How many values share the place of ``v`` >= 0: the sketch's resolution there."""
    drop = F.greatest(F.length(F.bin(v)) - SIGNIFICANT_BITS, F.lit(0))
    return F.pow(F.lit(2.0), drop).cast("long")


def _rounded(v: Column) -> Column:
    """``v`` >= 0 rounded down to its leading bits."""
    return v - v % _unit(v)


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blank = "[\\x20\\x09-\\x0D]+"
    step = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    step = step.withColumn("words", F.filter(F.split("text", blank), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, " \t\x0b\f\r", "") != "")
    step = step.select(
        "doc_id", "lang", "source", "words", lines.alias("lines"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    hashes = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))))
    step = step.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, hashes).alias("windows"),
    )
    # Windows sorted by hash, with their places; only where some window is there twice.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.withColumn("ordered", ordered).drop("windows")
    near = lambda x, k, d: F.coalesce(F.get("ordered", k + d)["h"] == x["h"], F.lit(False))
    marked = F.filter(F.transform("ordered", lambda x, k: F.when(near(x, k, -1) | near(x, k, 1), x["i"])), lambda i: i.isNotNull())
    step = step.withColumn("places", F.array_sort(marked)).drop("ordered")
    steps = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places")


def _metrics() -> dict[str, Column]:
    return {
        "symbols": F.floor(1000 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "word_length": F.floor(100 * F.col("word_chars") / F.greatest("n_words", F.lit(1))),
        "repeated_lines": F.floor(1000 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
    }


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, place, n) over documents that pass the base rules."""
    values = F.explode(F.create_map(*(x for k, v in _metrics().items() for x in (F.lit(k), v.cast("long")))))
    rows = stats.where("not base_failed").select("lang", "source", values.alias("metric", "value"))
    return rows.groupBy("lang", "source", "metric", _rounded(F.col("value")).alias("place")).agg(F.count("*").alias("n"))


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Sketches merged to coarser keys."""
    return parts.groupBy(*keys, "metric", "place").agg(F.sum("n").alias("n"))


def fences(parts: DataFrame, *keys: str) -> DataFrame:
    """One row per key: ``docs`` and, for each metric, ``<metric>_low`` and ``<metric>_high``."""
    order = Window.partitionBy(*keys, "metric").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "metric")
    ranked = parts.withColumn("upto", F.sum("n").over(order)).withColumn("docs", F.sum("n").over(whole))
    quantile = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("docs"), F.col("place")))
    asked = sorted({25, 50, 75, *TAILS.values()})
    flat = ranked.groupBy(*keys, "metric").agg(F.max("docs").alias("docs"), *(quantile(p).alias(f"q{p}") for p in asked))
    columns = [F.max("docs").alias("docs")]
    pick = lambda name, c: F.max(F.when(F.col("metric") == name, c))
    end = lambda c: F.col(c) + _unit(F.col(c)) - 1
    for name in METRICS:
        reach = SPREADS.get(name, 0) * (end("q75") - F.col("q25"))
        high, low = (end(f"q{TAILS[name]}"), F.lit(0)) if name in TAILS else (end("q50") + reach, F.col("q50") - reach)
        columns += [pick(name, high).alias(f"{name}_high"), pick(name, low.cast("long")).alias(f"{name}_low")]
    return flat.groupBy(*keys).agg(*columns) if keys else flat.agg(*columns)


def fenced(parts: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """g_lang, g_source, sketch and the fences of each language and source that has documents which pass the base rules.

    ``sketch`` names the merged sketch used: source, language or all.
    """
    by_source, by_lang, by_all = fences(parts, "lang", "source"), fences(merged(parts, "lang"), "lang"), fences(merged(parts))
    names = [f"{m}_{side}" for m in METRICS for side in ("high", "low")]
    renamed = lambda df, tag: df.select(*(c for c in df.columns if c in ("lang", "source")), *(F.col(c).alias(f"{tag}_{c}") for c in ("docs", *names)))
    groups = renamed(by_source, "s").withColumnRenamed("lang", "g_lang").withColumnRenamed("source", "g_source")
    langs = renamed(by_lang, "l").withColumnRenamed("lang", "l_lang")
    groups = groups.join(langs, F.col("g_lang").eqNullSafe(F.col("l_lang")), "left")
    every = by_all.select(*(F.col(c).alias(f"a_{c}") for c in names))
    # One row on the right.
    groups = groups.join(F.broadcast(every), F.lit(True), "left")
    level = lambda s, l, a: F.when(F.col("s_docs") >= enough, s).when(F.col("l_docs") >= enough, l).otherwise(a)  # noqa: E731, E741
    picked = [level(F.col(f"s_{c}"), F.col(f"l_{c}"), F.col(f"a_{c}")).alias(c) for c in names]
    return groups.select("g_lang", "g_source", level(F.lit("source"), F.lit("language"), F.lit("all")).alias("sketch"), *picked)


def quality(docs: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): counts, base_failed, kept, sketch.

    A document is kept when it passes the base rules and each metric lies
    within the fences of its language and source; ``sketch`` says whose sketch
    set them (source, language or all; one of fewer than ``enough`` documents
    gives way to the next), null where no document of the language and source
    passes the base rules. Null text: no words, fails. Null language or source:
    a group of its own. Repeated rows count as many times as they are there. An
    empty table gives no rows; other columns are ignored.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    stats = stage(text_stats(docs).withColumn("base_failed", failed), "stats")
    groups = stage(fenced(stage(sketches(stats), "sketches"), enough), "fences")
    joined = stats.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    inside = F.lit(True)
    for name, value in _metrics().items():
        inside = inside & F.coalesce(value.between(F.col(f"{name}_low"), F.col(f"{name}_high")), F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "sketch")
