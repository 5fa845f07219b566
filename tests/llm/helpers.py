"""Small tables and plain versions that the tests compare with."""

import re

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    """Documents from (doc_id, text[, lang, source]); with ``extra``, more columns whose names operators use inside."""
    full = [(*r, *("en", "web")[len(r) - 2 :], len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        for name in ("n", "band", "root", "kept", "score", "part", "_part", "places", "first", "words", "pii_text", "pii_email", "mix_class", "component_id", "leader", "row", "task", "bin", "open", "shard", "slot"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


def words(text: str | None) -> list[str]:
    return BLANK.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text: str | None) -> set:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


#: Texts that every operator must take: null, empty, blank, one word, long, repeated rows, odd characters.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "one two three four five six"), (6, "one two three four five six"), (6, "one two three four five six"), (7, "lorem ipsum dolor " * 40_000),
    (8, "x" * 300_000), (9, "é漢😀    <|endoftext|> \x1c \x00 \r\n"), (None, "one two three four five six"), (None, None), (10, "mail a@b.example and 4111 1111 1111 1111 or +1 (555) 010-9999 at 10.0.0.255"),
]
