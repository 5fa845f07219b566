"""A Spark data source for tables of SQLite files: one partition per range of row ids.

``spark.dataSource.register(SqliteSource)`` and then
``spark.read.format("codeloom_sqlite").option("path", p).option("dbtable", t).schema(s).load()``.
The file must be readable by every executor at the same path.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.model import SCHEMAS, Index

# Names of the tables in SQLite files.
TABLES = {"documents": "documents", "chunks": "chunks", "symbols": "global_symbols", "mentions": "mentions", "ranges": "defn_enclosing_ranges"}
ROWS_PER_PARTITION = 1_000_000


class RowRange(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path, self.table = schema, options["path"], options["dbtable"]
        self.rows = int(options.get("rows", ROWS_PER_PARTITION))

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [RowRange(0, 0)]
        return [RowRange(at, at + self.rows) for at in range(low, high + 1, self.rows)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        with _open(self.path) as db:
            have = {row[1] for row in db.execute(f"PRAGMA table_info({_quoted(self.table)})")}
            columns = ", ".join(_quoted(f.name) if f.name in have else "NULL" for f in self.schema.fields)
            yield from db.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codeloom_sqlite"

    def schema(self) -> str:
        raise ValueError("give the schema to read")

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


def load_sqlite(spark: SparkSession, path: str) -> Index:
    """The five tables of one SQLite index; columns that the file lacks are null."""
    spark.dataSource.register(SqliteSource)
    read = lambda name: spark.read.format("codeloom_sqlite").option("path", path).option("dbtable", TABLES[name]).schema(SCHEMAS[name]).load()
    return Index(**{name: read(name) for name in SCHEMAS})
