"""The index that the registered queries run on, derived from the driver's tables by SQL.

Suppliers are documents, parts are symbols in groups of eight per file, and
every line item is a mention. Where it is and what role it has depends on the
part: a third of the parts is only declared again in its own file, so that some
symbols have no use; types of every fiftieth part are mentioned anywhere; the
others have one to four files that follow the defining one, or two that come
before it, so that the graph of files stays sparse and has cycles, however many
line items there are. The same text runs in
Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import SCHEMAS, Facts, Index

PRELUDE = """
ix_documents AS (
  SELECT s_suppkey AS id,
         CASE WHEN s_suppkey % 10 = 7 THEN 'tests/' ELSE 'src/' END || 'mod' || CAST(s_nationkey AS STRING)
         || '/file' || CAST(s_suppkey AS STRING) || '.ts' AS relative_path
  FROM supplier),
ix_n AS (SELECT COUNT(*) AS n FROM supplier),
ix_parts AS (
  SELECT p_partkey, CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) % n AS document_id, p_size FROM part CROSS JOIN ix_n),
ix_prefix AS (
  SELECT id AS document_id,
         'scip-typescript npm test 1.0 ' || REPLACE(relative_path, '/file', '/`file') || '`/' AS prefix
  FROM ix_documents),
ix_global_symbols AS (
  SELECT y.p_partkey AS id, x.prefix ||
         CASE y.p_partkey % 8
           WHEN 0 THEN 'Class' || CAST(y.p_partkey AS STRING) || '#'
           WHEN 1 THEN 'Class' || CAST(y.p_partkey - 1 AS STRING) || '#method' || CAST(y.p_partkey AS STRING) || '().'
           WHEN 2 THEN 'Type' || CAST(y.p_partkey AS STRING) || CASE WHEN y.p_partkey % 16 = 2 THEN 'Props' ELSE '' END || '#'
           WHEN 3 THEN 'Class' || CAST(y.p_partkey - 3 AS STRING) || '#typeLiteral0:field' || CAST(y.p_partkey AS STRING) || '.'
           WHEN 7 THEN '_func' || CAST(y.p_partkey AS STRING) || '().'
           ELSE 'func' || CAST(y.p_partkey AS STRING) || '().' END AS symbol,
         CASE WHEN y.p_partkey % 2 = 0 THEN 'part' || CAST(y.p_partkey AS STRING) END AS display_name
  FROM ix_parts y JOIN ix_prefix x ON x.document_id = y.document_id
  UNION ALL
  SELECT 1000000 + document_id, prefix, CAST(NULL AS STRING) FROM ix_prefix
  UNION ALL
  SELECT 2000000 + y.p_partkey, x.prefix || 'func' || CAST(y.p_partkey AS STRING) || '0:', CAST(NULL AS STRING)
  FROM ix_parts y JOIN ix_prefix x ON x.document_id = y.document_id WHERE y.p_partkey % 16 = 4
  UNION ALL
  SELECT 3000000 + y.p_partkey, x.prefix || 'func' || CAST(y.p_partkey AS STRING) || '().(arg)', CAST(NULL AS STRING)
  FROM ix_parts y JOIN ix_prefix x ON x.document_id = y.document_id WHERE y.p_partkey % 16 = 5
  UNION ALL
  SELECT 4000000 + y.p_partkey, x.prefix || 'var' || CAST(y.p_partkey AS STRING) || '.', CAST(NULL AS STRING)
  FROM ix_parts y JOIN ix_prefix x ON x.document_id = y.document_id WHERE y.p_partkey % 16 = 6),
ix_defs AS (
  SELECT p_partkey AS id, document_id, p_partkey AS symbol_id,
         (p_partkey % 20) * 10 AS start_line, (p_partkey % 20) * 10 + p_size % 10 AS end_line
  FROM ix_parts WHERE p_partkey % 8 <> 3
  UNION ALL
  SELECT 1000000 + id, id, 1000000 + id, 0, 199 FROM ix_documents
  UNION ALL
  SELECT 4000000 + p_partkey, document_id, 4000000 + p_partkey, 5, 5 FROM ix_parts WHERE p_partkey % 16 = 6),
ix_chunks AS (
  SELECT d.id * 4 + k.k AS id, d.id AS document_id, k.k AS chunk_index, k.k * 50 AS start_line, k.k * 50 + 49 AS end_line
  FROM ix_documents d CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k),
ix_mentions AS (
  SELECT CASE WHEN y.p_partkey % 3 = 0 THEN y.document_id
              WHEN y.p_partkey % 50 = 2 AND y.p_partkey % 8 = 2 THEN l_suppkey
              WHEN y.p_partkey % 48 = 13 THEN GREATEST(y.document_id - 1 - l_suppkey % 2, 0)
              ELSE LEAST(y.document_id + 1 + l_suppkey % (1 + y.p_partkey % 4), n - 1) END * 4 + l_linenumber % 4 AS chunk_id,
         l_partkey AS symbol_id,
         CASE WHEN y.p_partkey % 3 = 0 THEN 1 WHEN l_returnflag = 'A' THEN 2 ELSE 0 END AS role
  FROM lineitem JOIN ix_parts y ON y.p_partkey = l_partkey CROSS JOIN ix_n
  UNION
  SELECT document_id * 4 + CAST((start_line - start_line % 50) / 50 AS BIGINT), symbol_id, 1 FROM ix_defs
  UNION
  SELECT document_id * 4 + CAST((start_line - start_line % 50) / 50 AS BIGINT), symbol_id, 0 FROM ix_defs WHERE symbol_id < 1000000 AND symbol_id % 5 = 0
  UNION
  SELECT ((id * 3 + 1) % n) * 4, 1000000 + id, 2 FROM ix_documents CROSS JOIN ix_n WHERE id % 4 = 0
  UNION
  SELECT ((p_partkey * 11 + 3) % n) * 4, 2000000 + p_partkey, 0 FROM ix_parts CROSS JOIN ix_n WHERE p_partkey % 32 = 4)
"""

#: Source lines: texts of the driver's documents, in which lines of code stand where symbols are said to be. Fields have
#: no range, so only a scan of the source finds them; calls stand in the lines that a chunk with a mention covers.
CODE = """
ix_code AS (
  SELECT document_id, (p_partkey - 3) % 20 * 10 + p_partkey % 4 AS line_no, '  readonly field' || CAST(p_partkey AS STRING) || '?: number;' AS code
  FROM ix_parts WHERE p_partkey % 8 = 3
  UNION ALL
  SELECT document_id, p_partkey % 20 * 10 AS line_no, 'export function func' || CAST(p_partkey AS STRING) || '(a) =>' AS code
  FROM ix_parts WHERE p_partkey % 8 IN (4, 5, 6)
  UNION ALL
  SELECT document_id, (p_partkey * 7) % 200 AS line_no, '  func' || CAST(p_partkey AS STRING) || '(1);' AS code
  FROM ix_parts WHERE p_partkey % 8 = 5)
"""

_CACHE: dict[tuple[int, str, str], Index] = {}


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "part", "lineitem")}
    text = f"{PRELUDE}, {CODE}"
    for table in tables:
        text = text.replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(f"WITH {text} SELECT * FROM ix_{name}", **tables)


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The derived index, kept for the session: the queries share it as they would share an index that was loaded."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        names = {"documents": "documents", "chunks": "chunks", "symbols": "global_symbols", "mentions": "mentions", "ranges": "defs"}
        tables = {}
        for name, source in names.items():
            df = _derived(spark, sf_dir, source)
            columns = [c.split() for c in SCHEMAS[name].split(", ")]
            made = {"start_char": F.lit(0), "end_char": F.lit(0), "kind": F.lit(0), "occurrences": F.lit(None)}
            tables[name] = df.select(*((F.col(c) if c in df.columns else made[c]).cast(t).alias(c) for c, t in columns)).cache()
        _CACHE[key] = Index(**tables)
    return _CACHE[key]


_FACTS: dict[tuple[int, str, str], Facts] = {}


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    """Facts over the derived index, with the two shared aggregates kept for the session."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _FACTS:
        found = Facts(index(spark, sf_dir))
        for name in ("use", "defs", "defuse", "live_modules", "live_aliases"):
            getattr(found, name).cache()
        _FACTS[key] = found
    return _FACTS[key]


def with_source(spark: SparkSession, sf_dir: str) -> Facts:
    """Facts with source lines: 200 of each index document, or as many as the driver's document of its number has, with code among them."""
    base = index(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    # Documents shorter than the index says have empty lines at the end.
    padded = F.concat(parts, F.array_repeat(F.lit(""), F.greatest(F.lit(200) - F.size(parts), F.lit(0))))
    text = base.documents.join(docs, "id").select(F.col("id").alias("document_id"), "relative_path", F.posexplode(padded).alias("line_no", "text"))
    code = _derived(spark, sf_dir, "code").groupBy("document_id", "line_no").agg(F.min("code").alias("code"))
    lines = text.join(code, ["document_id", "line_no"], "left").select("relative_path", "line_no", F.coalesce("code", "text").alias("text"))
    return Facts(Index(**base.tables(), source_lines=lines))
