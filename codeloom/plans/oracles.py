"""DuckDB SQL for the registered queries, stated apart from the operators.

Each statement begins with the derived index and a few helper tables: documents
with a test mark (k_doc), symbols with their parts (k_sym), definitions (k_def),
located mentions (k_use).
"""

from __future__ import annotations

from .fixture import CODE, PRELUDE
from .queries import FILES, FOLDER, NAMES, PATTERNS, ROOT

_HELPERS = r"""
k_doc AS (
  SELECT id AS doc_id, relative_path AS path,
         regexp_matches(lower(relative_path), '(^|/)tests?/|/__tests__/|\.(test|spec)\.[^/]*$|(^|/)test_[^/]*\.py$|(^|/)conftest\.py$') AS is_test
  FROM ix_documents),
k_leaf AS (
  SELECT id AS symbol_id, symbol, display_name, split_part(symbol, '/', -1) AS seg,
         regexp_replace(replace(split_part(split_part(regexp_replace(regexp_replace(split_part(symbol, '/', -1), '[.#]+$', ''), '\(\)$', ''), ':', -1), '#', -1), '`', ''), '^<[gs]et>', '') AS leaf
  FROM ix_global_symbols),
k_sym AS (
  SELECT *, CASE WHEN symbol LIKE '%/' THEN '(module)' WHEN leaf <> '' THEN leaf ELSE left(seg, 60) END AS name,
         symbol LIKE '%/' AS is_module,
         CASE WHEN symbol LIKE '%#%().' THEN 'method' WHEN symbol LIKE '%().' THEN 'function'
              WHEN symbol LIKE '%#' AND regexp_matches(seg, '^\p{Lu}') THEN 'class'
              WHEN symbol LIKE '%#typeLiteral%' AND symbol LIKE '%:%' AND symbol LIKE '%.' THEN 'property' ELSE 'unknown' END AS kind,
         CASE WHEN seg LIKE '%0:' AND seg NOT LIKE '%().%' THEN left(seg, length(seg) - 2) END AS alias_base,
         CASE WHEN leaf <> '' AND (symbol LIKE '%().' OR (symbol LIKE '%#' AND symbol NOT LIKE '%#typeLiteral%' AND seg NOT LIKE '%().%')) THEN leaf END AS value_base
  FROM k_leaf),
k_def AS (
  SELECT r.symbol_id, r.document_id AS doc_id, r.start_line, r.end_line, r.end_line - r.start_line + 1 AS loc, s.symbol, s.display_name, s.name, s.is_module, s.kind, s.value_base, d.path, d.is_test,
         (d.path LIKE '%/types/prisma/%' OR d.path LIKE '%types/resolvers.ts' OR s.name LIKE '\_%' ESCAPE '\' OR (s.name = 'main' AND d.path LIKE '%/commands/%')) AS clutter
  FROM ix_defs r JOIN k_sym s ON s.symbol_id = r.symbol_id JOIN k_doc d ON d.doc_id = r.document_id),
k_use AS (
  SELECT m.symbol_id, m.role, m.chunk_id, c.document_id AS doc_id, c.start_line AS c_start, c.end_line AS c_end FROM ix_mentions m JOIN ix_chunks c ON c.id = m.chunk_id),
k_live_doc AS (
  SELECT d.doc_id, COUNT(DISTINCT u.doc_id) AS importers FROM k_def d JOIN k_use u ON u.symbol_id = d.symbol_id AND u.role <> 1
  WHERE d.is_module AND u.doc_id <> d.doc_id GROUP BY d.doc_id),
k_alias_home AS (
  SELECT s.symbol_id, s.alias_base, MIN(d.doc_id) AS home FROM k_sym s JOIN k_doc d ON d.path LIKE '%/' || regexp_extract(s.symbol, '`([^`]+)`', 1)
  WHERE s.alias_base <> '' GROUP BY ALL),
k_live_alias AS (
  SELECT DISTINCT h.alias_base AS base FROM k_alias_home h JOIN k_use u ON u.symbol_id = h.symbol_id AND u.role <> 1 AND u.doc_id <> h.home),
k_label AS (
  SELECT d.symbol_id, d.doc_id,
         CASE WHEN d.is_module THEN 'module_import:' || CAST(l.importers AS VARCHAR)
              WHEN d.value_base IS NULL THEN NULL
              WHEN d.value_base IN (SELECT base FROM k_live_alias) THEN 'export_alias'
              ELSE 'default_export:' || CAST(l.importers AS VARCHAR) END AS live
  FROM k_def d LEFT JOIN k_live_doc l ON l.doc_id = d.doc_id),
k_out AS (
  SELECT u.doc_id, COUNT(DISTINCT u.symbol_id) AS fan_out FROM k_use u JOIN k_def d ON d.symbol_id = u.symbol_id
  WHERE u.role NOT IN (1, 2) AND d.doc_id <> u.doc_id GROUP BY u.doc_id),
k_cons AS (
  SELECT d.symbol_id, d.doc_id, COUNT(DISTINCT u.doc_id) AS consumers FROM k_def d LEFT JOIN k_use u ON u.symbol_id = d.symbol_id AND u.role <> 1 AND u.doc_id <> d.doc_id GROUP BY ALL),
k_edge AS (
  SELECT DISTINCT a.doc_id AS from_id, d.doc_id AS to_id, a.path AS from_file, d.path AS to_file, a.is_test AS from_test, d.is_test AS to_test
  FROM k_use u JOIN k_doc a ON a.doc_id = u.doc_id JOIN k_def d ON d.symbol_id = u.symbol_id
  WHERE u.role <> 1 AND a.doc_id <> d.doc_id AND (d.symbol ILIKE '%().' OR (d.symbol NOT ILIKE '%#%' AND d.symbol NOT ILIKE '%/'))),
k_pair AS (
  SELECT d.path AS file1, a.path AS file2, d.is_test AS t1, a.is_test AS t2, COUNT(DISTINCT u.symbol_id) AS shared
  FROM k_use u JOIN k_def d ON d.symbol_id = u.symbol_id JOIN k_doc a ON a.doc_id = u.doc_id WHERE u.role <> 1 AND a.doc_id <> d.doc_id GROUP BY ALL)
"""

_ELSEWHERE = "EXISTS (SELECT 1 FROM k_use u WHERE u.symbol_id = d.symbol_id AND u.role <> 1 AND u.doc_id <> d.doc_id)"
_OWN_REF = "EXISTS (SELECT 1 FROM k_use u WHERE u.symbol_id = d.symbol_id AND u.role = 0 AND u.doc_id = d.doc_id)"
_OWN_OTHER = "EXISTS (SELECT 1 FROM k_use u WHERE u.symbol_id = d.symbol_id AND u.role <> 1 AND u.doc_id = d.doc_id)"
_ANY_REF = "EXISTS (SELECT 1 FROM k_use u WHERE u.symbol_id = d.symbol_id AND u.role = 0)"
_REF_ELSEWHERE = "EXISTS (SELECT 1 FROM k_use u WHERE u.symbol_id = d.symbol_id AND u.role = 0 AND u.doc_id <> d.doc_id)"
_LIVE = "(SELECT live FROM k_label l WHERE l.symbol_id = d.symbol_id AND l.doc_id = d.doc_id)"
_IMPORTED = "d.doc_id IN (SELECT x.doc_id FROM k_def x JOIN k_use u ON u.symbol_id = x.symbol_id WHERE u.role <> 1 AND u.doc_id <> x.doc_id)"
_PLACE = "CAST(d.start_line AS BIGINT) AS start_line, CAST(d.end_line AS BIGINT) AS end_line"
_DEAD = f"NOT d.clutter AND NOT d.is_module AND {_LIVE} IS NULL"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _resolve(name: str, kind: str | None) -> str:
    *parts, leaf = name.split(".")
    exact = " OR ".join(f"symbol ILIKE {_quote(p)}" for p in (f"%/{leaf}().", f"%/{leaf}#", f"%/{leaf}.", f"%#{leaf}().", f"%#{leaf}.", f"%typeLiteral%:{leaf}."))
    cheap = {"class": "symbol LIKE '%#'", "method": "symbol LIKE '%#%' AND symbol LIKE '%().'", None: "TRUE"}[kind]
    loose = f"symbol ILIKE {_quote(f'%{leaf}%')} AND (contains(seg, {_quote(leaf)}) OR contains(leaf, {_quote(leaf)}))"
    inside = f"AND contains(seg, {_quote('#'.join(parts) + '#' + leaf)}) AND symbol NOT LIKE '%).(%'" if parts else ""
    rows = f"SELECT symbol_id, symbol, seg, CASE WHEN {exact} THEN 0 WHEN {loose} THEN 1 END AS tier FROM k_sym WHERE {cheap}"
    return f"SELECT {_quote(name)} AS asked, symbol_id, symbol FROM ({rows}) t WHERE tier = (SELECT MIN(tier) FROM ({rows}) u) {inside}"


def _resolve_file(pattern: str) -> str:
    base = pattern.rsplit("/", 1)[-1]
    name, stem = "split_part(path, '/', -1)", "regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '')"
    if "/" in pattern:
        near = f"path ILIKE {_quote('%' + pattern)}"
    elif "." in pattern:
        near = f"path ILIKE {_quote('%/' + base)}"
    else:
        near = " OR ".join(f"path ILIKE {_quote('%/' + base + x)}" for x in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py"))
        near = f"{near} OR (path ILIKE {_quote('%' + pattern + '%')} AND {stem} = {_quote(pattern)})"
    rows = f"SELECT path, CASE WHEN path = {_quote(pattern)} OR {near} THEN 0 WHEN path ILIKE {_quote('%' + pattern + '%')} THEN 1 END AS tier FROM k_doc"
    wanted = _quote(base if "." in pattern else pattern)
    rank = f"ROW_NUMBER() OVER (ORDER BY NOT ({name} = {wanted} OR {stem} = {wanted}), contains({name}, '.test.') OR {name} LIKE '%.spec.ts' OR {name} LIKE '%.spec.tsx', path)"
    return f"SELECT {_quote(pattern)} AS asked, path, {rank} AS rank FROM ({rows}) t WHERE tier = (SELECT MIN(tier) FROM ({rows}) u)"


_FIRST_RANGE = "(SELECT symbol_id, arg_min(document_id, id) AS doc_id, arg_min(start_line, id) AS low, arg_min(end_line, id) AS high FROM ix_defs GROUP BY symbol_id)"
_CALLEE = "JOIN k_def d ON d.symbol_id = u.symbol_id JOIN k_sym s ON s.symbol_id = u.symbol_id"
_NOT_VARIABLE = "NOT (symbol LIKE '%.' AND symbol NOT LIKE '%().' AND symbol NOT ILIKE '%#typeLiteral%' AND symbol NOT LIKE '%).(%')"
_PRUNED = f"SELECT id FROM ix_global_symbols WHERE ({_NOT_VARIABLE} AND id IN (SELECT symbol_id FROM ix_defs)) OR symbol ILIKE '%typeLiteral%' OR symbol LIKE '%).(%' OR symbol LIKE '%().%'"
_LINES = f"""ix_text AS (
  SELECT x.doc_id AS document_id, CAST(i AS BIGINT) AS line_no, COALESCE(x.parts[i + 1], '') AS text
  FROM (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS parts FROM documents WHERE doc_id IN (SELECT id FROM ix_documents)) x, UNNEST(range(greatest(len(x.parts), 200))) AS t(i)),
{CODE.strip()}, k_line AS (
  SELECT d.path, t.line_no, COALESCE(c.code, t.text) AS text FROM ix_text t JOIN k_doc d ON d.doc_id = t.document_id
  LEFT JOIN (SELECT document_id, line_no, MIN(code) AS code FROM ix_code GROUP BY document_id, line_no) c ON c.document_id = t.document_id AND c.line_no = t.line_no)"""
_PATH_OF = """k_named AS (
  SELECT symbol_id, replace(list_aggregate(list_slice(regexp_split_to_array(trim(split_part(symbol, '`', 1)), '\\s+'), 5, 99), 'string_agg', ' '), '`', '') || regexp_extract(symbol, '`([^`]+)`', 1) AS path FROM k_sym)"""

_SELECTS: dict[str, str] = {
    "hotspots": "SELECT d.symbol_id, d.name, d.path, COUNT(*) AS refs, COUNT(DISTINCT u.doc_id) AS files FROM k_def d JOIN k_use u ON u.symbol_id = d.symbol_id WHERE u.role <> 1 AND NOT d.is_module AND NOT d.clutter AND NOT d.is_test GROUP BY d.symbol_id, d.name, d.path",
    "bottlenecks": "SELECT d.symbol_id, d.name, d.path, c.consumers AS fan_in, o.fan_out, CAST(d.loc AS BIGINT) AS loc, c.consumers * o.fan_out AS score FROM k_def d JOIN k_cons c USING (symbol_id, doc_id) JOIN k_out o ON o.doc_id = d.doc_id WHERE c.consumers > 0 AND NOT d.is_module AND NOT d.clutter AND NOT d.is_test",
    "unreferenced": f"SELECT d.symbol_id, d.name, d.path, CAST(d.loc AS BIGINT) AS loc FROM k_def d WHERE NOT {_ANY_REF} AND NOT {_ELSEWHERE} AND NOT {_OWN_OTHER} AND {_DEAD} AND NOT d.is_test",
    "dead_exports": f"SELECT d.symbol_id, d.name, d.path, CAST(d.loc AS BIGINT) AS loc FROM k_def d WHERE NOT {_ELSEWHERE} AND NOT {_OWN_REF} AND NOT {_OWN_OTHER} AND {_DEAD} AND NOT d.is_test",
    "stale_types": f"SELECT d.symbol_id, d.name, d.path, CAST(0 AS BIGINT) AS consumers FROM k_def d WHERE d.symbol LIKE '%#' AND d.symbol NOT ILIKE '%#typeLiteral%' AND NOT {_ELSEWHERE} AND NOT {_OWN_REF} AND NOT d.clutter AND NOT d.is_test AND d.name NOT LIKE '%Props' AND {_LIVE} IS NULL",
    "same_file_only": f"SELECT d.symbol_id, d.name, d.path, CAST(d.loc AS BIGINT) AS loc FROM k_def d WHERE {_OWN_REF} AND NOT {_REF_ELSEWHERE} AND NOT d.clutter AND NOT d.is_test AND NOT (d.value_base IS NOT NULL AND {_LIVE} IS NOT NULL) AND {_IMPORTED}",
    "test_only": f"SELECT d.symbol_id, d.name, d.path, COUNT(DISTINCT u.doc_id) AS test_consumers FROM k_def d JOIN k_use u ON u.symbol_id = d.symbol_id AND u.role <> 1 AND u.doc_id <> d.doc_id JOIN k_doc a ON a.doc_id = u.doc_id WHERE NOT d.clutter AND NOT d.is_test AND NOT {_OWN_REF} GROUP BY d.symbol_id, d.name, d.path HAVING bool_and(a.is_test)",
    "top_coupling": "SELECT file1, file2, shared FROM k_pair WHERE NOT t1 AND NOT t2",
    "unreferenced_in_file": f"SELECT d.path, d.symbol_id, d.name, {_PLACE} FROM k_def d WHERE NOT {_ANY_REF} AND NOT {_ELSEWHERE} AND {_DEAD}",
    "dead_in_file": f"SELECT d.path, d.symbol_id, d.name, {_PLACE} FROM k_def d WHERE NOT {_ELSEWHERE} AND NOT {_OWN_REF} AND {_DEAD}",
    "same_file_only_in_file": f"SELECT d.path, d.symbol_id, d.name, {_PLACE} FROM k_def d WHERE {_OWN_REF} AND NOT {_REF_ELSEWHERE} AND NOT d.clutter AND NOT (d.value_base IS NOT NULL AND {_LIVE} IS NOT NULL) AND {_IMPORTED}",
    "unused_imports": "SELECT a.path, u.symbol_id, s.name, u.chunk_id FROM k_use u JOIN k_doc a ON a.doc_id = u.doc_id JOIN k_sym s ON s.symbol_id = u.symbol_id WHERE u.role = 2 AND NOT EXISTS (SELECT 1 FROM k_use v WHERE v.symbol_id = u.symbol_id AND v.doc_id = u.doc_id AND v.role NOT IN (1, 2))",
    "change_surface": f"SELECT d.path, d.symbol_id, d.name, {_PLACE}, c.consumers, CASE WHEN c.consumers > 10 THEN 'high' WHEN c.consumers > 0 THEN 'medium' ELSE 'low' END AS risk FROM k_def d JOIN k_cons c USING (symbol_id, doc_id)",
    "file_consumers": "SELECT file1 AS path, file2 AS consumer, shared AS symbols FROM k_pair",
    "coupling_for": "SELECT file1 AS path, file2 AS other_file, shared FROM k_pair UNION ALL SELECT file2, file1, shared FROM k_pair",
    "imports_summary": "SELECT a.path, u.symbol_id, s.name, u.chunk_id, COALESCE(d.path, '(external)') AS from_file, (SELECT COUNT(DISTINCT v.symbol_id) FROM k_use v WHERE v.doc_id = u.doc_id AND v.role = 2) AS total FROM k_use u JOIN k_doc a ON a.doc_id = u.doc_id JOIN k_sym s ON s.symbol_id = u.symbol_id LEFT JOIN k_def d ON d.symbol_id = u.symbol_id WHERE u.role = 2",
    "top_symbol_pressure": "SELECT path, symbol_id, name, consumers, loc, consumers AS fan_in, fan_out, consumers * fan_out AS pressure FROM (SELECT d.path, d.symbol_id, d.name, c.consumers, CAST(d.loc AS BIGINT) AS loc, COALESCE(o.fan_out, 0) AS fan_out, ROW_NUMBER() OVER (PARTITION BY d.doc_id ORDER BY c.consumers DESC, d.start_line, d.symbol_id) AS n FROM k_def d JOIN k_cons c USING (symbol_id, doc_id) LEFT JOIN k_out o ON o.doc_id = d.doc_id WHERE c.consumers > 0) t WHERE n <= 5",
    "consumer_files": "SELECT d.symbol_id, a.path, COUNT(*) AS refs FROM k_def d JOIN k_use u ON u.symbol_id = d.symbol_id AND u.role <> 1 AND u.doc_id <> d.doc_id JOIN k_doc a ON a.doc_id = u.doc_id GROUP BY d.symbol_id, a.path",
    "dependencies": "SELECT DISTINCT t.symbol_id, d.symbol_id AS callee_id, d.name, d.path FROM k_def t JOIN k_use u ON u.doc_id = t.doc_id AND u.role NOT IN (1, 2) JOIN k_def d ON d.symbol_id = u.symbol_id AND d.doc_id <> t.doc_id",
    "symbol_pressure": "SELECT d.symbol_id, d.name, CAST(d.loc AS BIGINT) AS loc, c.consumers AS fan_in, COALESCE(o.fan_out, 0) AS fan_out, c.consumers * COALESCE(o.fan_out, 0) AS pressure FROM k_def d JOIN k_cons c USING (symbol_id, doc_id) LEFT JOIN k_out o ON o.doc_id = d.doc_id",
    "def_context": f"SELECT d.symbol_id, d.name, d.kind, d.path, {_PLACE}, COALESCE(d.display_name, '-') AS display_name, (SELECT COUNT(*) FROM k_sym s WHERE starts_with(s.symbol, d.symbol) AND s.symbol <> d.symbol) AS members FROM k_def d",
    "affected": "SELECT DISTINCT symbol_id, CAST(depth AS BIGINT) AS depth FROM k_reach WHERE depth > 0",
    "file_edges": "SELECT from_file, to_file FROM k_edge",
    "cycles_two_way": "SELECT a.from_file AS file1, a.to_file AS file2 FROM k_edge a JOIN k_edge b ON a.from_file = b.to_file AND a.to_file = b.from_file WHERE a.from_file < a.to_file AND NOT a.from_test AND NOT a.to_test",
    "cycles_longer": "SELECT array_to_string(w.files, ' -> ') AS cycle FROM k_walk w JOIN k_step e ON e.from_file = w.last AND e.to_file = w.first WHERE len(w.files) > 2",
    "components": "SELECT n.node, LEAST(n.node, COALESCE((SELECT MIN(r.b) FROM k_path r JOIN k_path q ON q.a = r.b AND q.b = r.a WHERE r.a = n.node), n.node)) AS component FROM (SELECT from_id AS node FROM k_edge UNION SELECT to_id FROM k_edge) n",
    "symbol_scalars": "SELECT symbol_id, leaf, name AS short, kind, (symbol LIKE '%.' AND symbol NOT LIKE '%().' AND symbol NOT LIKE '%#typeLiteral%' AND symbol NOT LIKE '%).(%') AS is_variable, symbol LIKE '%).(%' AS is_parameter, (symbol NOT LIKE '%/' AND symbol NOT LIKE '%().' AND (symbol LIKE '%#typeLiteral%' OR seg LIKE '%#%')) AS is_type, (symbol LIKE '%().' OR (symbol NOT LIKE '%#%' AND symbol NOT LIKE '%/')) AS is_runtime_edge, alias_base, value_base, path AS file_path FROM k_sym JOIN k_named USING (symbol_id)",
    "path_scalars": f"SELECT path, is_test, (path LIKE '%/types/prisma/%' OR path LIKE '%types/resolvers.ts') AS is_generated, (path = {_quote(FOLDER)} OR starts_with(path, {_quote(FOLDER + '/')})) AS in_scope FROM k_doc",
    "noise": "SELECT symbol_id, path, clutter OR is_test AS noise, clutter AS noise_with_tests, (name LIKE '%Props' AND split_part(symbol, '/', -1) LIKE '%#%') AS is_props FROM k_def",
    "live_modules": "SELECT doc_id, importers FROM k_live_doc",
    "live_aliases": "SELECT base FROM k_live_alias",
    "liveness": "SELECT symbol_id, doc_id, live FROM k_label",
    "files_with_importers": "SELECT DISTINCT d.doc_id FROM k_def d JOIN k_use u ON u.symbol_id = d.symbol_id AND u.role <> 1 AND u.doc_id <> d.doc_id",
    "fan_out": "SELECT doc_id, fan_out FROM k_out",
    "sym_ref_docs": "SELECT symbol_id, doc_id, CAST(SUM(CASE WHEN role <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_other, CAST(SUM(CASE WHEN role = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_ref, CAST(SUM(CASE WHEN role = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_import, CAST(SUM(CASE WHEN role NOT IN (1, 2) THEN 1 ELSE 0 END) AS BIGINT) AS n_use FROM k_use GROUP BY symbol_id, doc_id",
    "resolve_symbol": " UNION ALL ".join(_resolve(*n) for n in NAMES),
    "resolve_file": " UNION ALL ".join(_resolve_file(p) for p in FILES),
    "paths_in_scope": f"SELECT path FROM k_doc WHERE path = {_quote(FOLDER)} OR starts_with(path, {_quote(FOLDER + '/')})",
    "outermost": "SELECT a.path FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS path FROM k_doc UNION SELECT split_part(path, '/', 1) FROM k_doc) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS path FROM k_doc) b WHERE starts_with(b.path, a.path || '/'))",
    "file_symbols": "SELECT d.path, d.symbol_id, s.leaf AS name, d.kind, CAST(d.start_line AS BIGINT) AS start_line, CAST(d.end_line AS BIGINT) AS end_line, COUNT(*) OVER (PARTITION BY d.path, s.leaf) AS freq FROM k_def d JOIN k_sym s ON s.symbol_id = d.symbol_id WHERE NOT d.is_module",
    "importers": "SELECT DISTINCT d.path, a.path AS importer FROM k_def d JOIN k_use u ON u.symbol_id = d.symbol_id AND u.role <> 1 JOIN k_doc a ON a.doc_id = u.doc_id WHERE a.path <> d.path",
    "members": r"SELECT p.symbol_id AS parent_id, c.symbol_id, c.leaf AS name, c.kind, CAST(r.start_line AS BIGINT) AS start_line, CAST(r.end_line AS BIGINT) AS end_line FROM k_sym p JOIN k_sym c ON starts_with(c.symbol, p.symbol) AND c.symbol <> p.symbol LEFT JOIN ix_defs r ON r.symbol_id = c.symbol_id WHERE c.symbol NOT LIKE '%).(%' AND CASE WHEN substr(c.symbol, length(p.symbol) + 1) LIKE 'typeLiteral%' THEN regexp_matches(substr(c.symbol, length(p.symbol) + 1), '^typeLiteral\d+:[^#]+\.') ELSE regexp_matches(substr(c.symbol, length(p.symbol) + 1), '^[^#]+#$') OR NOT contains(split_part(substr(c.symbol, length(p.symbol) + 1), '().', 1), '#') END",
    "def_location": f"SELECT f.symbol_id, d.path, CAST(f.low AS BIGINT) AS start_line, CAST(f.high AS BIGINT) AS end_line FROM {_FIRST_RANGE} f JOIN k_doc d ON d.doc_id = f.doc_id",
    "document_path": "SELECT symbol_id, path FROM k_named",
    "external_ref_count": f"SELECT s.symbol_id, (SELECT COUNT(DISTINCT u.doc_id) FROM k_use u WHERE u.symbol_id = s.symbol_id AND u.role <> 1 AND u.doc_id <> COALESCE(f.doc_id, -1)) AS files FROM k_sym s LEFT JOIN {_FIRST_RANGE} f ON f.symbol_id = s.symbol_id",
    "deps_symbol": f"SELECT DISTINCT f.symbol_id, d.symbol_id AS callee_id, s.leaf AS name, d.path, CAST(d.start_line AS BIGINT) AS start_line FROM {_FIRST_RANGE} f JOIN k_use u ON u.doc_id = f.doc_id AND u.role <> 1 AND u.c_start <= f.high AND u.c_end >= f.low AND u.symbol_id <> f.symbol_id {_CALLEE}",
    "deps_file": f"SELECT DISTINCT a.path AS from_path, d.symbol_id AS callee_id, s.leaf AS name, d.path, CAST(d.start_line AS BIGINT) AS start_line FROM k_doc a JOIN k_use u ON u.doc_id = a.doc_id AND u.role <> 1 {_CALLEE} WHERE NOT EXISTS (SELECT 1 FROM ix_defs o WHERE o.symbol_id = u.symbol_id AND o.document_id = a.doc_id)",
    "search": f"SELECT s.symbol_id, n.path, CAST(f.low AS BIGINT) + 1 AS line, s.kind, s.leaf AS name FROM k_sym s JOIN k_named n ON n.symbol_id = s.symbol_id LEFT JOIN {_FIRST_RANGE} f ON f.symbol_id = s.symbol_id WHERE ({' OR '.join(f'symbol ILIKE {_quote(f"%{p}%")}' for p in PATTERNS)}) AND NOT s.is_module AND s.symbol NOT LIKE '%/__init__:' AND NOT (s.symbol LIKE '%typeLiteral%' AND s.kind <> 'property') AND s.symbol NOT LIKE '%).(%'",
    "prune_symbols": f"SELECT id, symbol FROM ix_global_symbols WHERE id IN ({_PRUNED})",
    "prune_symbols_external": f"SELECT id, symbol FROM ix_global_symbols WHERE {_NOT_VARIABLE}",
    "prune_mentions": f"SELECT chunk_id, symbol_id, CAST(role AS BIGINT) AS role FROM ix_mentions WHERE symbol_id IN ({_PRUNED})",
    "prune_defs": f"SELECT id, document_id, symbol_id FROM ix_defs WHERE symbol_id IN ({_PRUNED})",
    "reroot_paths": f"SELECT id, {_quote(ROOT + '/')} || relative_path AS relative_path FROM ix_documents",
    "merge_documents": "SELECT relative_path FROM ix_documents",
    "merge_symbols": "SELECT symbol, display_name FROM ix_global_symbols",
    "merge_chunks": "SELECT d.path, CAST(c.chunk_index AS BIGINT) AS chunk_index, CAST(c.start_line AS BIGINT) AS start_line, CAST(c.end_line AS BIGINT) AS end_line FROM ix_chunks c JOIN k_doc d ON d.doc_id = c.document_id",
    "merge_mentions": f"SELECT d.path, CAST(c.chunk_index AS BIGINT) AS chunk_index, s.symbol, CAST(m.role AS BIGINT) AS role FROM ix_mentions m JOIN ix_chunks c ON c.id = m.chunk_id JOIN k_doc d ON d.doc_id = c.document_id JOIN k_sym s ON s.symbol_id = m.symbol_id",
    "merge_ranges": "SELECT d.path, s.symbol, CAST(r.start_line AS BIGINT) AS start_line, CAST(r.end_line AS BIGINT) AS end_line FROM ix_defs r JOIN k_doc d ON d.doc_id = r.document_id JOIN k_sym s ON s.symbol_id = r.symbol_id",
    "refs_lines": "SELECT DISTINCT u.symbol_id, d.path, COALESCE((SELECT MIN(l.line_no) FROM k_line l WHERE l.path = d.path AND l.line_no BETWEEN u.c_start AND u.c_end AND s.leaf <> '' AND contains(l.text, s.leaf) AND regexp_matches(l.text, '(^|[^\\pL\\pN_$`])' || regexp_escape(s.leaf) || '($|[^\\pL\\pN_$`])')), u.c_start) + 1 AS line FROM k_use u JOIN k_doc d ON d.doc_id = u.doc_id JOIN k_sym s ON s.symbol_id = u.symbol_id WHERE u.role <> 1",
    "code_body": "SELECT symbol_id, path, start_line, start_line + LEAST(n, 80) - 1 AS shown_end, CASE WHEN length(b) > 32000 THEN regexp_replace(left(b, 32000), '\\n+$', '') || chr(10) || '...' ELSE b END AS body, n > 80 OR length(b) > 32000 AS truncated FROM (SELECT t.symbol_id, t.path, t.start_line, COUNT(*) AS n, regexp_replace(string_agg(CASE WHEN l.line_no < t.start_line + 80 THEN l.text END, chr(10) ORDER BY l.line_no), '\\n+$', '') AS b FROM (SELECT r.symbol_id, d.path, CAST(r.start_line AS BIGINT) AS start_line, r.end_line FROM ix_defs r JOIN k_doc d ON d.doc_id = r.document_id UNION ALL SELECT symbol_id, path, start_line, start_line FROM k_found) t JOIN k_line l ON l.path = t.path AND l.line_no BETWEEN t.start_line AND t.end_line GROUP BY ALL) x",
    "fallback_def": "SELECT s.symbol_id, n.path, MIN(l.line_no) AS start_line FROM k_sym s JOIN k_named n ON n.symbol_id = s.symbol_id JOIN k_line l ON l.path = n.path WHERE s.symbol_id NOT IN (SELECT symbol_id FROM ix_defs) AND contains(l.text, s.leaf) AND regexp_matches(l.text, '^\\s*((async\\s+)?' || regexp_escape(s.leaf) || '\\s*[(<]|((public|private|protected|static|readonly)\\s+)*' || regexp_escape(s.leaf) || '\\s*\\??\\s*[:=(])') GROUP BY s.symbol_id, n.path",
}
# A member without a range: the first line of its parent's range that declares it.
_SELECTS["member_lines"] = f"""SELECT m.parent_id, m.symbol_id, m.name, m.kind, COALESCE(m.start_line, h.hit) AS start_line, COALESCE(m.end_line, h.hit) AS end_line
  FROM ({_SELECTS["members"]}) m LEFT JOIN (
    SELECT m.parent_id, m.symbol_id, MIN(l.line_no) AS hit
    FROM ({_SELECTS["members"]}) m JOIN {_FIRST_RANGE} f ON f.symbol_id = m.parent_id JOIN k_doc d ON d.doc_id = f.doc_id
    JOIN k_line l ON l.path = d.path AND l.line_no BETWEEN f.low AND f.high
    WHERE m.start_line IS NULL AND contains(l.text, m.name) AND regexp_matches(l.text, '^\\s*((public|private|protected|static|readonly)\\s+)*' || regexp_escape(m.name) || '\\s*\\??\\s*[:=(]')
    GROUP BY m.parent_id, m.symbol_id) h ON h.parent_id = m.parent_id AND h.symbol_id = m.symbol_id"""
_SELECTS["resolved_locations"] = f"""{_SELECTS["def_location"]} UNION ALL SELECT symbol_id, path, start_line, start_line AS end_line FROM ({_SELECTS["fallback_def"]}) x"""

_EXTRA = {
    "affected": "k_hub AS (SELECT symbol_id FROM k_cons ORDER BY consumers DESC, symbol_id LIMIT 1), k_reach(symbol_id, depth) AS (SELECT symbol_id, 0 FROM k_hub UNION SELECT d.symbol_id, r.depth + 1 FROM k_reach r JOIN k_use u ON u.symbol_id = r.symbol_id AND u.role <> 1 JOIN k_def d ON d.doc_id = u.doc_id WHERE r.depth < 5 AND d.symbol_id <> r.symbol_id)",
    "cycles_longer": "k_step AS (SELECT from_file, to_file FROM k_edge WHERE NOT from_test AND NOT to_test), k_walk(first, last, files) AS (SELECT from_file, to_file, [from_file, to_file] FROM k_step WHERE from_file < to_file UNION ALL SELECT w.first, e.to_file, list_append(w.files, e.to_file) FROM k_walk w JOIN k_step e ON e.from_file = w.last WHERE len(w.files) < 8 AND e.to_file > w.first AND NOT list_contains(w.files, e.to_file))",
    "components": "k_path(a, b) AS (SELECT from_id, to_id FROM k_edge UNION SELECT p.a, e.to_id FROM k_path p JOIN k_edge e ON e.from_id = p.b)",
    "symbol_scalars": _PATH_OF, "document_path": _PATH_OF, "search": _PATH_OF,
    "refs_lines": _LINES,  "fallback_def": _LINES + ", " + _PATH_OF, "resolved_locations": _LINES + ", " + _PATH_OF, "member_lines": _LINES,
}
_EXTRA["code_body"] = f"{_LINES}, {_PATH_OF}, k_found AS ({_SELECTS['fallback_def']})"


def oracle_sql() -> dict[str, str]:
    """The statements by query name."""
    out = {}
    for name, select in _SELECTS.items():
        extra = f", {_EXTRA[name]}" if name in _EXTRA else ""
        out[name] = f"WITH RECURSIVE {PRELUDE.strip()}, {_HELPERS.strip()}{extra} {select}"
    return out
