"""DuckDB definitions of the views in sources.tables, for the SQL that queries are held against."""

from __future__ import annotations

VIEWS = {
    "fx_files": """SELECT 'src/' || source || '/' || lang || '/d' || doc_id || '/' || CASE WHEN doc_id % 5 = 0 THEN CASE ext WHEN 'yaml' THEN 'Chart' WHEN 'md' THEN 'README' WHEN 'css' THEN 'styles'
 WHEN 'xml' THEN 'pom' WHEN 'zig' THEN 'build' WHEN 'sh' THEN 'run' ELSE 'main' END ELSE 'doc_' || doc_id END || '.' || ext AS path, text AS content
 FROM (SELECT *, (['rs','py','ts','go','zig','sh','tf','yaml','html','css','xml','md','js'])[doc_id % 13 + 1] AS ext FROM documents)
 UNION ALL SELECT 'web/p' || page_id || '/index.html', html FROM pages""",
    "fx_lines": """SELECT path, unnest(generate_series(1, len(parts)))::BIGINT AS line_no, unnest(parts) AS text FROM (
 SELECT path, string_split_regex(regexp_replace(content, '\\r?\\n\\z', ''), '\\r?\\n') AS parts FROM fx_files WHERE content <> '')""",
    "fx_symbols": """SELECT 'conv/c' || conv_id || '.py' AS file, role || '_' || turn AS name, CASE WHEN role = 'system' THEN 'Module' ELSE 'Function' END AS kind,
 (coalesce(sum(n) OVER w, 0) + 1)::BIGINT AS line_start, (coalesce(sum(n) OVER w, 0) + n)::BIGINT AS line_end, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::BIGINT AS ordinal
 FROM (SELECT *, len(string_split(text, chr(10))) AS n FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "fx_turns": """SELECT file, line_start + i - 1 AS line_no, text FROM (SELECT file, line_start, unnest(generate_series(1, len(parts)))::BIGINT AS i, unnest(parts) AS text FROM (
 SELECT 'conv/c' || conv_id || '.py' AS file, (coalesce(sum(len(string_split(text, chr(10)))) OVER w, 0) + 1)::BIGINT AS line_start, string_split(text, chr(10)) AS parts
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))""",
    "fx_classes": """SELECT file, 'Class' || width || '_' || g AS name, line_start, line_end, width FROM (SELECT file, width, ordinal // width AS g, min(line_start) AS line_start, max(line_end) AS line_end
 FROM fx_symbols, (VALUES (2::BIGINT), (4::BIGINT)) AS w(width) WHERE kind = 'Function' GROUP BY ALL)""",
    "fx_calls": """SELECT * FROM (SELECT file, name AS caller, lag(name) OVER (PARTITION BY file ORDER BY ordinal) AS callee, line_start AS line FROM fx_symbols) WHERE callee IS NOT NULL""",
    "fx_edges": """SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION ALL
 SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders UNION ALL SELECT 'O' || l_orderkey, 'S' || l_suppkey FROM lineitem UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier""",
    "fx_actions": """SELECT user_id AS workspace, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS id, ts, event_type AS command, event_id FROM events""",
    "fx_objects": """SELECT doc_id, sha256(text) AS hash, strlen(text)::BIGINT AS size FROM documents""",
    "fx_referenced": """SELECT DISTINCT hash FROM fx_objects JOIN labels USING (doc_id) WHERE quality = 1""",
    "fx_hunks": """SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate)::BIGINT AS hunk_no,
 l_quantity::BIGINT AS old_count, l_quantity::BIGINT + round(l_tax * 100)::BIGINT - 4 AS new_count FROM lineitem""",
    "fx_ranges": """SELECT path, s, e FROM (SELECT path, count(*) AS n FROM fx_lines WHERE path LIKE '%.py' GROUP BY path), (VALUES (3, 2::BIGINT, 3::BIGINT), (5, 5, 5), (9, 8, 9)) AS r(least, s, e) WHERE n >= least""",
}
NEEDS = {"fx_lines": ["fx_files"], "fx_classes": ["fx_symbols"], "fx_calls": ["fx_symbols"], "fx_referenced": ["fx_objects"], "fx_ranges": ["fx_files", "fx_lines"]}


def with_views(sql: str) -> str:
    """The query behind the definitions of the views it names."""
    wanted = {v for v in VIEWS if v in sql}
    wanted |= {n for v in wanted for n in NEEDS.get(v, ())}
    ahead = ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in wanted)
    if not ahead:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ahead}, {body[15:]}"
    return f"WITH {ahead}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ahead} {body}"
