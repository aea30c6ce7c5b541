"""Queries of headers, levels and showing: conversations are files of functions, whose first line is the signature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treequarry.functions import text as T
from treequarry.operators import render
from treequarry.plans.registry import query
from treequarry.sources import tables as S


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of conversations as the renderer takes them; bodies begin on the second line where there is one."""
    body = F.least(F.col("line_start") + 1, "line_end")
    signature = F.when(F.col("kind") == "Function", F.concat(F.lit("fn "), "name", F.lit("()"))).otherwise(F.concat(F.lit("mod "), "name"))
    return S.symbols(spark, sf_dir).withColumns({"body_start": body, "body_end": F.col("line_end"), "signature": signature, "owner": F.lit(None).cast("string")})


@query(
    "WITH w AS (SELECT *, lag(line_end) OVER (PARTITION BY file ORDER BY line_start, ordinal) AS before, lead(line_start) OVER (PARTITION BY file ORDER BY line_start, ordinal) AS next FROM fx_symbols WHERE kind = 'Function'),"
    " g AS (SELECT t.file, t.line_no, t.text, (SELECT count(*) FROM w WHERE w.file = t.file AND w.line_end < t.line_no) AS place FROM fx_turns t WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.file = t.file AND t.line_no BETWEEN w.line_start AND w.line_end))"
    " SELECT file, line_no, text || chr(10) AS text FROM (SELECT *, bool_or(regexp_matches(text, '\\S')) OVER (PARTITION BY file, place) AS told FROM g) WHERE told"
    " UNION ALL SELECT w.file, line_start, CASE WHEN line_end > line_start THEN regexp_replace(t.text, '\\s+$', '') || chr(10) || '    ...  # ' || (line_end - line_start) ELSE 'fn ' || name || '()' || chr(10) || '    ...  # 1' END || ' lines hidden' || chr(10) FROM w JOIN fx_turns t ON t.file = w.file AND t.line_no = line_start"
)
def m8_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What system turns say stands between the functions."""
    return render.headers(S.conversation_lines(spark, sf_dir), turns(spark, sf_dir).filter("kind = 'Function'")).select("file", "line_no", "text")


@query(
    "WITH s AS (SELECT file, ordinal, line_start, CASE WHEN kind <> 'Function' THEN line_start WHEN EXISTS (SELECT 1 FROM fx_calls c WHERE c.file = x.file AND c.callee = x.name) THEN line_end ELSE least(line_start + 1, line_end) END AS last FROM fx_symbols x),"
    " o AS (SELECT *, lag(last) OVER (PARTITION BY file ORDER BY line_start, ordinal) AS before FROM s)"
    " SELECT file, line_start AS line_no, 0 AS part, '// ...' || chr(10) AS text FROM o WHERE line_start > before + 1 UNION ALL SELECT s.file, t.line_no, 1, t.text || chr(10) FROM s JOIN fx_turns t ON t.file = s.file AND t.line_no BETWEEN s.line_start AND s.last"
)
def m9_level_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.level(S.conversation_lines(spark, sf_dir), turns(spark, sf_dir), S.calls(spark, sf_dir), 2).select("file", "line_no", "part", "text")


_mode = "CASE WHEN nth % 5 = 0 THEN 'headers' WHEN nth % 5 = 1 THEN 'partial' ELSE 'outline' END"
_shown = "CASE WHEN line_no > 9999 THEN line_no::VARCHAR ELSE lpad(line_no::VARCHAR, 4, ' ') END || ' | ' || "


@query(
    f"WITH f AS (SELECT file, {_mode} AS mode FROM (SELECT DISTINCT 'conv/c' || conv_id || '.py' AS file, conv_id AS nth FROM conversations))"
    ", n AS (SELECT file, count_if(kind = 'Function') AS f, max(line_end) AS size FROM fx_symbols GROUP BY file)"
    " SELECT file, 'File: ' || file || CASE WHEN mode = 'headers' THEN ' [HEADERS VEILED]' ELSE '' END AS text FROM f WHERE mode <> 'outline'"
    f" UNION ALL SELECT file, {_shown} CASE WHEN mode = 'partial' AND line_no % 3 = 1 THEN '[veiled] ...' ELSE text END FROM f JOIN fx_turns USING (file) WHERE mode <> 'outline'"
    " UNION ALL SELECT file, unnest(['# ' || file, '# ' || n.f || ' functions · 0 classes · Python', '']) FROM f JOIN n USING (file) WHERE mode = 'outline'"
    " UNION ALL SELECT file, unnest([CASE WHEN kind = 'Function' THEN 'fn ' || name || '()' ELSE 'mod ' || name END || '    # line ' || line_start, '']) FROM f JOIN fx_symbols USING (file) WHERE mode = 'outline' AND name <> 'user_1'"
    " UNION ALL SELECT file, '    ' || trim(text, ' ') FROM f JOIN fx_symbols s USING (file) JOIN n USING (file) JOIN fx_turns t USING (file) WHERE mode = 'outline' AND name <> 'user_1' AND s.line_start < n.size AND t.line_no BETWEEN s.line_start AND least(s.line_start + 2, s.line_end) AND regexp_matches(trim(text, ' '), '^(\"\"\"|///|/\\*\\*|#)')"
    " UNION ALL SELECT file, '    ... ' || (line_end - line_start) || ' lines' FROM f JOIN fx_symbols USING (file) WHERE mode = 'outline' AND name <> 'user_1' AND line_end > line_start"
    f" UNION ALL SELECT file, {_shown} text FROM f JOIN fx_symbols s USING (file) JOIN fx_turns t USING (file) WHERE mode = 'outline' AND name = 'user_1' AND t.line_no BETWEEN s.line_start AND s.line_end"
    " UNION ALL SELECT file, '' FROM f JOIN fx_symbols USING (file) WHERE mode = 'outline' AND name = 'user_1'"
)
def m27_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five files one is hidden to its headers and one by ranges; the others show their outline with one turn opened."""
    lines = S.conversation_lines(spark, sf_dir)
    nth = F.regexp_extract("file", "c([0-9]+)", 1).cast("long") % 5
    tracked = lines.filter(nth == 0).select("file").distinct()
    hidden = lines.filter((nth == 1) & (F.col("line_no") % 3 == 1)).select("file", "line_no")
    none = lines.limit(0)
    imports = none.select("file", F.col("text").alias("import_path"), "line_no")
    return render.show(lines, turns(spark, sf_dir), imports, tracked, hidden, none, expand="user_1", docs=True).select("file", "text")


@query("SELECT doc_id, CASE WHEN strlen(text) <= 41 THEN text ELSE list_last(list_filter(list_transform(range(0, 42), lambda k: left(text, k)), lambda x: strlen(x) <= 41)) END AS cut FROM documents")
def t3_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text"), 41).alias("cut"))
