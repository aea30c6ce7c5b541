"""Queries over patches: every document is a file, and has a patch of one or two hunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treequarry.operators import patches
from treequarry.plans.registry import query
from treequarry.sources import tables as S


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, doc_id, p (its lines), n."""
    d = S.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    body = F.when(F.endswith("content", F.lit("\n")), F.expr("left(content, char_length(content) - 1)")).otherwise(F.col("content"))
    return d.withColumn("p", F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))).withColumn("n", F.size("p"))


def _text(wrong: Column) -> Column:
    """The first line is replaced, the second is context, and after the fifth comes a new one; where `wrong`, the context is."""
    line = lambda i: F.try_element_at("p", F.lit(i))
    context = F.when(F.col("n") >= 2, F.concat(F.lit("\n "), F.when(wrong, F.concat(F.lit("not "), line(2))).otherwise(line(2)))).otherwise("")
    size = F.when(F.col("n") >= 2, "2").otherwise("1")
    first = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\t2024\n@@ -1,"), size, F.lit(" +1,"), size, F.lit(" @@\n-"), line(1), F.lit("\n+new "), "path", context)
    second = F.when(F.col("n") >= 5, F.concat(F.lit("\n@@ -5 +5,2 @@ tail\n "), line(5), F.lit("\n+added"))).otherwise("")
    return F.concat(first, second)


def patch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch_id, text, for files with lines; the patch does not fit where two or more lines are a multiple of three."""
    rows = files(spark, sf_dir).filter("n > 0")
    return rows.select(F.col("doc_id").alias("patch_id"), _text(F.col("n") % 3 == 0).alias("text"))


_files = """body AS (SELECT doc_id, 'd' || doc_id || '.txt' AS path, text AS content, CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END AS b FROM documents),
 f AS (SELECT *, len(p) AS n FROM (SELECT *, CASE WHEN b = '' THEN [] ELSE string_split(b, chr(10)) END AS p FROM body))"""


@query(
    f"WITH {_files}, own AS (SELECT * FROM f WHERE n > 0) SELECT doc_id AS patch_id, path AS file, hunk_no::BIGINT AS hunk_no, line_no::BIGINT AS line_no, old_start::BIGINT AS old_start, op, text FROM ("
    "SELECT *, 1 AS hunk_no, 1 AS line_no, 1 AS old_start, '-' AS op, p[1] AS text FROM own UNION ALL SELECT *, 1, 2, 1, '+', 'new ' || path FROM own "
    "UNION ALL SELECT *, 1, 3, 1, ' ', CASE WHEN n % 3 = 0 THEN 'not ' ELSE '' END || p[2] FROM own WHERE n >= 2 UNION ALL SELECT *, 2, 1, 5, ' ', p[5] FROM own WHERE n >= 5 UNION ALL SELECT *, 2, 2, 5, '+', 'added' FROM own WHERE n >= 5)"
)
def p23_patch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.parse(patch_texts(spark, sf_dir)).filter("file = new_file").drop("new_file")


_changed = "CASE WHEN n % 3 = 0 THEN content ELSE array_to_string(list_concat(['new ' || path], p[2:5], CASE WHEN n >= 5 THEN ['added'] ELSE [] END, p[6:]), chr(10)) || CASE WHEN ends_with(content, chr(10)) THEN chr(10) ELSE '' END END"


@query(f"WITH {_files} SELECT path, CASE WHEN n % 3 = 0 THEN 'mismatch' ELSE 'applied' END AS status, {_changed} AS content FROM f WHERE n > 0")
def m20_patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.apply(files(spark, sf_dir).select("path", "content"), patches.parse(patch_texts(spark, sf_dir)))


@query(f"WITH {_files} SELECT path, content FROM f")
def m21_patch_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files after the patches that fit are applied and taken back."""
    return patches.taken_back(files(spark, sf_dir).select("path", "content"), patches.parse(patch_texts(spark, sf_dir)))


@query(f"WITH {_files} SELECT count(*) AS n_files, count_if(n % 3 > 0)::BIGINT AS n_applied, count_if(n % 3 = 0)::BIGINT AS n_conflicts FROM f WHERE n > 0")
def m21_patch_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.tallies(patches.apply(files(spark, sf_dir).select("path", "content"), patches.parse(patch_texts(spark, sf_dir))))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'git' WHEN 1 THEN 'unified' END AS format, CASE doc_id % 3 WHEN 0 THEN 'x/' || doc_id WHEN 1 THEN doc_id::VARCHAR ELSE 'd' || doc_id || '.txt' END AS path FROM documents")
def p24_patch_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("p"))
    kind = F.col("doc_id") % 3
    text = F.when(kind == 0, "diff --git a/x b/x\nindex 1..2").when(kind == 1, "--- a\n+++ b\n").otherwise("--- a\nno patch")
    path = F.when(kind == 0, F.concat(F.lit('"a/x/'), "doc_id", F.lit('"\t2024'))).when(kind == 1, F.concat(F.lit("b/"), "doc_id")).otherwise(F.col("p"))
    return d.select("doc_id", patches.patch_format(text).alias("format"), patches.clean_path(path).alias("path"))
