"""Queries over project state, sets, aggregates and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treequarry.functions import paths as P
from treequarry.operators import files as O
from treequarry.operators import policy, project, symbols
from treequarry.plans.file_queries import EXT, quoted
from treequarry.plans.registry import query
from treequarry.sources import tables as S


def disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the documents are on disk."""
    return S.table(spark, sf_dir, "documents").filter("doc_id % 3 < 2").select(F.concat(F.lit("d"), "doc_id", F.lit(".rs")).alias("path"), F.col("text").alias("content"))


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of them is tracked, some with another hash than the text's."""
    h = F.when(F.col("doc_id") % 8 == 0, "x").otherwise(F.sha2("text", 256))
    path = F.concat(F.lit("d"), "doc_id", F.lit(".rs"))
    return S.table(spark, sf_dir, "documents").filter("doc_id % 4 = 0").select(path.alias("key"), path.alias("path"), h.alias("hash"))


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.concat(F.lit("d"), "doc_id", F.lit(".rs")).alias("path"))


_error = "CASE WHEN doc_id % 3 = 2 AND doc_id % 4 = 0 THEN 'E012' WHEN doc_id % 3 = 2 THEN 'E023' WHEN doc_id % 4 = 0 THEN 'E012' END"


@query(f"SELECT 'd' || doc_id || '.rs' AS path, {_error} AS error FROM documents WHERE doc_id % 2 = 0")
def m1_hide_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.checked(wanted(spark, sf_dir), disk(spark, sf_dir), tracked(spark, sf_dir)).select("path", "error")


@query(f"SELECT 'd' || doc_id || '.rs' AS path, doc_id % 4 = 0 OR doc_id % 2 = 0 AND ({_error}) IS NULL AS is_tracked FROM documents WHERE doc_id % 4 = 0 OR doc_id % 2 = 0 AND ({_error}) IS NULL")
def m3_tracked_after_hiding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.hide(wanted(spark, sf_dir), disk(spark, sf_dir), tracked(spark, sf_dir))[1].select("path", F.lit(True).alias("is_tracked"))


@query(f"SELECT 'd' || doc_id || '.rs' AS path FROM documents WHERE doc_id % 3 < 2 AND NOT (doc_id % 2 = 0 AND ({_error}) IS NULL)")
def m3_files_after_hiding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.hide(wanted(spark, sf_dir), disk(spark, sf_dir), tracked(spark, sf_dir))[0].select("path")


@query("SELECT 'd' || doc_id || '.rs' AS path FROM documents WHERE doc_id % 8 = 0")
def m6_tracked_after_showing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has lost its object cannot be restored and stays tracked."""
    objects = S.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), F.col("text").alias("content"))
    return project.show(wanted(spark, sf_dir), disk(spark, sf_dir), tracked(spark, sf_dir), objects)[1].select("path")


@query("SELECT 'd' || doc_id || '.rs' AS path, CASE WHEN doc_id % 8 = 0 THEN 'skipped' ELSE 'applied' END AS outcome FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 < 2")
def m12_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.apply_again(disk(spark, sf_dir), tracked(spark, sf_dir))


@query("SELECT 'd' || doc_id || '.rs' AS path, hash IN (SELECT hash FROM fx_referenced) AS restored FROM fx_objects WHERE doc_id % 3 < 2")
def m13_checkpoint_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = project.save_checkpoint(disk(spark, sf_dir), "before", "2024-01-01 00:00:00")
    texts = S.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), F.col("text").alias("content"))
    return project.restore_checkpoint(points, "before", texts.join(S.referenced(spark, sf_dir), "hash", "left_semi")).select("path", "restored")


def history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = S.actions(spark, sf_dir).select("workspace", "id", (F.col("event_id") % 5 > 0).alias("undoable"), F.concat(F.lit("pre"), "event_id").alias("pre_state"), F.concat(F.lit("post"), "event_id").alias("post_state"))
    return a, a.groupBy("workspace").agg(F.floor(F.max("id") / 2).cast("long").alias("cursor"))


_half = "half AS (SELECT workspace, max(id) // 2 AS cursor FROM fx_actions GROUP BY workspace)"


@query(f"WITH {_half} SELECT workspace, id, 'pre' || event_id AS state FROM fx_actions JOIN half USING (workspace) WHERE id = cursor AND cursor > 1 AND event_id % 5 > 0")
def m14_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.step(*history(spark, sf_dir))


@query(f"WITH {_half} SELECT workspace, id, 'post' || event_id AS state FROM fx_actions JOIN half USING (workspace) WHERE id = cursor + 1")
def m14_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.step(*history(spark, sf_dir), redo=True)


@query("SELECT file, first, last FROM (SELECT file, coalesce(max(line_end) OVER (PARTITION BY file ORDER BY line_start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first, line_start - 1 AS last FROM (SELECT file, line_start, line_end, 0 AS e FROM fx_symbols WHERE kind = 'Function' UNION ALL SELECT file, max(line_end) + 1, max(line_end) + 1, 1 FROM fx_symbols GROUP BY file)) WHERE last >= first")
def w7_text_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.symbols(spark, sf_dir)
    return project.between(s.filter("kind = 'Function'"), s.groupBy("file").agg(F.max("line_end").alias("n")))


@query("SELECT name, file, line_start FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, line_start) AS n FROM fx_symbols) WHERE n = 1")
def w2_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = S.symbols(spark, sf_dir).groupBy("name").agg(F.min(F.struct("file", "line_start")).alias("b"))
    return best.select("name", "b.file", "b.line_start")


@query("SELECT file, string_agg(name, ',' ORDER BY line_start) AS names FROM fx_symbols GROUP BY file")
def o1_sorted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.listed(S.symbols(spark, sf_dir))


@query("SELECT path, 'store' AS source FROM (SELECT DISTINCT path FROM fx_ranges) UNION ALL SELECT path, 'disk' FROM fx_files WHERE path NOT IN (SELECT path FROM fx_ranges)")
def s5_all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored files first, then those on disk that the store does not have."""
    stored = S.ranges(spark, sf_dir).select("path").distinct()
    rest = S.files(spark, sf_dir).select("path").join(stored, "path", "left_anti")
    return stored.withColumn("source", F.lit("store")).unionByName(rest.withColumn("source", F.lit("disk")))


@query("SELECT path FROM fx_files EXCEPT SELECT path FROM fx_ranges")
def u2_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.files(spark, sf_dir).select("path").distinct().join(S.ranges(spark, sf_dir).select("path"), "path", "left_anti")


@query("SELECT file, name FROM fx_symbols WHERE file IN (SELECT 'conv/c' || conv_id || '.py' FROM conversations WHERE role = 'system')")
def j9_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = S.table(spark, sf_dir, "conversations").filter("role = 'system'").select(F.concat(F.lit("conv/c"), "conv_id", F.lit(".py")).alias("file"))
    return S.symbols(spark, sf_dir).join(has, "file", "left_semi").select("file", "name")


@query("SELECT s.file, s.name, c.callee FROM fx_symbols s LEFT JOIN fx_calls c ON s.file = c.file AND s.name = c.caller")
def j7_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = S.calls(spark, sf_dir).withColumnRenamed("caller", "name").select("file", "name", "callee")
    return S.symbols(spark, sf_dir).select("file", "name").join(calls, ["file", "name"], "left")


@query("SELECT path, list_has_any(string_split(content, chr(10)), ['']) AS any_empty, len(list_filter(string_split(content, chr(10)), lambda x: x = '')) = 0 AS none_empty FROM fx_files")
def a15_quantifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.empty_lines(S.files(spark, sf_dir))


@query("SELECT path, sum(e - s + 1)::BIGINT AS n_lines, count(*) AS n_ranges FROM fx_ranges GROUP BY path")
def a9_hidden_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ranges(spark, sf_dir).groupBy("path").agg(F.sum(F.col("e") - F.col("s") + 1).alias("n_lines"), F.count("*").alias("n_ranges"))


@query("SELECT DISTINCT hash FROM fx_objects")
def a13_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.objects(spark, sf_dir).select("hash").dropDuplicates(["hash"])


@query(f"SELECT ext, count(*) AS n, sum(strlen(content))::BIGINT AS bytes FROM (SELECT {EXT} AS ext, content FROM fx_files) WHERE ext IN ({quoted(P.SUPPORTED)}) GROUP BY ext")
def a7_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.files(spark, sf_dir).select(P.extension(F.col("path")).alias("ext"), "content").filter(F.col("ext").isin(P.SUPPORTED))
    return rows.groupBy("ext").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown, floor(epoch(ts))::BIGINT AS seconds FROM events")
def t6_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("shown"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def t10_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT s.file, s.name, count(c.callee) AS n_calls FROM fx_symbols s LEFT JOIN fx_calls c ON c.file = s.file AND c.callee = s.name WHERE s.kind = 'Function' GROUP BY ALL")
def m27_outline_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.call_counts(S.symbols(spark, sf_dir), S.calls(spark, sf_dir))


@query("SELECT path, string_agg(text, chr(10) ORDER BY line_no) AS content FROM fx_lines GROUP BY path")
def m4_joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.contents(S.lines(spark, sf_dir))


@query("SELECT name, count(*) OVER (PARTITION BY name) AS n_entries, file, line_start FROM (SELECT name, file, line_start FROM fx_symbols UNION ALL SELECT name, file, line_start FROM fx_classes)")
def m19_rebuilt_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and classes by name."""
    every = S.symbols(spark, sf_dir).select("name", "file", "line_start").unionByName(S.classes(spark, sf_dir).select("name", "file", "line_start"))
    return symbols.inverted_index(every)
