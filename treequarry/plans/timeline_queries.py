"""Queries of histories as changes: events are actions, each of which writes or removes one file of its workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treequarry.operators import timeline
from treequarry.plans.registry import query
from treequarry.sources import tables as S


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action writes the text of a document, all of which take turns, or removes its file."""
    order = Window.partitionBy("workspace", "path").orderBy("id")
    texts = S.table(spark, sf_dir, "documents").agg(F.max("doc_id") + 1).first()[0] or 1
    acts = S.actions(spark, sf_dir).select("workspace", "id", F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("path"), F.when(F.col("event_id") % 11 > 0, F.col("event_id") % texts).alias("doc_id"))
    known = acts.join(objects(spark, sf_dir).select("doc_id", "hash"), "doc_id", "left")
    mode = lambda c: F.when(F.col(c).isNotNull(), "644")
    return known.select("workspace", "id", "path", F.lag("hash").over(order).alias("before"), F.col("hash").alias("after")).withColumns({"before_mode": mode("before"), "after_mode": mode("after")})


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.actions(spark, sf_dir).groupBy("workspace").agg(F.floor(F.max("id") / 2).cast("long").alias("cursor"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.actions(spark, sf_dir).select("workspace", "id", (F.col("event_id") % 5 > 0).alias("undoable"))


_acts = "half AS (SELECT workspace, max(id) // 2 AS cursor FROM fx_actions GROUP BY workspace), acts AS (SELECT workspace, id, event_id, 'f' || (event_id % 7) AS path, CASE WHEN event_id % 11 > 0 THEN event_id % (SELECT max(doc_id) + 1 FROM documents) END AS doc FROM fx_actions), steps AS (SELECT *, lag(doc) OVER (PARTITION BY workspace, path ORDER BY id) AS old FROM acts)"


@query(f"WITH {_acts} SELECT workspace, path, sha256(text) AS hash, strlen(text)::BIGINT AS n_bytes FROM (SELECT a.*, row_number() OVER (PARTITION BY workspace, path ORDER BY id DESC) AS n FROM acts a JOIN half USING (workspace) WHERE id <= cursor) JOIN documents ON doc_id = doc WHERE n = 1")
def m14_state_at_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and contents of each workspace half way through its history."""
    found = timeline.as_of(changes(spark, sf_dir), cursors(spark, sf_dir))
    return found.join(objects(spark, sf_dir).dropDuplicates(["hash"]), "hash").select("workspace", "path", "hash", F.octet_length("content").cast("long").alias("n_bytes"))


@query(f"WITH {_acts} SELECT workspace, path, text AS content FROM steps JOIN half USING (workspace) LEFT JOIN documents ON doc_id = old WHERE id = cursor AND cursor > 1 AND event_id % 5 > 0")
def m14_undone_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.stepped(changes(spark, sf_dir), actions(spark, sf_dir), cursors(spark, sf_dir), objects(spark, sf_dir))[0].select("workspace", "path", "content")


@query(f"WITH {_acts} SELECT workspace, cursor + 1 AS id, CASE WHEN a.id IS NULL THEN 'nothing' END AS error, CASE WHEN a.id IS NULL THEN cursor ELSE cursor + 1 END AS cursor FROM half LEFT JOIN (SELECT workspace AS w, id FROM acts) a ON w = workspace AND a.id = cursor + 1")
def m14_redo_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.stepped(changes(spark, sf_dir), actions(spark, sf_dir), cursors(spark, sf_dir), objects(spark, sf_dir), redo=True)[1]


@query(f"WITH {_acts} SELECT workspace, id, path, coalesce(strlen(o.text), 0) || ' bytes' AS before, coalesce(strlen(n.text), 0) || ' bytes' AS after FROM steps LEFT JOIN documents o ON o.doc_id = old LEFT JOIN documents n ON n.doc_id = doc")
def z5_file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.file_changes(changes(spark, sf_dir), objects(spark, sf_dir))


@query(f"WITH {_acts} SELECT workspace, id, unnest(CASE WHEN id = 1 THEN ['+ config created'] ELSE list_filter([CASE WHEN id % 2 = 0 THEN 'mode: \"' || CASE WHEN (id - 1) % 4 < 2 THEN 'whitelist' ELSE 'blacklist' END || '\" -> \"' || CASE WHEN id % 4 < 2 THEN 'whitelist' ELSE 'blacklist' END || '\"' END, CASE WHEN old IS NULL AND doc IS NOT NULL THEN '+ objects[\"' || path || '\"]: ' || sha256(n.text) WHEN old IS NOT NULL AND doc IS NULL THEN '- objects[\"' || path || '\"]' END], lambda x: x IS NOT NULL) END) AS line FROM steps LEFT JOIN documents n ON n.doc_id = doc")
def z5_setting_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each written file is an entry of the settings; the mode turns with every second action."""
    c = changes(spark, sf_dir)
    mode = lambda n: F.when(n % 4 < 2, "whitelist").otherwise("blacklist")
    modes = c.select("workspace", "id", F.lit("mode").alias("key"), mode(F.col("id") - 1).alias("before"), mode(F.col("id")).alias("after"))
    made = c.filter("id = 1").select("workspace", "id", F.lit("config").alias("key"), F.lit(None).cast("string").alias("before"), F.lit("made").alias("after"))
    entries = c.select("workspace", "id", F.concat(F.lit("objects."), "path").alias("key"), "before", "after")
    return timeline.setting_changes(entries.unionByName(modes).unionByName(made))
