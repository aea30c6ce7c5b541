"""Queries over objects, history, checkpoints, manifests, ranges and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treequarry.functions import codes
from treequarry.operators import output, patches, store
from treequarry.plans.registry import query
from treequarry.sources import tables as S


@query("SELECT count(*) AS deleted, coalesce(sum(size), 0)::BIGINT AS freed_bytes FROM (SELECT DISTINCT hash, size FROM fx_objects) WHERE hash NOT IN (SELECT hash FROM fx_referenced)")
def j10_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.garbage_totals(S.objects(spark, sf_dir), S.referenced(spark, sf_dir))


@query("SELECT DISTINCT hash, size FROM fx_objects WHERE hash NOT IN (SELECT hash FROM fx_referenced)")
def m16_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.garbage(S.objects(spark, sf_dir), S.referenced(spark, sf_dir)).select("hash", "size")


@query("SELECT count(DISTINCT hash) AS n_objects, (SELECT sum(size) FROM (SELECT DISTINCT hash, size FROM fx_objects))::BIGINT AS total_bytes FROM fx_objects")
def a5_store_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.totals(S.objects(spark, sf_dir))


@query("SELECT DISTINCT hash, size FROM fx_objects WHERE hash NOT IN (SELECT hash FROM fx_objects WHERE doc_id % 3 = 0)")
def k1_new_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all texts those that a store with every third does not have."""
    stored = S.objects(spark, sf_dir).filter("doc_id % 3 = 0")
    return store.new_objects(S.table(spark, sf_dir, "documents").select(F.col("text").alias("content")), stored).select("hash", "size")


@query("SELECT hash FROM (SELECT DISTINCT hash FROM fx_objects) JOIN fx_referenced USING (hash)")
def s10_objects_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.objects(spark, sf_dir).select("hash").distinct().join(S.referenced(spark, sf_dir), "hash", "left_semi")


_cursor = "cursors AS (SELECT workspace, max(id) * 2 // 3 AS cursor FROM fx_actions GROUP BY workspace)"


def _cursors(actions: DataFrame) -> DataFrame:
    return actions.groupBy("workspace").agg(F.floor(F.max("id") * 2 / 3).cast("long").alias("cursor"))


@query(f"WITH {_cursor} SELECT workspace, id, command, CASE WHEN id <= cursor THEN 'past' ELSE 'future' END AS side FROM fx_actions JOIN cursors USING (workspace)")
def w5_history_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = S.actions(spark, sf_dir)
    return store.split_history(a, _cursors(a)).select("workspace", "id", "command", "side")


@query("SELECT workspace, id, row_number() OVER (PARTITION BY workspace ORDER BY id)::BIGINT AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY id DESC) AS n FROM fx_actions) WHERE n <= 50")
def k7_history_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.capped_history(S.actions(spark, sf_dir), 50).select("workspace", "id", "new_id")


@query("SELECT workspace, id, command, place FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY id DESC)::BIGINT AS place FROM fx_actions) WHERE place <= 20")
def o2_history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recent(S.actions(spark, sf_dir)).select("workspace", "id", "command", "place")


@query(
    f"WITH {_cursor}, new AS (SELECT workspace, max(ts) AS ts, 'new' AS command FROM fx_actions WHERE workspace % 2 = 0 GROUP BY workspace) SELECT workspace, id, command FROM fx_actions JOIN cursors USING (workspace) WHERE id <= cursor OR workspace % 2 = 1 UNION ALL SELECT workspace, cursor + 1, command FROM new JOIN cursors USING (workspace)"
)
def m15_push_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new action in every second workspace ends what could be redone there."""
    a = S.actions(spark, sf_dir)
    new = a.filter("workspace % 2 = 0").groupBy("workspace").agg(F.max("ts").alias("ts")).withColumn("command", F.lit("new"))
    return store.pushed(a, _cursors(a), new).select("workspace", "id", "command")


@query("SELECT event_type, arg_max('c' || event_id, (ts, 'c' || event_id)) AS name, max(ts) AS created FROM events GROUP BY event_type")
def w3_latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = S.table(spark, sf_dir, "events").select("event_type", F.concat(F.lit("c"), "event_id").alias("name"), F.col("ts").alias("created"))
    return store.latest_checkpoints(points, "event_type")


@query(
    "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT * FROM fx_objects WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE hash END AS hash FROM fx_objects WHERE doc_id % 5 <> 0) b ON a.doc_id = b.doc_id WHERE a.hash IS DISTINCT FROM b.hash"
)
def j14_map_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.objects(spark, sf_dir)
    after = o.filter("doc_id % 5 <> 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("hash")))
    return store.map_diff(o.filter("doc_id % 3 <> 0"), after, "doc_id", "hash")


@query("SELECT count(*) AS total, count_if(h)::BIGINT AS hidden, count_if(NOT h)::BIGINT AS shown FROM (SELECT path, path IN (SELECT path FROM fx_ranges) AS h FROM (SELECT path FROM fx_files UNION SELECT path FROM fx_ranges))")
def a4_manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.manifest(S.files(spark, sf_dir), S.ranges(spark, sf_dir))


_tracked = "tracked AS (SELECT 'k' || doc_id AS key, 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.rs' ELSE '.bin' END AS file, CASE WHEN doc_id % 50 = 0 THEN 'zz' ELSE hash END AS hash, doc_id % 3 > 0 AS is_full, doc_id FROM fx_objects)"


@query(
    f"WITH {_tracked} SELECT 'invalid_hash' AS issue, key FROM tracked WHERE hash = 'zz' UNION ALL SELECT 'missing_object', key FROM tracked WHERE hash <> 'zz' AND hash NOT IN (SELECT hash FROM fx_referenced) "
    "UNION ALL SELECT 'legacy_marker', key FROM tracked WHERE hash <> 'zz' AND is_full AND doc_id % 20 = 1 UNION ALL SELECT 'missing_metadata', key FROM tracked WHERE hash <> 'zz' AND is_full AND doc_id % 2 = 0 AND hash NOT IN (SELECT hash FROM fx_objects WHERE doc_id % 4 = 0)"
)
def m17_doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.objects(spark, sf_dir)
    file = F.concat(F.lit("d"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".rs").otherwise(".bin"))
    tracked = o.select(F.concat(F.lit("k"), "doc_id").alias("key"), file.alias("file"), F.when(F.col("doc_id") % 50 == 0, "zz").otherwise(F.col("hash")).alias("hash"), (F.col("doc_id") % 3 > 0).alias("is_full"))
    legacy = o.filter("doc_id % 20 = 1").select(file.alias("path"))
    return store.doctor(tracked, S.referenced(spark, sf_dir), o.filter("doc_id % 4 = 0"), legacy)


@query("SELECT 'd' || doc_id AS path FROM fx_objects WHERE doc_id % 4 = 0 OR doc_id % 5 = 1 OR doc_id % 7 = 2")
def f21_stale_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are gone, have another time, or another size than the cache knows."""
    o = S.objects(spark, sf_dir).select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"), F.lit(1).cast("long").alias("mtime"), "size", "hash")
    now = o.filter("doc_id % 4 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 5 == 1, 2).otherwise(F.col("mtime"))).withColumn("size", F.when(F.col("doc_id") % 7 == 2, -1).otherwise(F.col("size")))
    return store.stale(o, now)


@query("SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 5 = 0 THEN 'was ' || text ELSE 'disk ' || doc_id END AS content FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 1")
def s4_see_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden files from the store, partly hidden ones from their original, the others from the disk."""
    d = S.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"), "text")
    disk = d.filter("doc_id % 2 = 1").select("path", F.concat(F.lit("disk "), "doc_id").alias("content"))
    return store.see_through(disk, d.filter("doc_id % 3 = 0").select("path", F.col("text").alias("content")), d.filter("doc_id % 5 = 0").select("path", F.concat(F.lit("was "), "text").alias("content")))


@query("SELECT file, hunk_no, coalesce(sum(new_count - old_count) OVER (PARTITION BY file ORDER BY hunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM fx_hunks")
def w8_hunk_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.hunk_offsets(S.hunks(spark, sf_dir))


_heads = "heads AS (SELECT file, hunk_no, '@@ -' || hunk_no || CASE WHEN hunk_no % 3 = 0 THEN '' ELSE ',' || old_count END || ' +' || (hunk_no + 1) || ',' || new_count || ' @@ f' AS head FROM fx_hunks)"


@query(
    f"WITH {_heads} SELECT file, hunk_no, regexp_extract(head, '-([0-9]+)', 1)::BIGINT AS old_start, CASE WHEN hunk_no % 3 = 0 THEN 1 ELSE regexp_extract(head, ',([0-9]+) \\+', 1)::BIGINT END AS old_count, hunk_no + 1 AS new_start, CASE WHEN regexp_matches(head, '\\+[0-9]+,[0-9]+ @@') THEN regexp_extract(head, '\\+[0-9]+,([0-9]+) @@', 1)::BIGINT END AS new_count FROM heads WHERE regexp_matches(head, '\\+[0-9]+,[0-9]+ @@')"
)
def p24_hunk_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads with negative counts are no heads."""
    head = F.concat(F.lit("@@ -"), "hunk_no", F.when(F.col("hunk_no") % 3 == 0, "").otherwise(F.concat(F.lit(","), "old_count")), F.lit(" +"), (F.col("hunk_no") + 1).cast("string"), F.lit(","), "new_count", F.lit(" @@ f"))
    return patches.hunk_heads(S.hunks(spark, sf_dir).select("file", "hunk_no", head.alias("head")), ["file", "hunk_no"])


@query(
    "SELECT p_partkey, CASE WHEN b < a OR a < 1 THEN NULL ELSE a END AS s, CASE WHEN b < a OR a < 1 THEN NULL ELSE b END AS e FROM (SELECT p_partkey, p_partkey % 13 AS a, p_size::BIGINT AS b FROM part)"
)
def p25_range_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part").select("p_partkey", F.concat((F.col("p_partkey") % 13).cast("string"), F.lit("-"), F.col("p_size").cast("string")).alias("range"))
    return part.select("p_partkey", codes.line_range(F.col("range")).alias("r")).select("p_partkey", "r.s", "r.e")


@query(
    "SELECT p_partkey, entry, CASE WHEN starts_with(entry, './') THEN 'E001' WHEN starts_with(entry, '.') THEN 'E002' WHEN entry = '//' THEN 'E021' WHEN entry = 'd/#1-2' THEN 'E008' END AS error, CASE WHEN starts_with(entry, '.') OR entry IN ('//', 'd/#1-2') THEN NULL WHEN starts_with(entry, '/') THEN 'regex' ELSE 'literal' END AS kind, "
    "CASE WHEN starts_with(entry, '.') OR entry IN ('//', 'd/#1-2') THEN NULL WHEN starts_with(entry, '/') THEN split_part(substr(entry, 2), '/', 1) WHEN regexp_matches(entry, '#[0-9]+-[0-9]+$') THEN regexp_replace(entry, '#[^#]*$', '') ELSE entry END AS pattern, "
    "CASE WHEN starts_with(entry, '.') OR entry IN ('//', 'd/#1-2') THEN NULL WHEN regexp_matches(entry, '#[0-9]+-[0-9]+(,[0-9]+-[0-9]+)*$') THEN regexp_extract(entry, '#([^#]*)$', 1) END AS ranges FROM (SELECT p_partkey, (['a.rs', './b', '.c', '/x[0-9]y/', '//', '/q/#1-3', 'f.py#2-4', 'f#g#3-3', 'n#x', 'd/', 'd/#1-2'])[p_partkey % 11 + 1] AS entry FROM part)"
)
def p25_policy_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ["a.rs", "./b", ".c", "/x[0-9]y/", "//", "/q/#1-3", "f.py#2-4", "f#g#3-3", "n#x", "d/", "d/#1-2"]
    part = S.table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, entries)), F.pmod("p_partkey", F.lit(11)).cast("int") + 1).alias("entry"))
    return codes.policy_entries(part).select("p_partkey", "entry", "error", "kind", "pattern", "ranges")


@query("SELECT doc_id, message, CASE WHEN doc_id % 36 = 0 THEN 'E000' ELSE 'E' || lpad((doc_id % 36)::VARCHAR, 3, '0') END AS code FROM (SELECT doc_id, ([" + ", ".join(f"'{m}'" for m in ["unknown", *codes.ERRORS]) + "])[doc_id % 36 + 1] AS message FROM documents)")
def t12_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["unknown", *codes.ERRORS]))
    return S.table(spark, sf_dir, "documents").select("doc_id", F.element_at(names, F.pmod("doc_id", F.lit(36)).cast("int") + 1).alias("message")).withColumn("code", codes.error_code(F.col("message")))


@query("SELECT command, count(*) AS n, count_if(value >= 0)::BIGINT AS applied, count_if(value < 0)::BIGINT AS skipped FROM (SELECT event_type AS command, value FROM events) GROUP BY command")
def a14_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events").withColumnRenamed("event_type", "command")
    return e.groupBy("command").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 0).alias("applied"), F.count_if(F.col("value") < 0).alias("skipped"))


@query("SELECT workspace, b.id, a.command AS before, b.command AS after FROM fx_actions a JOIN fx_actions b USING (workspace) WHERE b.id = a.id + 1")
def j13_snapshot_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States before and after each action, paired by position."""
    order = Window.partitionBy("workspace").orderBy("id")
    return S.actions(spark, sf_dir).select("workspace", "id", F.lag("command").over(order).alias("before"), F.col("command").alias("after")).filter("before is not null")


@query("SELECT json_extract_string(to_json({'command': command, 'workspace': workspace, 'id': id}), '$') AS json FROM fx_actions")
def k13_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.results(S.actions(spark, sf_dir).select("command", "workspace", "id"))


@query("SELECT doc_id, json_extract_string(to_json({'error': true, 'code': CASE WHEN doc_id % 36 = 0 THEN 'E000' ELSE 'E' || lpad((doc_id % 36)::VARCHAR, 3, '0') END, 'message': source || ': ' || kind}), '$') AS json FROM (SELECT doc_id, source, ([" + ", ".join(f"'{m}'" for m in ["unknown", *codes.ERRORS]) + "])[doc_id % 36 + 1] AS kind FROM documents)")
def k13_error_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["unknown", *codes.ERRORS]))
    failed = S.table(spark, sf_dir, "documents").select("doc_id", "source", F.element_at(names, F.pmod("doc_id", F.lit(36)).cast("int") + 1).alias("kind"))
    return output.errors(failed.withColumn("message", F.concat("source", F.lit(": "), "kind")), ["doc_id"])
