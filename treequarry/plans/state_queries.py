"""Queries over persisted state: each writes versions of a table to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treequarry.operators import analysis, state, store, symbols
from treequarry.plans.registry import query
from treequarry.plans.rich_parse_queries import GO, ZIG, go_files, zig_files
from treequarry.session import shared_folder
from treequarry.sources import tables as S


def table(spark: SparkSession, name: str, schema: str) -> state.Table:
    return state.Table(shared_folder(spark, name), schema)


@query("SELECT workspace, row_number() OVER (PARTITION BY workspace ORDER BY id)::BIGINT AS id, command FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY id DESC) AS n FROM fx_actions) WHERE n <= 500")
def s12_history_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, "history", state.HISTORY)
    state.save(store.capped_history(S.actions(spark, sf_dir)).select("workspace", F.col("new_id").alias("id"), "command"), own)
    return state.load(spark, own)


def checkpoints(spark: SparkSession, sf_dir: str) -> state.Table:
    """A checkpoint of each source; then those of sources with English documents are saved again, with these alone."""
    own = table(spark, "checkpoints", state.CHECKPOINTS)
    d = S.table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created"), F.concat(F.lit("d"), "doc_id").alias("path"), F.sha2("text", 256).alias("hash"), "lang")
    state.save(d, own)
    state.put(d.filter("lang = 'en'").withColumn("created", F.lit("2024-01-02 00:00:00").cast("timestamp")), own, "name")
    return own


_saved = "again AS (SELECT DISTINCT source FROM documents WHERE lang = 'en'), saved AS (SELECT source AS name, source IN (SELECT source FROM again) AS new, 'd' || doc_id AS path, sha256(text) AS hash FROM documents WHERE lang = 'en' OR source NOT IN (SELECT source FROM again))"


@query(f"WITH {_saved} SELECT name, path, hash FROM saved")
def k8_checkpoint_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.load(spark, checkpoints(spark, sf_dir)).select("name", "path", "hash")


@query(f"WITH {_saved} SELECT name, count(*) AS n FROM saved GROUP BY name")
def s13_checkpoint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.names(state.load(spark, checkpoints(spark, sf_dir)))


@query(f"WITH {_saved} SELECT name, path FROM saved WHERE NOT new")
def k9_checkpoint_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = checkpoints(spark, sf_dir)
    state.drop(spark, own, F.col("created") > "2024-01-01 12:00:00")
    return state.load(spark, own).select("name", "path")


@query("SELECT source AS name, 'd' || doc_id AS path FROM documents")
def s13_older_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version is still there."""
    return state.load(spark, checkpoints(spark, sf_dir), 1).select("name", "path")


def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all good documents, by content; those of one language have a format that is not known."""
    good = S.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    d = S.table(spark, sf_dir, "documents").join(good, "doc_id")
    return d.select(F.concat(F.lit("d"), "doc_id").alias("path"), F.lit(1).cast("long").alias("mtime"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"), F.when(F.col("lang") == "de", 2).otherwise(1).cast("long").alias("format"), F.size(F.split("text", "\n")).cast("string").alias("parsed"))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, "cache", state.CACHE)
    state.save(cache_rows(spark, sf_dir), own)
    return state.load(spark, own)


_cache = "cache AS (SELECT 'd' || doc_id AS path, doc_id, strlen(text)::BIGINT AS size, sha256(text) AS hash, len(string_split(text, chr(10)))::VARCHAR AS parsed FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND lang IS DISTINCT FROM 'de')"


@query(f"WITH {_cache} SELECT path, size, hash, parsed FROM cache")
def s14_cache_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.readable(cache(spark, sf_dir)).select("path", "size", "hash", "parsed")


@query(f"WITH {_cache} SELECT 'd' || doc_id AS path, sha256(text) AS hash, len(string_split(text, chr(10)))::VARCHAR AS parsed, sha256(text) IN (SELECT hash FROM cache) AS cached FROM documents")
def s6_cache_or_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parse = lambda files: files.select("path", F.size(F.split("content", "\n")).cast("string").alias("parsed"))
    files = S.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("content"))
    return state.cached_or_parsed(files, cache(spark, sf_dir), parse)


@query(f"WITH {_cache} SELECT path FROM cache WHERE doc_id % 4 <> 0")
def m22_cache_invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth file has changed since."""
    own = table(spark, "cache", state.CACHE)
    rows = cache_rows(spark, sf_dir)
    state.save(rows, own)
    listing = rows.withColumn("mtime", F.when(F.expr("cast(substring(path, 2) as long) % 4 = 0"), 2).otherwise(F.col("mtime")))
    state.save(state.valid(state.load(spark, own), listing), own)
    return state.load(spark, own).select("path")


@query(f"WITH {_cache}, n AS (SELECT count(*) AS entries, coalesce(sum(size), 0)::BIGINT AS total_bytes FROM cache) SELECT *, 'Cache Statistics:' || chr(10) || '  Version: 1' || chr(10) || '  Entries: ' || entries || chr(10) || '  Total source size: ' || total_bytes || ' bytes' AS shown FROM n")
def x6_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.stats(state.readable(cache(spark, sf_dir)))


@query("SELECT c_mktsegment AS name, 'white' AS list, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey)::BIGINT AS ord, c_name AS entry FROM customer WHERE c_mktsegment <> (SELECT min(c_mktsegment) FROM customer)")
def m24_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments are profiles; the first by name is deleted."""
    own = table(spark, "profiles", state.PROFILES)
    c = S.table(spark, sf_dir, "customer")
    state.save(c.selectExpr("c_mktsegment as name", "'white' as list", "row_number() over (partition by c_mktsegment order by c_custkey) as ord", "c_name as entry"), own)
    state.drop(spark, own, F.col("name") == c.agg(F.min("c_mktsegment")).first()[0])
    return state.load(spark, own)


@query("SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1")
def s16_profile_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, "profiles", state.PROFILES)
    state.save(S.table(spark, sf_dir, "customer").selectExpr("c_mktsegment as name", "'white' as list", "1 as ord", "c_name as entry"), own)
    return state.names(state.load(spark, own))


@query("SELECT doc_id AS patch_id, row_number() OVER (ORDER BY doc_id)::BIGINT AS place, text FROM documents WHERE lang IS DISTINCT FROM 'fr'")
def s15_patch_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored patches in the order of the queue; those of one language are taken out of both."""
    texts, order = table(spark, "patches", state.PATCHES), table(spark, "queue", state.QUEUE)
    d = S.table(spark, sf_dir, "documents")
    state.save(d.select(F.col("doc_id").alias("patch_id"), "text"), texts)
    gone = d.filter("lang = 'fr'").select(F.col("doc_id").alias("patch_id"))
    left = state.load(spark, texts).join(gone, "patch_id", "left_anti")
    state.save(left, texts)
    state.save(state.places(left.select("patch_id"), "patch_id"), order)
    return state.load(spark, order).join(state.load(spark, texts), "patch_id")


@query("SELECT DISTINCT hash, json_extract_string(to_json({'hash': hash, 'size': size}), '$') AS json FROM fx_objects WHERE hash IN (SELECT hash FROM fx_referenced)")
def s9_metadata_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of every object is stored by its hash; that of objects without references is deleted."""
    own = table(spark, "metadata", state.METADATA)
    o = S.objects(spark, sf_dir).select("hash", "size").distinct()
    state.put(o.select("hash", F.to_json(F.struct("hash", "size")).alias("json")), own, "hash")
    kept = state.load(spark, own).join(S.referenced(spark, sf_dir), "hash", "left_semi")
    state.save(kept, own)
    return state.load(spark, own)


@query("SELECT name, count(*) OVER (PARTITION BY name) AS n_entries, file, line_start FROM fx_symbols")
def s8_index_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, "index", state.INDEX)
    state.save(symbols.inverted_index(S.symbols(spark, sf_dir)), own)
    return state.load(spark, own)


_keys = "keys AS (SELECT path || '#' || s || '-' || e AS key FROM fx_ranges UNION ALL SELECT path || '#_original' FROM fx_ranges WHERE s = 2 UNION ALL SELECT 'gone/' || doc_id AS key FROM documents WHERE lang = 'en')"


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of files, their originals, and files that are hidden in full and so not on disk."""
    r = S.ranges(spark, sf_dir)
    gone = S.table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.concat(F.lit("gone/"), "doc_id").alias("key"))
    return r.selectExpr("concat(path, '#', s, '-', e) as key").unionByName(r.filter("s = 2").selectExpr("concat(path, '#_original') as key")).unionByName(gone)


@query("SELECT DISTINCT path, 'partial' AS kind, true AS on_disk FROM fx_ranges UNION ALL SELECT 'gone/' || doc_id, 'full', false FROM documents WHERE lang = 'en'")
def k5_manifest_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, "manifest", state.MANIFEST)
    state.save(state.manifest(keys(spark, sf_dir), S.files(spark, sf_dir)), own)
    return state.load(spark, own)


@query("SELECT path, path IN (SELECT path FROM fx_ranges) AS hidden FROM fx_files")
def f19_has_veils(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.with_veils(S.files(spark, sf_dir), keys(spark, sf_dir))


@query("SELECT DISTINCT hash FROM fx_objects WHERE hash IN (SELECT hash FROM fx_referenced)")
def k2_store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store without its garbage, written as the next version."""
    own = table(spark, "objects", "hash string, size long")
    state.save(S.objects(spark, sf_dir).select("hash", "size").dropDuplicates(["hash"]), own)
    now = state.load(spark, own)
    state.save(now.join(store.garbage(now, S.referenced(spark, sf_dir)).select("hash"), "hash", "left_anti"), own)
    return state.load(spark, own).select("hash")


@query("SELECT DISTINCT hash FROM fx_objects WHERE doc_id % 9 <> 0")
def s11_store_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the store that are hashes; every ninth is spoilt."""
    o = S.objects(spark, sf_dir).select(F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash")).alias("hash"))
    return store.listed(o)


@query("SELECT workspace, id, command, CASE WHEN command IN ('veil', 'unveil', 'apply', 'restore', 'checkpoint', 'gc', 'clean') THEN 'operation' ELSE 'meta' END AS category, n_files, command || ': ' || n_files || ' file(s)' AS summary FROM (SELECT workspace, id, (['veil', 'undo', 'gc', 'trace', 'apply'])[id % 5 + 1] AS command, id % 3 AS n_files FROM fx_actions)")
def z5_action_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.element_at(F.array(*map(F.lit, ("veil", "undo", "gc", "trace", "apply"))), (F.col("id") % 5 + 1).cast("int"))
    a = S.actions(spark, sf_dir).select("workspace", "id", named.alias("command"))
    affected = a.filter("id % 3 > 0").select("workspace", "id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("id") % 3)).alias("path"))
    return state.summaries(a, affected)


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'debug' WHEN event_id % 3 = 0 THEN 'error' ELSE 'warn' END AS level FROM events")
def z7_log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return S.table(spark, sf_dir, "events").select("event_id", state.log_level(F.when(e % 4 == 0, "DEBUG").otherwise("loud"), F.when(e % 3 == 0, "Error")).alias("level"))


_number = "regexp_extract(file, '([0-9]+)', 1)::BIGINT"


@query(f"WITH now AS (SELECT name, file, line_start + CASE WHEN {_number} % 5 = 0 THEN 1 ELSE 0 END AS line_start FROM fx_symbols WHERE {_number} % 7 <> 0 AND ({_number} % 3 <> 0 OR ordinal % 2 = 0)) SELECT name, count(*) OVER (PARTITION BY name) AS n_entries, file, line_start FROM now")
def z8_updated_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after changes, against one made anew: symbols moved, then symbols and whole files gone, with a new base between."""
    own = table(spark, "index_changes", state.INDEX_CHANGES)
    s = S.symbols(spark, sf_dir).withColumn("k", F.regexp_extract("file", "([0-9]+)", 1).cast("long"))
    state.update_index(s, s, own)
    moved = s.withColumn("line_start", F.col("line_start") + F.when(F.col("k") % 5 == 0, 1).otherwise(0))
    state.update_index(s.filter("k % 5 = 0"), moved.filter("k % 5 = 0"), own)
    state.compact_index(spark, own)
    state.update_index(s.filter("k % 3 = 0"), moved.filter("k % 3 = 0 and ordinal % 2 = 0"), own)
    state.update_index(s.filter("k % 7 = 0"), s.filter("false"), own)
    return state.index_entries(spark, own)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return go_files(spark, sf_dir).unionByName(zig_files(spark, sf_dir))


_symbols = (
    f"symbols AS (SELECT path, name, kind, visibility, a AS line_start, b AS line_end FROM (WITH {GO} SELECT path, 'F' || i AS name, 'Function' AS kind, 'Public' AS visibility, line AS a, line + 2 AS b FROM f UNION ALL SELECT path, 'main', 'Function', 'Private', line, line FROM p "
    "UNION ALL SELECT path, 'T' || k, 'Struct', 'Public', line + 1, line + 6 FROM p UNION ALL SELECT path, 'i', 'Interface', 'Private', line + 1, line + 6 FROM p) "
    f"UNION ALL SELECT path, name, kind, visibility, a, b FROM (WITH {ZIG} SELECT path, 'f' || i AS name, 'Function' AS kind, 'Public' AS visibility, line AS a, line + 2 AS b FROM f UNION ALL SELECT path, 'puts', 'Function', 'Private', line + 2, line + 2 FROM p UNION ALL SELECT path, 'main', 'Function', 'Private', line + 3, line + 3 FROM p "
    "UNION ALL SELECT path, 'test \"of { ' || p_name || '\"', 'Function', 'Private', line + 4, line + 6 FROM p JOIN part ON p_partkey = k UNION ALL SELECT path, 'Point', 'Struct', 'Public', 3, line FROM p UNION ALL SELECT path, 'Kind' || k, 'Enum', 'Private', line + 1, line + 1 FROM p))"
)


@query(f"WITH {_symbols} SELECT path, len(list(name)) AS n_symbols, string_agg(name, ',' ORDER BY line_start, line_end, name) AS names, path LIKE '%.go' AS cached FROM symbols GROUP BY path")
def s6_parser_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Go files come from the cache, the others are parsed now; both give the same kind of record."""
    own = table(spark, "parser_cache", state.CACHE)
    files = sources(spark, sf_dir)
    known = files.filter("path like '%.go'")
    # contents stay where they are read
    listing = known.select("path", F.lit(1).alias("mtime"), F.octet_length("content").alias("size"), F.sha2("content", 256).alias("hash"), F.lit(state.FORMAT).alias("format"))
    entries = listing.join(analysis.parsed(known).hint("merge"), "path")
    state.save(entries, own)
    found = state.cached_or_parsed(files, state.load(spark, own), analysis.parsed)
    listed = F.from_json("parsed", "array<struct<line_start:long,line_end:long,name:string>>")
    return found.select("path", F.size(listed).cast("long").alias("n_symbols"), F.array_join(F.transform(listed, lambda x: x["name"]), ",").alias("names"), "cached")


@query(f"WITH {_symbols} SELECT DISTINCT name, kind, visibility, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end FROM symbols")
def s5_project_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different symbols of a project, parsed from the contents of all its files."""
    return analysis.symbols(sources(spark, sf_dir)).drop("path").distinct()


@query(f"WITH {_symbols} SELECT count(DISTINCT path)::BIGINT AS n_records, count(*)::BIGINT AS n_symbols, count(DISTINCT name)::BIGINT AS n_names FROM symbols")
def k3_parsed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of every content is stored with the symbols that are parsed from it, and read again."""
    own = table(spark, "parsed_metadata", state.METADATA)
    state.put(analysis.metadata(sources(spark, sf_dir)), own, "hash")
    record = F.from_json("json", "hash string, symbols array<struct<name:string>>")
    rows = state.load(spark, own).select("hash", F.explode(record["symbols"]["name"]).alias("name"))
    return rows.agg(F.countDistinct("hash").alias("n_records"), F.count("*").alias("n_symbols"), F.countDistinct("name").alias("n_names"))
