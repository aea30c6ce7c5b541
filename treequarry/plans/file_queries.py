"""Queries over files, paths, lines and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treequarry.functions import paths as P
from treequarry.functions import text as T
from treequarry.operators import files as O
from treequarry.operators import policy
from treequarry.plans.registry import query
from treequarry.session import shared_folder
from treequarry.sources import tables as S

quoted = lambda names: ", ".join(f"'{n}'" for n in names)
BASE = "regexp_extract(path, '[^/]*$')"
EXT = f"CASE WHEN regexp_matches({BASE}, '^.+\\.[^.]*$') THEN regexp_extract({BASE}, '^.+\\.([^.]*)$', 1) END"
LANGUAGE = "CASE " + " ".join(f"WHEN ({EXT}) IN ({quoted(e)}) THEN '{n}'" for n, e in P.LANGUAGES.items()) + " ELSE 'unknown' END"


@query(f"SELECT path, coalesce(({EXT}) IN ({quoted(P.SUPPORTED)}), false) AS supported FROM fx_files")
def s2_supported_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.files(spark, sf_dir).select("path", P.supported(F.col("path")).alias("supported"))


ODD = "CASE WHEN octet_length(content) % 7 = 0 THEN concat(content, chr(0)) ELSE content END"


@query(f"SELECT path, path LIKE '%.zig' OR n % 7 = 0 AND n <= 8191 AS is_binary FROM (SELECT path, strlen(content) AS n FROM fx_files)")
def s17_binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh length gets a zero byte at its end, and one extension a binary one."""
    odd = S.files(spark, sf_dir).select("path", F.regexp_replace("path", r"\.zig$", ".PNG").alias("p"), F.expr(ODD).alias("content"))
    return odd.select("path", P.is_binary(F.col("p"), F.col("content")).alias("is_binary"))


PATTERNS = [("dir", "src/src1/"), ("regex", r"\.py$"), ("glob", "web/*/index.html"), ("glob", "src/**/README.md"), ("glob", "src/src?/[!e]*/d1[0-9]/*"), ("file", "web/p3/index.html")]


@query(
    "SELECT pattern, path FROM (SELECT * FROM fx_files, (VALUES "
    + ", ".join(f"('{k}', '{p}', '{P.glob_regex(p) if k == 'glob' else p}')" for k, p in PATTERNS)
    + ") AS w(kind, pattern, regex)) WHERE CASE kind WHEN 'dir' THEN starts_with(path, pattern) WHEN 'file' THEN path = pattern ELSE regexp_matches(path, regex) END"
)
def s20_affected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.affected(S.files(spark, sf_dir), PATTERNS)


#: Ignore files of the walked tree; the first stands at the root and is also what single paths are held against.
IGNORED = {
    ".gitignore": "# built\n*.md\n!README.md\nsrc/src1/\n/web/p?/\nd1[0-3]*/\n\ntarget/\n",
    "src/src0/.gitignore": "*.py\n!/de/**/*.py\n",
    "src/src3/.gitignore": "*.py\n",
    "src/.ignore": "*.zig\n!/src3/de/**/*.py\n",
}
_rules = "(1, '^(.*/)?[^/]*\\.md$', false, false), (2, '^(.*/)?README\\.md$', true, false), (3, '^src/src1$', false, true), (4, '^web/p[^/]$', false, true), (5, '^(.*/)?d1[0-3][^/]*$', false, true), (6, '^(.*/)?target$', false, true)"
_verdicts = f"""rules(ord, regex, negated, folders) AS (VALUES {_rules}), places AS (SELECT path, n, len(parts) AS m, array_to_string(parts[1:n], '/') AS place FROM (SELECT path, parts, unnest(generate_series(1, len(parts))) AS n FROM (SELECT path, string_split(path, '/') AS parts FROM fx_files))),
 verdicts AS (SELECT path, n, NOT arg_max(negated, ord) AS out FROM places JOIN rules ON regexp_matches(place, regex) AND (n < m OR NOT folders) GROUP BY path, n)"""


@query(f"WITH {_verdicts} SELECT path, coalesce(out, false) AS ignored FROM fx_files LEFT JOIN (SELECT path, arg_max(out, n) AS out FROM verdicts GROUP BY path) USING (path)")
def s3_ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ignore file against paths: the path itself first, then its folders upwards."""
    return S.files(spark, sf_dir).select("path", O.is_ignored(F.col("path"), O.ignore_rules(IGNORED[".gitignore"])).alias("ignored"))


_left_out = (
    "starts_with(path, 'src/src1/') OR regexp_matches(path, '^web/p[^/]/') OR regexp_matches(path, '/d1[0-3][^/]*/') OR path LIKE '%.zig' OR path LIKE '%.md' AND path NOT LIKE '%/README.md' "
    "OR (starts_with(path, 'src/src0/') OR starts_with(path, 'src/src3/')) AND path LIKE '%.py' AND split_part(path, '/', 3) <> 'de'"
)


@query(f"SELECT path, strlen(coalesce(content, ''))::BIGINT AS size, sha256(coalesce(content, '')) AS hash FROM fx_files WHERE (({EXT}) IN ({quoted(P.SUPPORTED)})) AND NOT ({_left_out})")
def s1_project_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files written out as a tree, with ignore files at three places, version control and built files; then scanned."""
    root = shared_folder(spark, "tree")
    files = S.files(spark, sf_dir)
    built = files.filter("path like '%.rs'").select(F.explode(F.array(F.concat(F.lit(".git/"), "path"), F.concat(F.lit("src/target/"), "path"))).alias("path"), "content")
    O.write_tree(files.unionByName(built).unionByName(spark.createDataFrame(list(IGNORED.items()), "path string, content string")), root)
    return O.scan(spark, root).select("path", "size", F.sha2("content", 256).alias("hash"))


@query("SELECT path, line_no, text FROM fx_lines")
def d3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lines(spark, sf_dir)


@query(f"SELECT path, {LANGUAGE} AS language, ({LANGUAGE}) IN ({quoted(P.CODE)}) AS is_code FROM fx_files")
def p1_language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.files(spark, sf_dir).select("path", P.language(F.col("path")).alias("language"), P.is_code(F.col("path")).alias("is_code"))


@query("SELECT path, n AS tokens, n * 60 // 100 AS at_level_2, n * 20 // 100 AS at_level_1 FROM (SELECT path, (strlen(content) // 4)::BIGINT AS n FROM fx_files)")
def t1_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.files(spark, sf_dir).select("path", T.estimated_tokens(F.col("content")).alias("tokens"))
    return n.select("path", "tokens", F.floor(F.col("tokens") * 60 / 100).cast("long").alias("at_level_2"), F.floor(F.col("tokens") * 20 / 100).cast("long").alias("at_level_1"))


@query("SELECT doc_id, hash, substr(hash, 1, 7) AS short, substr(hash, 1, 2) AS first, substr(hash, 3, 2) AS second, substr(hash, 5) AS rest FROM fx_objects")
def t2_hash_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.objects(spark, sf_dir).select("doc_id", "hash", *T.hash_parts(F.col("hash")))


@query(f"SELECT path, {BASE} AS base, {EXT} AS ext, regexp_replace({BASE}, '^(.+)\\.[^.]*$', '\\1') AS stem, regexp_replace(path, '/?[^/]*$', '') AS parent FROM fx_files")
def t5_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return S.files(spark, sf_dir).select("path", P.file_name(p).alias("base"), P.extension(p).alias("ext"), P.stem(p).alias("stem"), P.parent(p).alias("parent"))


@query(
    "SELECT p_partkey, mode, CASE WHEN regexp_matches(mode, '^[0-7]+$') THEN (SELECT sum((try_cast(substr(mode, i, 1) AS BIGINT)) * (8 ** (len(mode) - i)))::BIGINT FROM generate_series(1, len(mode)) AS g(i)) ELSE 420 END AS bits "
    "FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'rwx' ELSE ((p_size * 7 + p_partkey) % 1000)::VARCHAR END AS mode FROM part)"
)
def t7_octal_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("p_partkey") % 11 == 0, "rwx").otherwise(((F.col("p_size") * 7 + F.col("p_partkey")) % 1000).cast("string"))
    return S.table(spark, sf_dir, "part").select("p_partkey", mode.alias("mode")).withColumn("bits", T.mode_bits(F.col("mode")))


#: A fixed policy: the first entry that fits is not always the one that covers.
POLICY = [
    ("black", 1, "file", "web/p1/index.html", None),
    ("black", 2, "dir", "src/src1/", None),
    ("black", 3, "regex", r"\.py$", [(2, 3)]),
    ("black", 4, "regex", r"\.(py|rs)$", [(1, 1), (5, 8)]),
    ("black", 5, "regex", r"/de/.*\.md$", None),
    ("white", 1, "dir", "src/src2/", None),
    ("white", 2, "regex", r"\.ts$", [(1, 4)]),
    ("white", 3, "regex", r"^web/", None),
    ("white", 4, "dir", "src/", [(2, 2)]),
]
_values = ", ".join(f"('{w}', {o}, '{k}', '{p}', {'NULL' if r is None else '[' + ', '.join(f'[{a}, {b}]' for a, b in r) + ']'})" for w, o, k, p, r in POLICY)
_fits = f"""policy(list, ord, kind, pattern, ranges) AS (VALUES {_values}),
 fit AS (SELECT l.path, l.line_no, list, ord, ranges IS NULL OR len(list_filter(ranges, lambda r: line_no BETWEEN r[1] AND r[2])) > 0 AS hit FROM fx_lines l LEFT JOIN policy
 ON CASE kind WHEN 'file' THEN path = pattern WHEN 'dir' THEN starts_with(path, pattern) ELSE regexp_matches(path, pattern) END)"""


def _policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY, policy.POLICY)


@query(f"WITH {_fits} SELECT path, line_no, coalesce(arg_min(hit, ord) FILTER (list = 'black'), false) AS hidden FROM fit GROUP BY path, line_no")
def f2_policy_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.hidden_lines(S.lines(spark, sf_dir), _policy(spark), whitelist=False, files=S.files(spark, sf_dir))


@query(f"WITH {_fits} SELECT path, line_no, coalesce(bool_or(hit) FILTER (list = 'black'), false) OR coalesce(NOT arg_min(hit, ord) FILTER (list = 'white'), true) AS hidden FROM fit GROUP BY path, line_no")
def f3_policy_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.hidden_lines(S.lines(spark, sf_dir), _policy(spark), whitelist=True, files=S.files(spark, sf_dir))


PREFIXES = ["", "./", "../", ".", ".treequarry/", "a/.git/", "x\x01", "CVS/", ".treequarry_config"]
_codes = "CASE WHEN starts_with(p, './') OR starts_with(p, '../') THEN 'E001' WHEN starts_with(p, '.') THEN 'E002' WHEN regexp_matches(p, '[\\x00-\\x1f\\x7f]') THEN 'E023' WHEN p LIKE '%a/.git/%' OR starts_with(p, 'CVS/') THEN 'E020' END"


@query(
    f"SELECT doc_id, p AS path, {_codes} AS error FROM (SELECT doc_id, ([{', '.join('chr(120) || chr(1)' if x == PREFIXES[6] else repr(x) for x in PREFIXES)}])[doc_id % 9 + 1] || 'd' || doc_id || '/f.rs' AS p FROM documents)"
)
def f9_path_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), F.pmod("doc_id", F.lit(9)).cast("int") + 1)
    return S.table(spark, sf_dir, "documents").select("doc_id", F.concat(prefix, F.lit("d"), "doc_id", F.lit("/f.rs")).alias("path")).withColumn("error", P.path_error(F.col("path")))


@query(
    "SELECT doc_id, t AS text, regexp_matches(t, '^\\.\\.\\.\\[[0-9a-f]+\\]\\.{0,3}$') AS is_marker FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '...[' || h || ']' WHEN 1 THEN '...[' || h || ']...' WHEN 2 THEN '...[' || h || ']....' WHEN 3 THEN '..[' || h || ']' ELSE upper('...[' || h || 'a]') END AS t "
    "FROM (SELECT doc_id, substr(hash, 1, 7) AS h FROM fx_objects))"
)
def f17_marker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.substring("hash", 1, 7)
    body = F.concat(F.lit("...["), h, F.lit("]"))
    text = F.when(F.col("doc_id") % 5 == 0, body).when(F.col("doc_id") % 5 == 1, F.concat(body, F.lit("..."))).when(F.col("doc_id") % 5 == 2, F.concat(body, F.lit("...."))).when(F.col("doc_id") % 5 == 3, F.concat(F.lit("..["), h, F.lit("]"))).otherwise(F.upper(F.concat(F.lit("...["), h, F.lit("a]"))))
    return S.objects(spark, sf_dir).select("doc_id", text.alias("text")).withColumn("is_marker", T.is_marker(F.col("text")))


@query("SELECT doc_id, h AS hash, regexp_matches(h, '^[0-9a-fA-F]{7,64}$') AS valid FROM (SELECT doc_id, substr(hash || 'g', (doc_id % 3 * 32 + 1)::BIGINT, (doc_id % 70)::BIGINT) AS h FROM fx_objects)")
def f18_hash_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.expr("substring(concat(hash, 'g'), cast(doc_id % 3 * 32 + 1 as int), cast(doc_id % 70 as int))")
    return S.objects(spark, sf_dir).select("doc_id", cut.alias("hash")).withColumn("valid", T.is_hash(F.col("hash")))


_version = "p_size % 3 || '.' || p_partkey % 4 || '.' || p_size % 5 || CASE WHEN p_partkey % 6 = 0 THEN '-rc1' WHEN p_partkey % 7 = 0 THEN '.9' WHEN p_partkey % 11 = 0 THEN '-rc.1' ELSE '' END"


@query(f"SELECT p_partkey, v AS version, len(parts) = 3 AND [split_part(parts[1], '-', 1)::INT, split_part(parts[2], '-', 1)::INT, split_part(parts[3], '-', 1)::INT] > [1, 2, 3] AS newer FROM (SELECT *, string_split(v, '.') AS parts FROM (SELECT p_partkey, {_version} AS v FROM part))")
def f22_newer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part")
    version = F.concat((F.col("p_size") % 3).cast("string"), F.lit("."), (F.col("p_partkey") % 4).cast("string"), F.lit("."), (F.col("p_size") % 5).cast("string"), F.when(F.col("p_partkey") % 6 == 0, "-rc1").when(F.col("p_partkey") % 7 == 0, ".9").when(F.col("p_partkey") % 11 == 0, "-rc.1").otherwise(""))
    return part.select("p_partkey", version.alias("version")).withColumn("newer", T.is_newer(F.col("version"), F.lit("v1.2.3")))


@query("WITH wider AS (SELECT path, s, e FROM fx_ranges UNION SELECT path, s - 1, e + 2 FROM fx_ranges) SELECT a.path, a.s, a.e, b.s AS o_s, b.e AS o_e FROM wider a JOIN wider b ON a.path = b.path AND a.s <= b.e AND b.s <= a.e AND (a.s, a.e) < (b.s, b.e)")
def j11_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.ranges(spark, sf_dir)
    return policy.overlaps(r.unionByName(r.select("path", (F.col("s") - 1).alias("s"), (F.col("e") + 2).alias("e"))))


_hidden = "hidden AS (SELECT r.path, s, e, string_agg(l.text, chr(10) ORDER BY line_no) AS content FROM fx_ranges r JOIN fx_lines l ON l.path = r.path AND line_no BETWEEN s AND e GROUP BY ALL)"
_shown = f"""{_hidden}, shown AS (SELECT l.path, line_no, CASE WHEN s IS NULL THEN text WHEN line_no > s THEN '' WHEN s = e THEN '...[' || substr(sha256(content), 1, 7) || ']...' ELSE '...[' || substr(sha256(content), 1, 7) || ']' END AS text
 FROM fx_lines l LEFT JOIN hidden h ON l.path = h.path AND line_no BETWEEN s AND e)"""


@query(f"WITH {_shown} SELECT * FROM shown")
def j12_render_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.rendered(S.lines(spark, sf_dir), S.ranges(spark, sf_dir))


@query(f"WITH {_hidden} SELECT path, s, e, sha256(content) AS hash, strlen(content)::BIGINT AS size FROM hidden")
def m2_hidden_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.range_hashes(S.lines(spark, sf_dir), S.ranges(spark, sf_dir)).select("path", "s", "e", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"))


@query("SELECT path, line_no, text FROM fx_lines")
def m4_hide_and_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, ranges = S.lines(spark, sf_dir), S.ranges(spark, sf_dir)
    return policy.restored(policy.rendered(lines, ranges), policy.range_hashes(lines, ranges))


@query(f"WITH {_shown} SELECT l.path, line_no, CASE WHEN l.line_no BETWEEN 2 AND 3 THEN l.text ELSE shown.text END AS text FROM fx_lines l JOIN shown USING (path, line_no)")
def m5_restore_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the hidden ranges of each file the first is restored."""
    lines, ranges = S.lines(spark, sf_dir), S.ranges(spark, sf_dir)
    return policy.restored(policy.rendered(lines, ranges), policy.range_hashes(lines, ranges), (F.col("s") == 2) & (F.col("e") == 3))


@query("SELECT path, s, e FROM fx_ranges WHERE s = 5")
def m7_marker_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markers at line 5 are overwritten, and found out."""
    lines, ranges = S.lines(spark, sf_dir), S.ranges(spark, sf_dir)
    shown = policy.rendered(lines, ranges).withColumn("text", F.when(F.col("line_no") == 5, "edited").otherwise(F.col("text")))
    return policy.broken_markers(shown, policy.range_hashes(lines, ranges))


@query("SELECT l.path, line_no, line_no - s AS position FROM fx_lines l JOIN fx_ranges r ON l.path = r.path AND line_no BETWEEN s AND e")
def w9_marker_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.windowed_positions(S.lines(spark, sf_dir), S.ranges(spark, sf_dir))


@query("SELECT path, line_no, CASE WHEN line_no > 9999 THEN line_no::VARCHAR ELSE lpad(line_no::VARCHAR, 4, ' ') END || ' | ' || text AS shown FROM fx_lines")
def x5_numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.numbered(S.lines(spark, sf_dir))


@query("SELECT path, line_no, text FROM fx_lines WHERE line_no BETWEEN 2 AND 4")
def o4_line_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.sliced(S.lines(spark, sf_dir), 2, 4)
