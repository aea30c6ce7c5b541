"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treequarry.llm import alignment, bpe, decontaminate, html_text, packing, quality, simhash, substrings, token_counts, token_files, urls, vector_codes, warc
from treequarry.llm.common import read_table


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(read_table(spark, sf_dir, "pages")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(read_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(read_table(spark, sf_dir, "pages"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(read_table(spark, sf_dir, "pages"))


def op11_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_alignment(read_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc_derivatives, op2_token_files, op3_token_counts, op4_decontamination, op5_substring_dedup, op6_best_fit_packing, op7_simhash, op8_quality_rules, op9_url_filters, op10_html_extraction, op11_byte_level_bpe, op12_token_alignment, op13_vector_codes)}

LOWERED = f"translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}')"
ITEM_WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {ITEM_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {ITEM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, w[i : i + least(10, len(w)) - 1] AS win FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(win) AS m FROM p),
windows AS (SELECT row, i, m, w[i : i + m - 1] AS win FROM (SELECT row, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, lengths WHERE len(w) >= m)),
hit AS (SELECT row, i, m, item FROM windows JOIN p USING (win)),
words AS (SELECT row, count(DISTINCT j) AS n_hit FROM (SELECT row, unnest(generate_series(i, i + m - 1)) AS j FROM hit) GROUP BY row),
items AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)
"""

QUALITY_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT row, doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g') AS solid, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
windows AS (SELECT row, i, w[i : i + 4] AS win FROM (SELECT row, w, unnest(generate_series(1, len(w) - 4)) AS i FROM f WHERE len(w) >= 5)),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest(generate_series(i, i + 4)) AS j FROM again) GROUP BY row),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(solid)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
  strlen(solid) AS bytes, strlen(regexp_replace(solid, '[\\x00-@\\[-`{-\\x7F]', '', 'g')) AS letters, strlen(regexp_replace(solid, '[^A-Z]', '', 'g')) AS capitals, strlen(regexp_replace(solid, '[^a-z]', '', 'g')) AS small FROM f LEFT JOIN repeats USING (row)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_symbols <= 0.2 * n_words AND 100 * n_dup_lines <= 40 * n_lines
  AND word_chars / n_words BETWEEN 1.5 AND 20 AND capitals <= 9 * small AND letters >= 0.4 * bytes AS kept FROM judged
"""



def url_sql() -> str:
    """The verdicts with every round of both spreads written out."""
    lower = lambda x: f"translate({x}, '{urls.UPPER}', '{urls.LOWER}')"
    link = urls.LINK.replace("'", "''")
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
    rounds = []
    for name, seed, a, b in (("trust", "allowed", "src", "dst"), ("distrust", "blocked", "dst", "src")):
        rounds.append(f"{name}_share AS (SELECT {a} AS a, {b} AS b, weight / sum(weight) OVER (PARTITION BY {a}) * {urls.DAMPING} AS share FROM edges)")
        rounds.append(f"{name}_0 AS (SELECT host, {seed} * (1 - {urls.DAMPING}) AS score FROM seeds WHERE {seed} > 0)")
        rounds += [f"{name}_{k} AS (SELECT host, sum(score) AS score FROM (SELECT * FROM {name}_0 UNION ALL SELECT b, score * share FROM {name}_{k - 1} JOIN {name}_share ON host = a) GROUP BY host)" for k in range(1, urls.ROUNDS + 1)]
    return f"""
WITH parts AS (SELECT row_number() OVER () AS row, page_id, {lower(f"coalesce(regexp_extract(url, '{urls.PARTS}', 1), '')")} AS host, coalesce(regexp_extract(url, '{urls.PARTS}', 2), '') AS path, html FROM pages),
rules(h, p, v) AS (VALUES {rules}),
fit AS (SELECT row, arg_max(h || p, (len(h) + len(p), h, p)) AS rule, arg_max(v, (len(h) + len(p), h, p)) AS verdict FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row),
edges AS (SELECT src, dst, count(*) AS weight FROM (SELECT host AS src, {lower("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM parts WHERE contains(html, '//')) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
seeds AS (SELECT host, avg((verdict IS NOT DISTINCT FROM 'allow')::INT) AS allowed, avg((verdict IS NOT DISTINCT FROM 'block')::INT) AS blocked FROM parts LEFT JOIN fit USING (row) WHERE host <> '' GROUP BY host),
{", ".join(rounds)},
scores AS (SELECT host, sum(score) AS score FROM (SELECT host, -score AS score FROM trust_{urls.ROUNDS} UNION ALL SELECT * FROM distrust_{urls.ROUNDS}) GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score > {urls.THRESHOLD} THEN 'block' END, 'allow') AS verdict FROM parts LEFT JOIN fit USING (row) LEFT JOIN scores USING (host)
"""


ORACLE_SQL: dict[str, str] = {"op1_warc_derivatives": warc.oracle(), "op4_decontamination": DECONTAMINATION_SQL, "op8_quality_rules": QUALITY_SQL, "op9_url_filters": url_sql(), "op13_vector_codes": vector_codes.oracle()}
