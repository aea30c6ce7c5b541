"""The driver's tables recast as the engine's: files, lines, symbols, calls, edges, actions, objects, hunks, ranges.

Each is a view of whole tables. The star schema's foreign keys become a call graph, conversations become files of
functions, documents and pages become files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treequarry.functions import text as T

EXTENSIONS = "rs py ts go zig sh tf yaml html css xml md js".split()
STEMS = {"yaml": "Chart", "md": "README", "css": "styles", "xml": "pom", "zig": "build", "sh": "run"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content"""
    docs = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), F.pmod("doc_id", F.lit(13)).cast("int") + 1)
    known = F.lit("main")
    for e, s in STEMS.items():
        known = F.when(F.col("ext") == e, s).otherwise(known)
    name = F.when(F.col("doc_id") % 5 == 0, known).otherwise(F.concat(F.lit("doc_"), "doc_id"))
    path = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/d"), "doc_id", F.lit("/"), name, F.lit("."), "ext")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("web/p"), "page_id", F.lit("/index.html")).alias("path"), F.col("html").alias("content"))
    return docs.withColumn("ext", ext).select(path.alias("path"), F.col("text").alias("content")).unionByName(pages)


def lines_of(source: DataFrame) -> DataFrame:
    """Files to path, line_no (from 1), text."""
    return source.select("path", F.posexplode(T.lines(F.col("content"))).alias("line_no", "text")).withColumn("line_no", (F.col("line_no") + 1).cast("long"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(files(spark, sf_dir))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, name, kind, line_start, line_end, ordinal"""
    turns = table(spark, sf_dir, "conversations").withColumn("n", F.size(F.split("text", "\n")).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns.select(
        F.concat(F.lit("conv/c"), "conv_id", F.lit(".py")).alias("file"),
        F.concat("role", F.lit("_"), "turn").alias("name"),
        F.when(F.col("role") == "system", "Module").otherwise("Function").alias("kind"),
        (before + 1).alias("line_start"),
        (before + F.col("n")).alias("line_end"),
        (F.row_number().over(order) - 1).cast("long").alias("ordinal"),
    )


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, line_no, text: the lines under the symbols of conversations"""
    turns = table(spark, sf_dir, "conversations").withColumn("n", F.size(F.split("text", "\n")).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the sums come first: beside a generator a window would run over what it makes
    placed = turns.withColumn("before", before).select(F.concat(F.lit("conv/c"), "conv_id", F.lit(".py")).alias("file"), "before", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return placed.select("file", (F.col("before") + F.col("at") + 1).cast("long").alias("line_no"), "text")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, name, line_start, line_end, width: nested ranges over functions"""
    functions = symbols(spark, sf_dir).filter("kind = 'Function'").withColumn("width", F.explode(F.array(*[F.lit(w).cast("long") for w in (2, 4)])))
    group = F.floor(F.col("ordinal") / F.col("width"))
    return functions.groupBy("file", "width", group.alias("g")).agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end")).select("file", F.concat(F.lit("Class"), "width", F.lit("_"), "g").alias("name"), "line_start", "line_end", "width")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, caller, callee, line: each symbol calls the one before it"""
    order = Window.partitionBy("file").orderBy("ordinal")
    return symbols(spark, sf_dir).select("file", F.col("name").alias("caller"), F.lag("name").over(order).alias("callee"), F.col("line_start").alias("line")).filter("callee is not null")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst over foreign keys; repeated edges stay"""
    key = lambda prefix, column: F.concat(F.lit(prefix), F.col(column))
    t = lambda name: table(spark, sf_dir, name)
    pairs = [
        t("nation").select(key("R", "n_regionkey").alias("src"), key("N", "n_nationkey").alias("dst")),
        t("customer").select(key("N", "c_nationkey").alias("src"), key("C", "c_custkey").alias("dst")),
        t("orders").select(key("C", "o_custkey").alias("src"), key("O", "o_orderkey").alias("dst")),
        t("lineitem").select(key("O", "l_orderkey").alias("src"), key("S", "l_suppkey").alias("dst")),
        t("supplier").select(key("S", "s_suppkey").alias("src"), key("N", "s_nationkey").alias("dst")),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workspace, id, ts, command, event_id"""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("workspace"), F.row_number().over(order).cast("long").alias("id"), "ts", F.col("event_type").alias("command"), "event_id")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, hash, size"""
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("size"))


def referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes in use: those of documents labelled as good."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return objects(spark, sf_dir).join(good, "doc_id").select("hash").distinct()


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, hunk_no, old_count, new_count"""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    old = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.row_number().over(order).cast("long").alias("hunk_no"), old.alias("old_count"), (old + F.round(F.col("l_tax") * 100).cast("long") - 4).alias("new_count"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, s, e: hidden ranges of Python files, where the file is long enough"""
    counts = lines(spark, sf_dir).filter("path like '%.py'").groupBy("path").agg(F.count("*").alias("n"))
    wanted = F.array(*[F.struct(F.lit(n).alias("least"), F.lit(s).cast("long").alias("s"), F.lit(e).cast("long").alias("e")) for n, s, e in ((3, 2, 3), (5, 5, 5), (9, 8, 9))])
    return counts.select("path", "n", F.inline(wanted)).filter("n >= least").select("path", "s", "e")
