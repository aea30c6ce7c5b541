"""Blocks of HTML, style sheets, XML and Markdown as rows: path, name, line_start, line_end.

Scripts, styles and roots are read by patterns over a file's text, with lines counted from the line ends before each block.
Elements at the top are found by one pass over a file's tags, style rules from rows of tokens, so braces in strings,
comments and addresses do not count. Markdown is read line by line with windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treequarry.operators import lexed

#: What stands before a block, and the block; `\G`: behind the last block a text is searched once, not from each of its characters.
HTML_BLOCKS = r"(?is)\G(.*?)(<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>)"
XML_ROOT = r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<![A-Za-z][^>]*>)*<([A-Za-z_][A-Za-z0-9_.:-]*)"
#: A comment or declaration, a script or style with its text, or a tag: its slash, name, and slash at the end.
TAGS = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)(?:[^"'>]|"[^"]*"|'[^']*')*?(/?)>""", re.I | re.S)
#: Fixed values of HTML: elements without content, and elements whose tags end a paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TAILWIND = ("@tailwind", "@apply", "@layer")


def shortened(text: Column) -> Column:
    """Texts of more than 50 bytes are cut after 47 characters; what is empty says so."""
    plain = F.btrim(text, F.lit(" \t\r\n"))
    return F.when(plain == "", "<empty>").when(F.octet_length(plain) > 50, F.concat(F.substring(plain, 1, 47), F.lit("..."))).otherwise(plain)


def _line_ends(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def inner_blocks(content: str, pattern: re.Pattern) -> Iterator[tuple[str, int, int]]:
    """Text, first and last line of each block that a pattern of two groups finds, one right behind another."""
    at, line = 0, 1
    while found := pattern.match(content, at):
        first = line + found[1].count("\n")
        line = first + found[2].count("\n")
        yield found[2], first, line
        at = found.end()


def _in_place(pattern: str) -> re.Pattern:
    # a match begins where it is asked for, which is what `\G` says
    return re.compile(pattern.replace(r"\G", ""), re.ASCII)


def _blocks(files: DataFrame, pattern: str) -> DataFrame:
    """path, block, line_start, line_end of what a pattern of two groups finds one after another; no text leaves its task."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = _in_place(pattern)
        for batch in batches:
            rows = [(path, *block) for path, content in zip(batch["path"], batch["content"], strict=True) for block in inner_blocks(content, find)]
            yield pd.DataFrame(rows, columns=["path", "block", "line_start", "line_end"])

    return files.filter("content is not null").select("path", "content").mapInPandas(of, "path string, block string, line_start long, line_end long")


def top_elements(content: str) -> Iterator[tuple[int, int]]:
    """First and last line of each element outside of all others; one that nothing closes ends with the text."""
    open_name, depth, began, line, counted = None, 0, 0, 1, 0
    for tag in TAGS.finditer(content):
        closes, name, alone = tag[2], (tag[3] or "").lower(), tag[4]
        if not name:
            continue
        line += content.count("\n", counted, tag.start())
        last = line + tag[0].count("\n")
        if open_name == "p" and not closes and name in ENDS_PARAGRAPH:
            yield began, 1 + content[: tag.start()].rstrip().count("\n")
            open_name = None
        if open_name is None:
            if not closes and (alone or name in VOID):
                yield line, last
            elif not closes:
                open_name, depth, began = name, 1, line
        elif name == open_name and not alone:
            depth += -1 if closes else 1
            if depth == 0:
                yield began, last
                open_name = None
        line, counted = last, tag.end()
    if open_name is not None:
        yield began, 1 + content.rstrip().count("\n")


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    find = _in_place(HTML_BLOCKS)
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows += [(path, "<element>", first, last) for first, last in top_elements(content)]
            rows += [(path, "<script>" if block[:7].lower() == "<script" else "<style>", first, last) for block, first, last in inner_blocks(content, find)]
        yield pd.DataFrame(rows, columns=["path", "name", "line_start", "line_end"])


def html_blocks(files: DataFrame) -> DataFrame:
    """`<element>` for each element at the top, `<script>` and `<style>` for each of their blocks, wherever they are.

    A page is read once, for both, and its text does not move.
    """
    return files.filter("content is not null").select("path", "content").mapInPandas(_pages, "path string, name string, line_start long, line_end long")


def css_blocks(files: DataFrame) -> DataFrame:
    """A row for each rule at the top, named by its selectors, and for each at-rule, named by its keyword.

    A statement ends with the brace that closes its block, or with a `;` outside of all blocks.
    """
    tokens = lexed.nested(files, "css", leaves="path at text kind line_no end_line start opens before.text before.kind", opening=["{"], closing=["}"], top=True)
    order = Window.partitionBy("path").orderBy("at")
    ends = (F.col("kind") == "sign") & F.col("text").isin("}", ";")
    # of a statement its first token, its brace and its end tell everything
    begins = F.col("before").isNull() | ((F.col("before.kind") == "sign") & F.col("before.text").isin("{", "}", ";"))
    rows = tokens.withColumn("ends", ends).filter(F.col("opens") | F.col("ends") | begins).withColumn("nth", F.coalesce(F.sum(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    head = F.min(F.when(F.col("opens") | F.col("ends"), F.col("start")))
    found = rows.groupBy("path", "nth").agg(F.min("start").alias("from"), head.alias("to"), F.min("line_no").alias("line_start"), F.max("end_line").alias("line_end"), F.max("opens").alias("block"), F.max("ends").alias("ended"))
    named = lexed.sliced(found.filter("ended"), files, head=(F.col("from"), F.col("to")))
    keyword = F.regexp_extract("head", r"^(@[A-Za-z-]+)", 1)
    name = F.when(keyword == "", shortened(F.col("head"))).when(keyword.isin(*TAILWIND), F.concat(keyword, F.lit(" (Tailwind)"))).otherwise(keyword)
    return named.filter(F.col("block") | (keyword != "")).select("path", name.alias("name"), "line_start", "line_end")


def xml_roots(files: DataFrame) -> DataFrame:
    """`<tag>` of the root element."""
    root = F.regexp_extract("content", XML_ROOT, 1)
    before = F.regexp_extract("content", XML_ROOT.replace("^(?:", "^((?:").replace(")*<(", ")*)<("), 1)
    last = _line_ends(F.regexp_replace("content", r"\s+\z", "")) + 1
    return files.filter(F.col("content").rlike(XML_ROOT)).select("path", F.concat(F.lit("<"), root, F.lit(">")).alias("name"), (_line_ends(before) + 1).alias("line_start"), last.alias("line_end"))


def markdown_blocks(lines: DataFrame) -> DataFrame:
    """Headings with their level in front, underlined ones too, and fenced blocks as ``` and their language; lines: path,
    line_no, text. A block without an end ends with the file. Heads inside of fences are none.
    """
    order = Window.partitionBy("path").orderBy("line_no")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    fence = F.col("text").rlike("^ {0,3}```")
    rows = lines.withColumn("fence", fence).withColumn("open", F.coalesce(F.sum(F.when(fence, 1).otherwise(0)).over(before), F.lit(0)) % 2 == 1)
    rows = rows.withColumn("next_fence", F.min(F.when(F.col("fence"), F.col("line_no"))).over(after)).withColumn("last", F.max("line_no").over(Window.partitionBy("path")))
    rows = rows.withColumn("above", F.lag("text").over(order)).withColumn("above_fence", F.lag(F.col("fence") | F.col("open")).over(order))
    # a closing fence takes no language, so what it opens or closes is told by how many came before
    fenced = rows.filter("fence and not open").select("path", F.concat(F.lit("```"), F.coalesce(F.nullif(F.btrim(F.regexp_extract("text", "^ *```(.*)", 1)), F.lit("")), F.lit("code"))).alias("name"), F.col("line_no").alias("line_start"), F.coalesce("next_fence", "last").alias("line_end"))
    plain = rows.filter("not fence and not open")
    atx = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"
    heads = plain.filter(F.col("text").rlike(atx)).select("path", F.concat(F.regexp_extract("text", atx, 1), F.lit(" "), shortened(F.regexp_extract("text", atx, 2))).alias("name"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"))
    text_above = ~F.coalesce("above_fence", F.lit(True)) & (F.btrim("above") != "") & ~F.col("above").rlike(r"^ {0,3}(#{1,6}([ \t]|$)|[-*+>] |=+[ \t]*$|-+[ \t]*$)")
    under = plain.filter(F.col("text").rlike(r"^ {0,3}(=+|-+)[ \t]*$") & text_above)
    mark = F.when(F.btrim("text").startswith("="), "# ").otherwise("## ")
    lined = under.select("path", F.concat(mark, shortened(F.col("above"))).alias("name"), (F.col("line_no") - 1).alias("line_start"), F.col("line_no").alias("line_end"))
    return heads.unionByName(lined).unionByName(fenced)
