"""WARC derivatives: responses to linked metadata and plain-text conversion records (operator 1).

A table of WARC response records gives two records per response: `metadata` (application/warc-fields: the source's
status, headers, digest, title and number of links) and `conversion` (text/plain). Both name the response in
WARC-Refers-To and each other in WARC-Concurrent-To; the response's HTTP headers and payload digest are carried
over. Record ids are derived from the response's, so a repeated run gives the same ids. Nothing is shuffled. The plain
text and the title come from one pass over each payload in Python, which knows every character reference; all else is
DataFrame functions.

Records are written with Spark's text writer, whose line separator is the two line ends that close a WARC record,
and read back by their Content-Length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treequarry.llm.common import small_batches

DATE = "2024-01-01T00:00:00Z"
CONVERTER = "treequarry plain text"
#: The rest of a tag: quoted values may hold any sign.
REST = r"""(?:[^"'>]|"[^"]*"|'[^']*')*>"""
#: Comments, raw texts (which end with the page if nothing ends them), and elements that are hidden where they are closed.
HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|" + "|".join(rf"{tag}\b.*?(?:</{tag}\s*>|\z)" for tag in ("title", "script", "style")) + "|" + "|".join(rf"{tag}\b.*?</{tag}\s*>" for tag in ("noscript", "template")) + ")"
BREAK = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|caption|article|section|header|footer|nav|aside|main|blockquote|pre|form|dl|dt|dd|hr|address|figure|figcaption|details|summary|fieldset|legend|option|body)\b" + REST
#: Cells of a row stand apart on one line.
CELL = r"(?i)</?(?:td|th)\b" + REST
#: A sign that begins no tag is text; a tag with a quote that nothing closes ends at the next sign that could end it.
TAG = rf"<[A-Za-z/!?]{REST}|<[A-Za-z/!?][^>]*>"
TITLE = r"(?is)<title\b[^>]*>([^<]*)"
LINK = r"(?i)<a\b[^>]*\bhref="
#: The character references that the SQL knows; the ampersand comes last.
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def _uuid(text: Column) -> Column:
    """A record id from the hash of a text."""
    return F.regexp_replace(F.sha2(text, 256), "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "<urn:uuid:$1-$2-$3-$4-$5>")


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages as response records: page_id, record_id, target_uri, warc_date, http_headers, payload, payload_digest.

    A null url or html counts as empty. The id comes from url and payload, so equal pages have equal ids.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    digest = F.sha1(html)
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n"))
    return pages.select("page_id", _uuid(F.concat(F.lit("response|"), url, F.lit("|"), digest)).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), html.alias("payload"), F.concat(F.lit("sha1:"), digest).alias("payload_digest"))


def decoded(text: str) -> str:
    """All character references of HTML, once; a named no-break space is a plain one."""
    return entities.unescape(text.replace("&nbsp;", " ")) if "&" in text else text


_hidden, _break, _cell, _tag, _title, _link = (re.compile(p.replace(r"\z", r"\Z"), re.A) for p in (HIDDEN, BREAK, CELL, TAG, TITLE, LINK))
_spaces = re.compile(r"[ \t\r\f]{2,}|[\t\r\f]")


def plain_text(html: str) -> str:
    """What a page shows: a line for each block that is not empty, single spaces."""
    text = decoded(_tag.sub("", _cell.sub(" ", _break.sub("\n", _hidden.sub("", html)))))
    lines = (line.strip(" ") for line in _spaces.sub(" ", text).split("\n"))
    return "\n".join(line for line in lines if line)


def title(html: str) -> str:
    """The first title on one line, without markup characters."""
    found = _title.search(html)
    return " ".join(x for x in re.split(r"[ \t\r\n\f]+", decoded(found[1])) if x) if found else ""


def _read(payloads: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(plain_text(p), title(p), len(_link.findall(p))) for p in payloads], columns=["shown", "title", "links"])


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows per response: page_id, warc_type, record_id, refers_to, concurrent_to, target_uri, warc_date,
    content_type, source_headers, source_digest, block, block_digest, content_length, n_links.

    The title is the first title element's text on one line; a payload without one has an empty title, and an empty
    payload an empty conversion. Rows that repeat give the same records, ids included, again. Null columns of a record
    count as empty text; extra columns are dropped; an empty table gives an empty result. A payload is read whole.
    """
    known = {c: F.coalesce(c, F.lit("")) for c in ("record_id", "target_uri", "warc_date", "http_headers", "payload", "payload_digest")}
    small_batches(records.sparkSession)
    source = records.select("page_id", *[v.alias(k) for k, v in known.items()])
    # before the rows are two, so that Python gets each text once
    source = source.withColumn("read", F.pandas_udf(_read, "shown string, title string, links long")("payload")).select("*", "read.shown", "read.title")
    status = F.regexp_extract("http_headers", r"^HTTP/[0-9.]+ ([0-9]+)", 1)
    links = F.col("read.links")
    listed = F.regexp_replace(F.regexp_replace("http_headers", r"^HTTP[^\n]*\n", ""), r"(?m)^([^:\r\n]+:)", "source-$1")
    fields = F.concat(F.lit("source-status: "), status, F.lit("\r\n"), listed, F.lit("source-digest: "), F.col("payload_digest"), F.lit("\r\ntitle: "), F.col("title"), F.lit("\r\nlinks: "), links.cast("string"), F.lit("\r\n"))
    both = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("shown").alias("block")),
    )
    rows = source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"), links.alias("n_links"), F.inline(both))
    # the ids come after the rows are two, so that what they are made of is computed once
    other = F.when(F.col("warc_type") == "metadata", "conversion").otherwise("metadata")
    own = lambda kind: _uuid(F.concat(kind, F.lit("|"), "refers_to"))
    rows = rows.withColumn("record_id", own(F.col("warc_type"))).withColumn("concurrent_to", own(other))
    return rows.select("page_id", "warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type", "source_headers", "source_digest", "block", F.concat(F.lit("sha1:"), F.sha1("block")).alias("block_digest"), F.octet_length("block").cast("long").alias("content_length"), "n_links")


def serialised(records: DataFrame) -> DataFrame:
    """A column `value`: each derivative as the text of a WARC record, without the two line ends that close it."""
    lines = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Date": "warc_date", "WARC-Target-URI": "target_uri", "WARC-Refers-To": "refers_to", "WARC-Concurrent-To": "concurrent_to", "WARC-Block-Digest": "block_digest", "WARC-Source-Payload-Digest": "source_digest", "Content-Type": "content_type"}
    head = [x for name, column in lines.items() for x in (F.lit(f"{name}: "), F.col(column), F.lit("\r\n"))]
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), *head, F.lit("Content-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str, records_per_file: int = 100_000) -> None:
    """Derivatives as gzipped WARC files below `path`; lower `records_per_file` where records are long, as a file is read whole."""
    serialised(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


#: A record's head up to its empty line; some writers end lines without a carriage return.
HEAD = re.compile(rb"WARC/[0-9]\.[0-9]+\r?\n(.*?\r?\n)\r?\n", re.S)
NEXT = re.compile(rb"(?:^|(?<=\n))WARC/[0-9]\.[0-9]+\r?\n")
#: Names as the standard spells them, since they count alike in any case.
NAMES = {n.lower(): n for n in "WARC-Type WARC-Record-ID WARC-Date WARC-Target-URI WARC-Refers-To WARC-Concurrent-To WARC-Block-Digest WARC-Payload-Digest WARC-Truncated WARC-Warcinfo-ID WARC-Profile WARC-Filename WARC-IP-Address WARC-Identified-Payload-Type WARC-Segment-Number Content-Type Content-Length".split()}
SKIPPED = "skipped-bytes"
READ = "file string, number long, headers map<string,string>, block string"


def records_in(data: bytes) -> Iterator[tuple[dict[str, str], str]]:
    """Headers and block of each record. What cannot be read up to the next record's first line is a row with the header
    `skipped-bytes`; a record without a length, or longer than the file, is such a stretch."""
    at, bad = 0, None
    while at < len(data):
        head = HEAD.match(data, at)
        headers = {}
        for line in head[1].decode("utf-8", "replace").splitlines() if head else ():
            name, colon, value = line.partition(":")
            if colon:
                headers[NAMES.get(name.strip().lower(), name.strip())] = value.strip()
        length = headers.get("Content-Length", "")
        if head and length.isascii() and length.isdigit() and head.end() + int(length) <= len(data):
            if bad is not None:
                yield {SKIPPED: str(at - bad)}, ""
            end = head.end() + int(length)
            yield headers, data[head.end() : end].decode("utf-8", "replace")
            bad, at = None, end
            while data[at : at + 1] in (b"\r", b"\n"):
                at += 1
        else:
            bad = at if bad is None else bad
            following = NEXT.search(data, at + 1)
            at = following.start() if following else len(data)
    if bad is not None:
        yield {SKIPPED: str(at - bad)}, ""


def read_warc(spark: SparkSession, path: str, files: str = "part-*") -> DataFrame:
    """Records of gzipped or plain WARC files: file, number, headers (a map, names as the standard spells them), block.

    A broken record costs no other: reading goes on with the next one, and what was skipped is a row of its own (see
    `records_in`). Each file is one row of its reader, so files are limited to 2 GB by Spark; records come out one batch at a
    time. Bytes that are not UTF-8 are replaced.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for number, record in enumerate(records_in(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)):
                    rows.append((name, number, *record))
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=["file", "number", "headers", "block"])
                        rows = []
                yield pd.DataFrame(rows, columns=["file", "number", "headers", "block"])

    return spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("path", "content").mapInPandas(parse, READ)


def responses_of(records: DataFrame) -> DataFrame:
    """The responses among records of `read_warc`, as `derivatives` takes them; page_id is null.

    The block of a response is its HTTP head, an empty line, and the payload; its digest is taken over where it is given.
    """
    header = lambda name: F.coalesce(F.col("headers")[name], F.lit(""))
    cut = F.locate("\r\n\r\n", F.col("block"))
    head = F.when(cut > 0, F.expr("substring(block, 1, locate('\\r\\n\\r\\n', block) + 1)")).otherwise(F.col("block"))
    payload = F.when(cut > 0, F.expr("substring(block, locate('\\r\\n\\r\\n', block) + 4)")).otherwise("")
    digest = F.coalesce(F.col("headers")["WARC-Payload-Digest"], F.concat(F.lit("sha1:"), F.sha1(payload)))
    own = records.filter(header("WARC-Type") == "response")
    return own.select(F.lit(None).cast("long").alias("page_id"), header("WARC-Record-ID").alias("record_id"), header("WARC-Target-URI").alias("target_uri"), header("WARC-Date").alias("warc_date"), head.alias("http_headers"), payload.alias("payload"), digest.alias("payload_digest"))


def oracle(date: str = DATE) -> str:
    """DuckDB SQL for `derivatives(responses(pages))`."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    raw = lambda s: "'" + s.replace("'", "''") + "'"
    uuid = lambda h: "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"
    text = f"regexp_replace(payload, {q(HIDDEN)}, '', 'g')"
    for pattern, put in ((BREAK, "chr(10)"), (CELL, "' '"), (TAG, "''")):
        text = f"regexp_replace({text}, {q(pattern)}, {put}, 'g')"
    title = f"regexp_extract(payload, {q(TITLE)}, 1)"
    for reference, char in REFERENCES.items():
        text, title = (f"replace({x}, {raw(reference)}, {raw(char)})" for x in (text, title))
    text = f"trim(regexp_replace(regexp_replace({text}, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"
    end = "chr(13) || chr(10)"
    return f"""
WITH page AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
response AS (SELECT *, {uuid("sha256('response|' || target_uri || '|' || sha1(payload))")} AS refers_to, 'sha1:' || sha1(payload) AS source_digest,
  'HTTP/1.1 200 OK' || {end} || 'Content-Type: text/html; charset=utf-8' || {end} || 'Content-Length: ' || strlen(payload) || {end} AS source_headers,
  len(regexp_extract_all(payload, {q(LINK)}))::BIGINT AS n_links,
  trim(regexp_replace({title}, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ') AS title FROM page),
derived AS (
  SELECT page_id, 'metadata' AS warc_type, 'metadata' AS own, 'conversion' AS other, refers_to, target_uri, source_headers, source_digest, n_links, 'application/warc-fields' AS content_type,
    'source-status: 200' || {end} || 'source-Content-Type: text/html; charset=utf-8' || {end} || 'source-Content-Length: ' || strlen(payload) || {end} || 'source-digest: ' || source_digest || {end} || 'title: ' || title || {end} || 'links: ' || n_links || {end} AS block FROM response
  UNION ALL
  SELECT page_id, 'conversion', 'conversion', 'metadata', refers_to, target_uri, source_headers, source_digest, n_links, 'text/plain; charset=utf-8', {text} FROM response)
SELECT page_id, warc_type, {uuid("sha256(own || '|' || refers_to)")} AS record_id, refers_to, {uuid("sha256(other || '|' || refers_to)")} AS concurrent_to, target_uri, {q(date)} AS warc_date,
  content_type, source_headers, source_digest, block, 'sha1:' || sha1(block) AS block_digest, strlen(block)::BIGINT AS content_length, n_links FROM derived
"""
