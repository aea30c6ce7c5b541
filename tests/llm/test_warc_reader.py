"""Texts of pages that are not well formed, WARC files with broken records, and packing of rows with any column names."""

import pytest

from treequarry.llm import packing, warc


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>t</title><body><p>kept text</p></body></html>", "kept text"),
        ("<head><title>t</title><style>x</style></head><p>kept", "kept"),
        ("<table><tr><td>one</td><td>two</td></tr><tr><th>3</th></tr></table>", "one two\n3"),
        ('<p title="a > b">x</p>', "x"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ('<a href="x>kept</a> more', "kept more"),
        ("<p>a<noscript>b<p>c", "ab\nc"),
        ("a<!-- b --><script>'<p>'</script>c<!-- d", "ac"),
        ("x<script>never closed <p>y", "x"),
        ("", ""),
    ],
)
def test_plain_text(html, text):
    assert warc.plain_text(html) == text


def test_a_very_long_page():
    page = "<div class='a>b'>word <b>x</b></div>" * 100_000 + '<p a="' * 50
    assert warc.plain_text(page).count("\n") >= 99_999


def record(kind, block, version="1.1", name="Content-Length", length=None):
    return f"WARC/{version}\r\nWARC-Type: {kind}\r\n{name}: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_broken_records_cost_no_other(spark, tmp_path):
    good = [record("a", b"one"), record("b", b"two", version="0.18"), record("c", b"WARC/1.1\r\nin a block", name="content-length")]
    data = good[0] + b"\r\nstray\r\n" + good[1] + record("lost", b"", length="x") + good[2] + b"WARC/1.0\nWARC-Type: d\nContent-Length: 4\n\nfour\n\n" + record("long", b"cut", length=999)
    (tmp_path / "x.warc").write_bytes(data)
    rows = warc.read_warc(spark, str(tmp_path), "*.warc").orderBy("number").collect()
    assert [(r["headers"].get("WARC-Type"), r["block"]) for r in rows if warc.SKIPPED not in r["headers"]] == [("a", "one"), ("b", "two"), ("c", "WARC/1.1\r\nin a block"), ("d", "four")]
    assert sum(int(r["headers"][warc.SKIPPED]) for r in rows if warc.SKIPPED in r["headers"]) == len(b"stray\r\n") + len(record("lost", b"", length="x")) + len(record("long", b"cut", length=999))
    assert list(warc.records_in(b"")) == [] and list(warc.records_in(b"nothing")) == [({warc.SKIPPED: "7"}, "")]


def test_pack_with_any_names(spark):
    names = ["base", "salt", "n", "rank", "rank_in", "place", "row", "bin_id"]
    rows = [(i, 0, 100 + i, *range(i, i + len(names))) for i in range(30)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece long, piece_length long, " + ", ".join(f"{n} long" for n in names))
    out = packing.pack(pieces).collect()
    assert sorted((r["doc_id"], *(r[n] for n in names[:-1])) for r in out) == [(r[0], *r[3:-1]) for r in rows]
    plain = packing.pack(pieces.select("doc_id", "piece", "piece_length")).collect()
    key = lambda r: (r["doc_id"], r["bin_id"], r["bin_capacity"], r["bin_offset"])
    assert sorted(map(key, out)) == sorted(map(key, plain))
