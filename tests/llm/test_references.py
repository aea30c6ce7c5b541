"""Character references in conversions against the library's."""

import html

from treequarry.llm import warc


def test_all_references_are_decoded(spark):
    text = "caf&eacute; &#8217;x&#x2014;y&mdash; &hellip; &rsquo; &#233; &amp;lt; &copy; &NotEqualTilde; R&D"
    page = (1, "http://a/", f"<html><head><title>x</title></head><body><p>{text}</p></body></html>")
    out = {r["warc_type"]: r["block"] for r in warc.derivatives(warc.responses(spark.createDataFrame([page], "page_id long, url string, html string"))).collect()}
    assert out["conversion"] == html.unescape(text)
