"""Operators 1, 9 and 10 on small fixtures."""

import gzip
import hashlib
import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from treequarry.llm import html_text, urls, warc

PAGES = "page_id long, url string, html string, host string, hash string"


def page(body, i=0, url="http://a.example.org/x"):
    return (i, url, body, "clash", "clash")


ARTICLE = "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>A&amp;B</h1><p><b>One\n two<br>three<p>Four &lt;five&gt;&nbsp;six</p></article><footer>&copy; me</footer></body></html>"


@pytest.mark.parametrize(
    "html, text",
    [
        (ARTICLE, "A&B\n\nOne two three\n\nFour <five> six"),
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\n\nd"),
        ("<body><header><h1>Site</h1></header><main><header><h1>Title</h1><span>by me</span></header><p>Text</p></main><aside>x</aside></body>", "Title\n\nText"),
        ("<article><p>Text</p><form>f<input></form><div class='cookie-notice'>c</div><script>var a='<p>'</script><style>p{}</style><section id=comments><article>no</article></section></article>", "Text"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one\n\ntwo\n\na b"),
        ("<article><p>unclosed <i>text", "unclosed text"),
        ("<article>x<!-- <p>no</p> -->y &#233;&#x41;", "xy éA"),
        ("<article><p>cut <a href='", "cut"),
        ("<ul><li><a>one</a><li><a>two</a><li><a>three</a></ul><p>Prose with <a>link</a> in it.</p>", "Prose with link in it."),
        ("<article class='post ad-free'><h2 class=header>H</h2><p>x</p></article>", "H\n\nx"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html, set()) == text


@pytest.mark.parametrize(
    "html",
    [
        "<div id=page class=header-fixed><article>{}</article></div>",
        "<div class='layout has-sidebar'>{}</div>",
        "<div class=sidebar><p>x</p>{}</div>",
        "<body><form id=aspnetForm><article>{}</article><div class=comments><article>a reader</article></div></form>",
        "<article><div class=related-work>{}</div></article>",
        "<article><div class=notice-board>{}</div><div class=search-results><p>kept</p></div></article>",
        "<header><article>{}</article></header>",
        "<article>{}</article><article class=teaser><a href=x>more of this kind of thing, and more</a></article>",
        "<article>{}</article><section id=comments><p>" + "a long remark of a reader " * 40 + "</p></section>",
    ],
)
def test_what_holds_the_text_stays(html):
    prose = "<p>" + "Words of the article that must not be lost. " * 5 + "</p>"
    text = html_text.main_text(html.format(prose), set())
    assert "Words of the article" in text and "a reader" not in text and "more of" not in text


def test_every_article_stays():
    assert html_text.main_text("<article><p>one story</article><article><p>a much longer second story here</article>", set()) == "one story\n\na much longer second story here"


def test_templates_go_and_copies_stay(spark):
    box = "<div class=x1>Join our list of readers today</div>"
    menus = [f"<div class=m>Today {w}</div>" for w in ("sun", "rain", "snow")]
    rows = [page(f"<body>{box}<div><p>Story number {i} with words of its own.</p><p>And another {i * 7} paragraph.</p></div><div class=z>All rights with the site</div></body>", i, "http://h.example.org/" + str(i)) for i in range(20)]
    rows += [page(f"<body><nav>m</nav><article><p>The same story on every page, word for word.</p><p>And its end.</p>{box}</article></body>", i, "http://c.example.org/" + str(i)) for i in range(100, 115)]
    rows += [page(f"<body>{box}<p>Few pages here, so nothing can be told.</p></body>", i, None) for i in range(200, 202)]
    # a slot whose contents take turns is a template, one with other words on every page is not
    rows += [page(f"<body>{menus[i % 3]}<div class=lead>In short, number {i} is about this</div><div class=b><p>Body {i} of the text, which goes on for a while.</p></div></body>", i, "http://s.example.org/" + str(i)) for i in range(400, 408)]
    # in the article a box goes that stands in articles that differ, but nothing that near copies share
    rows += [page(f"<body><article><p>Report {i} says something else each time.</p><section>Write to us for more</section></article></body>", i, "http://i.example.org/" + str(i)) for i in range(500, 508)]
    parts = "".join(f"<section><p>Part {k} of a story that has many copies.</p></section>" for k in range(12))
    rows += [page(f"<body><article>{parts}<section>Copy {i}</section></article></body>", i, "http://n.example.org/" + str(i)) for i in range(600, 630)]
    rows += [(300, "http://h.example.org/", None, None, None), (300, "http://h.example.org/", None, None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    out = defaultdict(list)
    for r in html_text.main_texts(pages).collect():
        out[r["page_id"]].append((r["text"], r["n_chars"]))
    assert sum(map(len, out.values())) == len(rows)
    assert all(out[i][0][0] == f"Story number {i} with words of its own.\n\nAnd another {i * 7} paragraph." for i in range(20))
    assert all(out[i][0][0].startswith("The same story on every page, word for word.\n\nAnd its end.") for i in range(100, 115))
    assert all(out[i][0][0] == f"In short, number {i} is about this\n\nBody {i} of the text, which goes on for a while." for i in range(400, 408))
    assert all(out[i][0][0] == f"Report {i} says something else each time." for i in range(500, 508))
    assert all(out[i][0][0].count("Part") == 12 for i in range(600, 630))
    assert out[200][0][0].startswith("Join our list") and out[300] == [("", 0)] * 2
    assert html_text.main_texts(pages.limit(0)).count() == 0
    bare = {r["page_id"]: r["text"] for r in html_text.main_texts(pages, names=False).collect()}
    assert bare[3] == out[3][0][0] and bare[401] == out[401][0][0] and bare[100].startswith("m\n\n")


def test_templates_are_counted_by_host(spark):
    """The hashes that Spark finds, against counts page by page."""
    path = "/root/testdata/sf0.01/pages.parquet"
    pages = spark.read.parquet(path)
    rows = pages.select("url", "html").collect()
    hosts = [re.sub(r"^.*?://|[/?#].*$", "", r["url"] or "", flags=re.S).lower() for r in rows]
    on, mains, times = Counter(hosts), defaultdict(set), Counter()
    for host, r in zip(hosts, rows, strict=True):
        main, found = html_text.boxes(r["html"])
        for box in found:
            mains[host, *box].add(main)
            times[host, *box] += 1
    want = defaultdict(set)
    for (host, slot, content, inside), seen in mains.items():
        if inside and len(seen) >= max(5, on[host] / 100) and 2 * len(seen) >= times[host, slot, content, inside]:
            want[host].add(("inside", content))
        elif not inside and len(seen) >= max(3, on[host] / 100):
            want[host].add(("contents", content))
    for host, slot in {k[:2] for k in mains if not k[3]}:
        sizes = [len(v) for k, v in mains.items() if k[:2] == (host, slot) and not k[3]]
        if sum(sizes) >= max(5, on[host] / 10) and len(sizes) <= 0.8 * sum(sizes):
            want[host].add(("slots", slot))
    got = {r["host"]: {(k, h) for k in ("contents", "slots", "inside") for h in r[k]} for r in html_text.site_templates(pages).collect()}
    assert got == want and any(k == "slots" for found in got.values() for k, _ in found)


def test_deep_and_long_pages():
    deep = "<div>" * 30_000 + "x" + "</div>" * 30_000
    assert html_text.main_text(deep, set()) == "x"
    assert html_text.main_text("<p>" + "word " * 200_000, set()) == ("word " * 200_000).strip()
    n = 20_000
    for hard in ("<div>" * n + "<a href=x>l</a>" + "</div>" * n, "</b></div></p>" * n, "<i>" * n + "<hr>" * n, "<div>" * n + "<li></li>" * n, "<i>" * n + "</b>" * n, "<b><div>" * n + "</b>" * n, "<article>x</article>" * n):
        began = time.perf_counter()
        html_text.main_text(hard, {1})
        assert time.perf_counter() - began < 20


def plain_verdicts(rows, rules, threshold=0.05, rounds=20):
    parsed = []
    for i, url, html in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1], m[2]) if m else ("", "")
        host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
        fits = [(len(h + p), h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        parsed.append((i, host, path, max(fits)[1:] if fits else None, html or ""))
    weight = defaultdict(float)
    for _, host, _, _, html in parsed:
        for dst in re.findall(r"""(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)""", html, re.I):
            if host and dst.lower() != host:
                weight[host, dst.lower()] += 1

    def spread(edges, seed):
        total, rank = defaultdict(float), {h: 0.15 * w for h, w in seed.items()}
        for (a, _), w in edges.items():
            total[a] += w
        start = dict(rank)
        for _ in range(rounds):
            new = defaultdict(float, start)
            for (a, b), w in edges.items():
                new[b] += 0.85 * rank.get(a, 0) * w / total[a]
            rank = new
        return rank

    by_host = defaultdict(list)
    for _, host, _, best, _ in parsed:
        if host:
            by_host[host].append(best[2] if best else "")
    seed = lambda v: {h: x.count(v) / len(x) for h, x in by_host.items() if v in x}
    trust, distrust = spread(weight, seed("allow")), spread({(b, a): w for (a, b), w in weight.items()}, seed("block"))
    return sorted((i, h, p, b[0] + b[1] if b else None, b[2] if b else "block" if distrust.get(h, 0) - trust.get(h, 0) > threshold else "allow") for i, h, p, b, _ in parsed)


def test_url_verdicts(spark):
    link = lambda *hosts: " ".join(f'<a HREF="http://{h}/x?y">t</a> <img src=//{h}>' for h in hosts)
    rows = [
        (1, "http://bad.NET/", link("other.example")),
        (2, "https://a.example.net/en/1", link("good.example", "good.example", "a.example.net")),
        (3, "https://EXAMPLE.net/de/", ""),
        (4, "http://example.com/de/x", None),
        (5, "http://notexample.com/de/x#top", link("farm.example")),
        (6, "http://farm.example/p?q=http://x.net/", link("bad.net", "bad.net")),
        (7, "http://good.example", link("fine.example")),
        (8, "http://fine.example/?a", link("farm.example")),
        (9, "no scheme", link("bad.net")),
        (10, None, None),
        (11, "x://y.org/fr/a", ""),
        (12, "http://bad.net", ""),
        (12, "http://bad.net", ""),
        (13, "http://ring1.example/", link("ring2.example")),
        (14, "http://ring2.example/", link("ring1.example", "bad.net")),
        (15, "http://lone.example/", link("spam.net")),
        (16, "http://spam.net/", ""),
    ]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    got = sorted(tuple(r) for r in urls.verdicts(pages).collect())
    assert got == plain_verdicts(rows, urls.RULES)
    verdict = {r[0]: r[4] for r in got}
    assert verdict[15] == "block" and verdict[7] == "allow" and verdict[9] == verdict[10] == "allow"
    assert urls.verdicts(pages.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [page(ARTICLE, 1), page(ARTICLE, 1), page(None, 2, None), page("", 3, ""), page("<title>x\n y</title><script>a", 4), page("line one\r\n\r\nline two <a href=x>y</a>", 5, "http://é.example/ü")]
    pages = spark.createDataFrame(rows, PAGES)
    records = warc.derivatives(warc.responses(pages))
    own = sorted((r["record_id"], r["block"]) for r in records.collect())
    assert len(own) == 2 * len(rows)
    warc.write_warc(records, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((r["headers"]["WARC-Record-ID"], r["block"]) for r in back) == own
    source = {r["record_id"]: r for r in warc.responses(pages).collect()}
    for r in records.collect():
        assert r["refers_to"] in source and r["source_digest"] == source[r["refers_to"]]["payload_digest"] and r["source_headers"] == source[r["refers_to"]]["http_headers"]
    text = {r["page_id"]: r["block"] for r in records.filter("warc_type = 'conversion'").collect()}
    assert text[1] == "Home\nA&B\nOne\ntwo\nthree\nFour <five> six\n© me" and text[2] == text[3] == "" and text[5] == "line one\nline two y"
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_responses_of_warc_files(spark, tmp_path):
    """A response record of a file, through the reader, gives the same derivatives as one made from a page."""
    head = "HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n"
    body = "<head><title>a &mdash; b</title></head><p>caf&eacute;\r\n\r\n<p>x"
    block = (head + "\r\n" + body).encode()
    record = lambda kind, block: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(record("warcinfo", b"n") + record("response", block) + record("request", b"GET")))
    responses = warc.responses_of(warc.read_warc(spark, str(tmp_path), "*.warc.gz"))
    row = responses.first()
    assert responses.count() == 1 and row["http_headers"] == head and row["payload"] == body
    out = {r["warc_type"]: r for r in warc.derivatives(responses).collect()}
    assert out["conversion"]["block"] == "café\nx" and out["conversion"]["refers_to"] == "<urn:uuid:1>"
    assert "source-status: 404" in out["metadata"]["block"] and "title: a — b\r\n" in out["metadata"]["block"]


class Boxes(HTMLParser):
    """Texts of the outermost divs below the body of well-formed pages, with their classes: no code of the operator."""

    def __init__(self, html: str):
        super().__init__()
        self.depth, self.found = 0, []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        if tag == "div":
            self.depth += 1
            if self.depth == 1:
                self.found.append([dict(attrs)["class"], ""])

    def handle_endtag(self, tag):
        self.depth -= tag == "div"

    def handle_data(self, data):
        if self.depth:
            self.found[-1][1] += data


def test_templates_decide_where_names_say_nothing(spark):
    word = lambda *key: "w" + hashlib.md5(repr(key).encode()).hexdigest()[:6]
    prose = lambda *key: " ".join(word(*key, i) for i in range(30)) + "."
    rows = []
    for p in range(30):
        menu, end = p % 7, p % 6
        rows.append((p, f"http://one.example/{p}", f"<html><body><div class=k1>{word('menu', menu)} {word(menu)}</div><div class=k2><p>{prose('a', p)}</p><p>{prose('b', p)}</p></div><div class=k3><div class=k4>{prose('end', end)}</div></div><div class=comments><p>{prose('said', p)}</p></div></body></html>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r for r in html_text.main_texts(pages).collect()}
    # an independent count: contents of a class that recur on the host's pages are the site's
    texts = {p: Boxes(html).found for p, _, html in rows}
    times = Counter((c, t) for boxes in texts.values() for c, t in boxes)
    for p, _, html in rows:
        own = [t for c, t in texts[p] if times[c, t] == 1 and c != "comments"]
        assert out[p]["by_site"]
        assert out[p]["text"].replace("\n\n", "") == "".join(own)
        assert out[p]["n_chars"] == len(out[p]["text"])
        by_names = html_text.main_text(html, set())
        assert by_names != out[p]["text"]
        assert by_names.startswith(texts[p][0][1])


def test_names_decide_on_hosts_of_a_few_pages(spark):
    html = "<body><nav>Menu</nav><article><p>A story {}.</p></article><footer>End</footer></body>"
    pages = spark.createDataFrame([(p, f"http://few.example/{p}", html.format(p)) for p in range(2)], "page_id long, url string, html string")
    assert {(r["text"], r["by_site"]) for r in html_text.main_texts(pages).collect()} == {("A story 0.", False), ("A story 1.", False)}
