"""Main text of pages: site templates, found by hashing element subtrees per host, and page furniture go (operator 10).

A page is parsed into a tree. Each box outside of its main content is hashed twice: by its slot (the elements, classes
and ids down to it, its shape, and whether it is mostly links) and by its content. Spark counts per host on how many
pages with different main content each occurs. A content that recurs is a template. So is a slot that is on many pages
and whose contents recur among them, such as adverts or menus that take turns; a slot with other words on every page,
such as a summary, is none. In the main content only boxes without running prose are hashed, and must recur in
surroundings that differ; so copies and near copies of an article never delete it.

Where a host has slots that are templates, and a page has one of its boxes, templates alone decide on the page: the text is
what is left of the whole page, whatever its elements are called. But for what no count over pages can tell: adverts,
notices and reader comments that name themselves so, and what is hidden. Elsewhere, which is on hosts of a few pages and on
pages of another make, menus of links, footers, adverts, forms and comments go by element, role, class or id. There, what holds
the article, or most of the text, stays whatever it is called. A column says which of the two decided.

The first pass sends one row per page and box, which Spark combines before the shuffle and counts by hash; no host is
gathered in a task. What a host's templates are is bounded by shares of its pages. Texts are not shuffled when the
templates are small.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treequarry.llm.common import checkpointed, small_batches
from treequarry.llm.urls import host_of

#: A content is a template on so many pages with different main content, in the main content itself on so many, and on
#: such a share of the host's pages; a slot on so many, on such a share, with contents at most such a share of its pages.
MIN_PAGES, MIN_INSIDE, SHARE = 3, 5, 0.01
SLOT_PAGES, SLOT_SHARE, SLOT_CONTENTS = 5, 0.1, 0.8
#: Template tables of at most so many hashes are broadcast (8 bytes each, and the host names).
BROADCAST_HASHES = 500_000

#: Fixed values of HTML: elements without content, elements whose content is not markup, elements that end a paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split())
ENDS_P = BLOCK - set("body head html legend option optgroup caption tbody tfoot thead tr".split())
#: A start tag ends an open element of these, if it is nearer than the elements that hold them.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}

#: What is never text; furniture by element, by role, and by the word that a class or id ends in.
UNSEEN = set("head title script style noscript template button select textarea input iframe object embed svg canvas math audio video noembed noframes xmp map".split())
GONE = set("nav footer aside form dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
WORDS = set(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer colophon sidebar aside rail ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored "
    "promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login signin social share sharing sharebar related recommended "
    "comment comments commentlist respond disqus discussion replies reply widget pagination pager toolbar copyright disclaimer skip hidden search form".split()
)
#: Words that are furniture even on a paragraph or an article.
STRONG = set("ad ads advert adverts advertisement sponsored cookie cookies consent gdpr comment comments commentlist disqus replies newsletter hidden".split())
#: Words after the one that tells; words before it that say something else: a state, or the head of an article.
GENERIC = set("area bar block body bottom box container content group inner item items left links list outer panel right section text top wrap wrapper".split())
STATES, OWN = set("has with without no not is".split()), set("article content entry post story".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | set("p blockquote pre li dt dd figcaption tr td th a b i em strong span code q cite sub sup small mark u abbr time".split())
MAIN = {"article", "main"}
LISTS = set("ul ol div table section p center".split())
#: Elements that hold inline ones together; blocks that a search for an open list item or cell passes.
SCOPES, PASSED = BLOCK | {"td", "th"}, {"div", "p", "address"}

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
NAME_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
DIGITS, SENTENCE = re.compile(r"[0-9]+"), re.compile(r"[.!?]\s")


class Node:
    __slots__ = ("children", "gone", "hash", "linked", "links", "named", "names", "parent", "shape", "sig", "size", "stop", "strong", "tag", "unseen", "within")

    def __init__(self, tag: str, parent: Node | None, names: str = "", named: bool = False, strong: bool = False):
        self.tag, self.parent, self.names, self.named, self.strong = tag, parent, names, named, strong
        self.unseen, self.gone = tag in UNSEEN, False
        self.children: list[Node | str] = []
        self.hash = self.shape = self.sig = self.size = self.linked = self.links = 0
        #: whether it stands in an article or main element; the nearest element, itself included, that ends a search for open ones
        self.within = parent is not None and (parent.within or parent.tag in MAIN)
        self.stop: Node = self if parent is None or (tag in BLOCK and tag not in PASSED) or tag in ("td", "th") else parent.stop


def tells(names: str) -> set[str]:
    """The words that classes and ids end in, without those that say nothing or speak of a state."""
    found = set()
    for name in names.split():
        words = [w.lower() for w in NAME_WORDS.findall(name)]
        while len(words) > 1 and words[-1] in GENERIC:
            words.pop()
        if words and words[0] not in STATES and not (words[-1] == "header" and words[0] in OWN):
            found.add(words[-1])
    return found


def furniture(tag: str, attributes: str, within: bool) -> tuple[str, bool, bool]:
    """Classes and id of an element, whether it says that it is not the article, and whether that is so on a site of any
    size: adverts, notices, reader comments and what is hidden. `within`: it stands in an article or main."""
    own = tag in GONE or (tag == "header" and not within)
    if not attributes.strip() or tag in ("html", "body"):
        return "", own, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = found.get("class", "") + " " + found.get("id", "")
    words = tells(names)
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return names, True, True
    strong = bool(words & STRONG)
    if own or found.get("role", "").lower() in ROLES:
        return names, True, strong
    if tag in HEADINGS or tag == "main":
        return names, False, False
    if tag in PROSE or tag == "article":
        return names, strong, strong
    return names, bool(words & WORDS - ({"header"} if within else set())), strong


def parse(source: str) -> Node:
    """The tree of a page, however broken; every open element ends with the page. Linear in the page."""
    root = node = Node("#", None)
    # open elements by tag; open blocks, each with the inline elements opened since
    opened: Counter[str] = Counter()
    scopes: list[tuple[Node, Counter[str]]] = [(root, Counter())]

    def close(upto: Node) -> None:
        nonlocal node
        while True:
            opened[node.tag] -= 1
            if node.tag in SCOPES:
                scopes.pop()
            else:
                scopes[-1][1][node.tag] -= 1
            done, node = node is upto, node.parent
            if done:
                return

    at, size = 0, len(source)
    while at < size:
        token = TOKEN.search(source, at)
        end = token.start() if token else size
        if end > at:
            node.children.append(source[at:end])
        if not token:
            break
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            if tag == "br":
                node.children.append(" ")
            elif (opened if tag in SCOPES else scopes[-1][1])[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                close(up)
            continue
        if tag in ENDS_P and scopes[-1][0].tag == "p":
            close(scopes[-1][0])
        if tag in IMPLIED:
            ends, holders = IMPLIED[tag]
            up, last = node.stop, None
            while up.parent and up.tag in ends and up.tag not in holders:
                last, up = up, up.parent.stop
            if last:
                close(last)
        if tag == "br" or tag == "wbr":
            if tag == "br":
                node.children.append(" ")
            continue
        child = Node(tag, node, *furniture(tag, token[3], node.within or node.tag in MAIN))
        node.children.append(child)
        if tag in VOID or token[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at).end()
            continue
        node = child
        opened[tag] += 1
        if tag in SCOPES:
            scopes.append((node, Counter()))
        else:
            scopes[-1][1][tag] += 1
    return root


def in_order(root: Node) -> list[Node]:
    """Nodes, each before its children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return order


def ancestors(node: Node) -> Iterator[Node]:
    """The node and all that hold it."""
    up: Node | None = node
    while up is not None:
        yield up
        up = up.parent


def keep_content(order: list[Node]) -> None:
    """Take back what elements say of themselves where they hold the article, or without one most of the text."""
    total: dict[int, int] = {}
    under: set[int] = set()
    for node in reversed(order):
        total[id(node)] = 0 if node.unseen else sum(len(c) - c.count(" ") if isinstance(c, str) else total[id(c)] for c in node.children)
    for node in order:
        if node.parent and (node.parent.named or id(node.parent) in under):
            under.add(id(node))
    mains = [n for n in order if n.tag in MAIN and not n.named and total[id(n)]]
    if any(id(n) not in under for n in mains):
        return
    if mains:
        for node in ancestors(max(mains, key=lambda n: total[id(n)])):
            node.named = False
    else:
        for node in order:
            if 2 * total[id(node)] > total[id(order[0])] and node.tag not in ("nav", "footer", "menu"):
                node.named = False


def read(source: str | None) -> list[Node]:
    """Nodes of a page, each before its children, with what each keeps: text size, links, hashes of content, shape and slot.

    Furniture that names itself has these numbers too, but what holds it goes without it.
    """
    order = in_order(parse(source or ""))
    keep_content(order)
    digest = xxhash.xxh3_64_intdigest
    for node in reversed(order):
        if node.unseen:
            continue
        parts, shapes = [node.tag], [node.tag]
        for c in node.children:
            if isinstance(c, str):
                text = " ".join(entities.unescape(c).split())
                if text:
                    parts.append("t" + text)
                    node.size += len(text)
            elif not c.unseen and not c.named and c.size:
                parts.append(f"e{c.hash}")
                node.size += c.size
                node.linked += c.linked
                node.links += c.links
                if c.tag in BLOCK and shapes[-1] != (shape := str(c.shape)):
                    shapes.append(shape)
        if node.tag == "a":
            node.linked, node.links = node.size, 1
        node.hash = digest("\0".join(parts)) - (1 << 63)
        node.shape = digest("\0".join(shapes))
    for node in order[1:]:
        node.sig = 0 if node.tag in ("html", "body") else digest(f"{node.parent.sig} {node.tag} {DIGITS.sub('0', node.names)}")
    return order


def slot_of(node: Node) -> int:
    return xxhash.xxh3_64_intdigest(f"{node.sig} {node.shape} {2 * node.linked >= node.size}") - (1 << 63)


def kept(order: list[Node]) -> list[Node]:
    """Nodes that neither are gone, nor are unseen, nor name themselves furniture, nor stand in such."""
    alive, found = set(), []
    for node in order:
        if not (node.gone or node.unseen or node.named) and (node.parent is None or id(node.parent) in alive):
            alive.add(id(node))
            found.append(node)
    return found


def content_roots(order: list[Node]) -> list[Node]:
    """The articles, but for those that are little else than links; else the main element; else the page."""
    tops: list[Node] = []
    inner: set[int] = set()
    for node in kept(order):
        if node.parent and id(node.parent) in inner:
            inner.add(id(node))
        elif node.tag == "article":
            inner.add(id(node))
            if node.size:
                tops.append(node)
    told = [n for n in tops if 2 * n.linked < n.size] or tops
    if told and 5 * sum(n.size for n in told) >= order[0].size - order[0].linked:
        return told
    return [n for n in kept(order) if n.tag == "main" and n.size][:1] or [order[0]]


def core(roots: list[Node]) -> list[Node]:
    """Where the roots are the whole page: the smallest element that holds most of its text."""
    if roots[0].parent:
        return roots
    node, most = roots[0], roots[0].size / 2
    while found := [c for c in node.children if not isinstance(c, str) and not (c.unseen or c.named) and c.size > most]:
        node = found[0]
    return [node]


def candidates(order: list[Node]) -> Iterator[tuple[Node, bool]]:
    """Boxes that may be the site's, and whether they stand in the main content: there without prose, elsewhere not around it."""
    roots = core(content_roots(order))
    around, tops = set(), set(map(id, roots))
    for top in roots:
        for node in ancestors(top):
            if id(node) in around:
                break
            around.add(id(node))
    inside, dead = set(), set()
    for node in order:
        above = id(node.parent)
        if above in dead or node.unseen:
            dead.add(id(node))
            continue
        if above in inside or id(node) in tops:
            inside.add(id(node))
        if node.named:
            dead.add(id(node))  # what it holds goes with it
        if id(node) in around or not node.size or node.tag not in BLOCK or node.tag in ("html", "body") or (not node.named and 2 * node.size > order[0].size):
            continue
        if id(node) not in inside:
            yield node, False
        elif node.tag not in PROSE and node.tag not in MAIN:
            yield node, True


def signature(order: list[Node]) -> int:
    """A number of the main content that near copies mostly share: the least hash of its sentences."""
    text = " ".join(p for r in core(content_roots(order)) for p in pieces(r, False))
    parts = [p for p in SENTENCE.split(text) if len(p) >= 20] or [text]
    return min(map(xxhash.xxh3_64_intdigest, parts)) - (1 << 63)


def pieces(top: Node, whole_page: bool) -> list[str]:
    """Blocks of text of what is kept below a root."""
    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(words)).split())
        if text:
            blocks.append(text)
        words.clear()

    todo: list[Node | str | None] = [top]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            words.append(item)
        elif item.gone or item.unseen or item.named or (whole_page and item.tag in LISTS and item.links >= 3 and 10 * item.linked >= 8 * item.size):
            continue
        elif item.tag == "header" and item.within and item is not top:
            flush()
            todo += [x for h in reversed(item.children) if not isinstance(h, str) and h.tag in HEADINGS | {"hgroup", "div"} for x in (None, h)]
        else:
            block = item.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            elif item.tag in ("td", "th"):
                todo.append(" ")
            todo += reversed(item.children)
    flush()
    return blocks


def boxes(source: str | None) -> tuple[int, list[tuple[int, int, bool]]]:
    """The signature of a page's main content; slot, content and place of each box that may be the site's, each once."""
    order = read(source)
    return signature(order), sorted({(slot_of(n), n.hash, inside) for n, inside in candidates(order)})


def decided_text(source: str | None, templates: set[int], slots: set[int] | None = None, inside: set[int] | None = None, names: bool = True) -> tuple[str, bool]:
    """Blocks of the article in page order, joined by an empty line, and whether the site's templates alone decided.

    templates, slots and inside are contents and slots of boxes that go, and contents that go in the main content too.
    Without `names` only templates go, from the whole page, and nothing by what it is called.
    """
    order = read(source)
    roots = content_roots(order)
    site = False
    if templates or slots or inside:
        for node, within in list(candidates(order)):
            of_slot = not within and bool(slots) and slot_of(node) in slots
            node.gone = node.hash in (inside or ()) if within else of_slot or node.hash in templates
            site = site or of_slot
    if site or not names:
        roots = order[:1]
        for node in order:
            node.named = names and node.named and node.strong
    return "\n\n".join(b for r in roots for b in pieces(r, not site and names and r.tag not in MAIN)), site


def main_text(source: str | None, templates: set[int], slots: set[int] | None = None, inside: set[int] | None = None, names: bool = True) -> str:
    """The text alone."""
    return decided_text(source, templates, slots, inside, names)[0]


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, contents, slots, inside): the hashes that are templates, for hosts that have some.

    A box is on one page at least, so a host has no more contents than boxes on a page divided by `share`.
    """

    @F.pandas_udf("struct<main:bigint,boxes:array<struct<slot:bigint,hash:bigint,inside:boolean>>>")
    def hashes(texts: pd.Series) -> pd.DataFrame:
        found = [boxes(t) for t in texts]
        return pd.DataFrame({"main": [m for m, _ in found], "boxes": [[{"slot": s, "hash": h, "inside": i} for s, h, i in b] for _, b in found]})

    host = host_of(F.col("url"))
    rows = pages.select(host.alias("host"), hashes("html").alias("p")).select("host", "p.main", F.inline("p.boxes"))
    sizes = pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    # rows are combined by main content first, so that a hot box is spread over its pages' contents
    times = rows.groupBy("host", "slot", "hash", "inside", "main").agg(F.count("*").alias("n")).groupBy("host", "slot", "hash", "inside").agg(F.count("*").alias("mains"), F.sum("n").alias("n"))
    times = checkpointed(times.join(sizes, "host"))
    least = lambda n, part: F.greatest(F.lit(n), part * F.col("pages"))
    content = F.when(F.col("inside"), (F.col("mains") >= least(MIN_INSIDE, share)) & (2 * F.col("mains") >= F.col("n"))).otherwise(F.col("mains") >= least(min_pages, share))
    by_content = times.filter(content).select("host", F.when(F.col("inside"), "inside").otherwise("contents").alias("kind"), "hash")
    slots = times.filter(~F.col("inside")).groupBy("host", "slot", "pages").agg(F.sum("mains").alias("mains"), F.count("*").alias("contents"))
    by_slot = slots.filter((F.col("mains") >= least(SLOT_PAGES, SLOT_SHARE)) & (F.col("contents") <= SLOT_CONTENTS * F.col("mains"))).select("host", F.lit("slots").alias("kind"), F.col("slot").alias("hash"))
    listed = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("hash"))).alias(kind)
    return by_content.unionByName(by_slot).groupBy("host").agg(listed("contents"), listed("slots"), listed("inside"))


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, names: bool = True) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars, by_site (whether the host's templates alone decided).

    A null or empty html gives an empty text. A null url counts as the empty host. Repeated rows each get their row,
    and count as pages of their host, but not as different main content. A page of any length or depth is read whole, in
    time linear in it, by one worker. An empty table gives an empty result; other columns play no part. Without `names`
    the text is that of the whole page without templates: what the hashes alone find.
    """
    small_batches(pages.sparkSession)
    hashes = ("contents", "slots", "inside")

    @F.pandas_udf("struct<text:string,by_site:boolean>")
    def extract(hosts: pd.Series, texts: pd.Series, contents: pd.Series, slots: pd.Series, inside: pd.Series) -> pd.DataFrame:
        known: dict[str, list[set[int]]] = {}  # sets of a host are made once a batch
        out = []
        for host, text, *found in zip(hosts, texts, contents, slots, inside, strict=True):
            if host not in known:
                known[host] = [set(x) if x is not None else set() for x in found]
            out.append(decided_text(text, *known[host], names=names))
        return pd.DataFrame(out, columns=["text", "by_site"]).astype({"text": object, "by_site": bool})

    found = checkpointed(site_templates(pages, min_pages, share))
    total = found.agg(F.coalesce(F.sum(sum((F.size(c) for c in hashes), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = keyed.join(F.broadcast(found) if total <= BROADCAST_HASHES else found, "host", "left")
    out = joined.select("page_id", "url", extract("host", "html", *hashes).alias("e"))
    return out.select("page_id", "url", "e.text", F.length("e.text").cast("long").alias("n_chars"), "e.by_site")
