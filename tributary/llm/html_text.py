"""HTML extraction: site template removal.

Every page is parsed once.  Its main part is cut into pieces of text, and every element
subtree in it that may be template is a hash over a run of pieces.  The hashes are
counted per host in Spark; subtrees that recur across many pages of a host are its
template and are deleted, together with what names itself as page furniture
(navigation, forms, adverts, ...).  What is left of the article is the main text.

Prose inside an article counts under more titles than one: only what stands in articles
of many different titles, on a good share of a host's pages, is template.  Copies of a
story share its title, so a copied story is none; nor is a passage quoted on some pages.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import slices, staged, tidy
from tributary.session import salted_join

#: A subtree is template if it is on so many pages of its host, and on this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.1

#: Subtrees on so many pages of a host are template whatever share of it they are; the share is for small hosts.
MANY_PAGES = 50

#: Prose inside an article is template if it stands under so many titles of its host, and under as many as this share of its pages.
MIN_TITLES, TITLE_SHARE = 20, 0.2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
FURNITURE = frozenset(
    "head title script style noscript template nav footer aside form button select input textarea iframe noembed noframes svg canvas object dialog"
    " menu search".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
FURNITURE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsored|promo|banner|cookies?|consent|notices?|menu|nav|navbar|navigation|sidebar|footer|masthead|"
    r"breadcrumbs?|comments?|replies|reply|responses?|reactions?|share|sharing|social|popup|modal|newsletter|subscribe|signup|related|pagination|pager|widget)(?=$|[\s_-])", re.I
)
#: What an opening tag closes, if it is open: an unclosed paragraph ends at the next block.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
#: Elements that no role, class, id or mark makes furniture.
ROOTS = frozenset("html body article main".split())
SCOPES = frozenset("ul ol dl table article main section div body html aside nav form td th".split())

TOKEN = re.compile(
    r"<!--(?:.*?)(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<rest>(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/)?(?P<tag2>[a-zA-Z][^\s/<>]*+)(?P<rest2>[^<>]*+)>", re.S
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    attributes: str
    parent: int
    children: list[int | str] = field(default_factory=list)


def parse(page: str) -> list[Node]:
    """The elements of a page in order of their start; a parent comes before its children."""
    nodes, open_nodes, names = [Node("", "", -1)], [0], Counter()
    at, size = 0, len(page)

    def close(k: int) -> None:
        names.subtract(nodes[i].tag for i in open_nodes[k:])
        del open_nodes[k:]

    while at < size:
        found = TOKEN.search(page, at)
        if not found:
            nodes[open_nodes[-1]].children.append(page[at:])
            break
        if found.start() > at:
            nodes[open_nodes[-1]].children.append(page[at : found.start()])
        at = found.end()
        tag = found["tag"] or found["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if found["end"] or found["end2"]:
            for k in range(len(open_nodes) - 1, 0, -1) if names[tag] else ():
                if nodes[open_nodes[k]].tag == tag:
                    close(k)
                    break
            continue
        rest = found["rest"] or found["rest2"] or ""
        ends = CLOSES.get(tag, ("p",) if tag in BLOCKS and tag != "br" else ())
        for k in range(len(open_nodes) - 1, 0, -1) if any(names[e] for e in ends) else ():
            name = nodes[open_nodes[k]].tag
            if name in ends:
                close(k)
                break
            if name in SCOPES:
                break
        nodes[open_nodes[-1]].children.append(len(nodes))
        nodes.append(Node(tag, rest.strip(), open_nodes[-1]))
        if tag in RAW:
            ended = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = ended.end() if ended else size
        elif tag not in VOID and not rest.endswith("/"):
            open_nodes.append(len(nodes) - 1)
            names[tag] += 1
    return nodes


def _is_furniture(node: Node, in_article: bool) -> bool:
    """Whether tag, role or a hidden mark make an element furniture."""
    if node.tag in FURNITURE or (node.tag == "header" and not in_article):
        return True
    if not node.attributes or node.tag in ROOTS:
        return False
    if re.search(r"(?:^|\s)(?:hidden|aria-hidden\s*=\s*[\"']?true)", node.attributes, re.I):
        return True
    return any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").lower() in FURNITURE_ROLES for m in NAMED.finditer(node.attributes))


def _is_named(node: Node) -> bool:
    """Whether a class or an id names an element as furniture."""
    if not node.attributes or node.tag in ROOTS:
        return False
    return any(m[1].lower() != "role" and FURNITURE_NAMES.search(m[2] or m[3] or m[4] or "") for m in NAMED.finditer(node.attributes))


def _is_main(node: Node) -> bool:
    return node.tag == "main" or "role" in node.attributes and bool(re.search(r"role\s*=\s*[\"']?main\b", node.attributes, re.I))


def _kept_names(nodes: list[Node], sure: list[bool], inside: list[bool]) -> list[bool]:
    """The elements that stay whatever their class or id says.

    They hold the page's largest article, its first main part if it has no article, or
    more than half of the text of the article, main part or page that they are in.
    An article inside another is no part of the other's text.
    """
    n = len(nodes)
    size, scope = [0] * n, [0] * n
    for i in range(1, n):
        up = nodes[i].parent
        scope[i] = up if nodes[up].tag == "article" or _is_main(nodes[up]) else scope[up]
    articles, mains = [], []
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        size[i] += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if i and not sure[i]:
            if node.tag == "article" and not inside[node.parent]:
                articles.append(i)
            elif _is_main(node):
                mains.append(i)
            if not (node.tag == "article" and inside[node.parent]):
                size[node.parent] += size[i]
    kept = [2 * size[i] > size[scope[i]] for i in range(n)]
    at = max(articles, key=lambda i: (size[i], -i)) if articles else min(mains, default=0)
    while at > 0:
        kept[at] = True
        at = nodes[at].parent
    return kept


def _own_articles(articles: list[int], size: list[int]) -> list[int]:
    """The largest article if it holds more than half of the articles' text, as a story beside teasers or replies does; else all."""
    most = max(articles, key=lambda i: size[i])
    return [most] if 2 * size[most] > sum(size[i] for i in articles) else articles


def _joined(pieces: list[str], marks: list[tuple[int, int, int]], template: frozenset[int]) -> str:
    """The pieces that no template covers, white space made one space.

    Prose stays if all that would go of it is more than half of the text: then the page
    is made of what recurs, and is no article with a template around it.
    """

    def covered(prose: int) -> list[bool]:
        edge = [0] * (len(pieces) + 1)
        for digest, first, last in marks:
            if digest in template and digest & 1 == prose:
                edge[first] += 1
                edge[last] -= 1
        return [n > 0 for n in accumulate(edge[:-1])]

    gone, prose = covered(0), covered(1)
    left = sum(len(p) for p, g in zip(pieces, gone, strict=True) if not g)
    lost = sum(len(p) for p, g, q in zip(pieces, gone, prose, strict=True) if q and not g)
    if 2 * lost <= left:
        gone = [g or q for g, q in zip(gone, prose, strict=True)]
    return " ".join("".join([" " if g else p for p, g in zip(pieces, gone, strict=True)]).split())


@dataclass
class Page:
    """A parsed page: which elements are furniture, which are the main part, and what may be template.

    ``candidate`` holds 0 where an element cannot be template, else its subtree's hash,
    which is odd for prose inside an article.
    """

    nodes: list[Node]
    gone: list[bool]
    candidate: list[int]
    roots: list[int]
    title: int

    @classmethod
    def of(cls, source: str) -> Page:
        nodes = parse(source)
        n = len(nodes)
        gone, inside, prose, sure = [False] * n, [False] * n, [False] * n, [False] * n
        articles, mains = [], []
        named = [False] * n
        for i in range(1, n):
            up = nodes[i].parent
            inside[i] = inside[up] or nodes[i].tag == "article"
            sure[i] = sure[up] or _is_furniture(nodes[i], inside[up])
            named[i] = not sure[i] and _is_named(nodes[i])
        if any(named):
            named = [name and not kept for name, kept in zip(named, _kept_names(nodes, sure, inside), strict=True)]
        for i in range(1, n):
            up = nodes[i].parent
            prose[i] = nodes[i].tag != "article" and (prose[up] or nodes[up].tag in PROSE)
            gone[i] = gone[up] or sure[i] or named[i]
        has_prose, digest, size, own = [False] * n, [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            node, parts = nodes[i], []
            for c in node.children:
                if isinstance(c, str):
                    text = c.strip()
                    if text:
                        size[i] += len(text)
                        own[i] += 0 if gone[i] else len(text)
                        parts.append(text)
                else:
                    has_prose[i] |= has_prose[c] or nodes[c].tag in PROSE
                    size[i] += size[c]
                    own[i] += 0 if nodes[c].tag == "article" else own[c]
                    parts.append(f"{digest[c]:x}")
            digest[i] = xxhash.xxh3_64_intdigest("\x00".join([node.tag, node.attributes, *parts])) - (1 << 63)
        article = [0] * n
        for i in range(1, n):
            up = nodes[i].parent
            article[i] = i if nodes[i].tag == "article" else article[up]
            if nodes[i].tag == "article" and inside[up]:
                # A smaller article inside an article is a reader's comment or a teaser.
                gone[i] = gone[i] or own[i] < own[article[up]]
            gone[i] = gone[i] or gone[up]
            if not gone[i]:
                if nodes[i].tag == "article" and not inside[up]:
                    articles.append(i)
                elif _is_main(nodes[i]):
                    mains.append(i)
        roots = (_own_articles(articles, own) if articles else []) or mains[:1] or [0]
        candidate = [0] * n
        for i, node in enumerate(nodes):
            if size[i] and node.tag not in INLINE and node.tag not in ("", "html", "body", "article", "main"):
                is_prose = inside[i] and (has_prose[i] or node.tag in PROSE or prose[i])
                candidate[i] = digest[i] | 1 if is_prose else digest[i] & ~1
        main, starts = [False] * n, set(roots)
        titles, first = [], 0
        for i, node in enumerate(nodes):
            main[i] = i in starts or (node.parent >= 0 and main[node.parent])
            if main[i] and size[i] and not gone[i] and node.tag in PROSE:
                first = first or digest[i]
                if node.tag in ("h1", "h2"):
                    titles.append((node.tag, i))
        title = digest[min(titles)[1]] if titles else first
        return cls(nodes, gone, candidate, roots, title)

    def parts(self) -> tuple[list[str], list[tuple[int, int, int]]]:
        """The main part's text in pieces, and ``(hash, first piece, piece after the last)`` of what may be template."""
        pieces: list[str] = []
        marks: list[tuple[int, int, int]] = []
        run: list[str] = []
        solid = 0

        def cut() -> None:
            nonlocal solid
            if run:
                pieces.append(re.sub(r"\s+", " ", "".join(run)))
                solid += pieces[-1] != " "
                run.clear()

        for root in self.roots:
            todo: list[int | str | tuple[int, int, int]] = [" ", root]
            while todo:
                item = todo.pop()
                if isinstance(item, str):
                    run.append(item)
                    continue
                if isinstance(item, tuple):
                    cut()
                    if solid > item[2]:
                        marks.append((item[0], item[1], len(pieces)))
                    continue
                if self.gone[item]:
                    run.append(" ")
                    continue
                if self.candidate[item]:
                    cut()
                    todo.append((self.candidate[item], len(pieces), solid))
                block = self.nodes[item].tag in BLOCKS
                todo += [" "] * block
                todo += [html.unescape(c) if isinstance(c, str) else c for c in reversed(self.nodes[item].children)]
                todo += [" "] * block
        cut()
        return pieces, marks

    def text(self, template: frozenset[int] = frozenset()) -> str:
        """The main part's blocks in page order; references decoded, white space made one space."""
        return _joined(*self.parts(), template)


def host_of(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return found[1].lower() if found else ""


PARSED = (
    "page_id long, url string, host string, key binary, title long, text string, pieces array<string>,"
    " marks array<struct<digest: long, first: int, last: int>>"
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages without marks get their text at once, others their pieces and marks."""
    marked = pa.list_(pa.struct([("digest", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.list_(pa.string()), marked]
    names = ["page_id", "url", "host", "key", "title", "text", "pieces", "marks"]
    for batch in batches:
        for part in slices(batch, "html"):
            rows = []
            for page_id, url, source in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                page = Page.of(source or "")
                pieces, marks = page.parts()
                if not marks:
                    rows.append((page_id, url, host_of(url), None, None, _joined(pieces, [], frozenset()), None, None))
                    continue
                key = hashlib.md5(repr((page_id, url, source)).encode("utf-8", "surrogatepass")).digest()
                spans = [dict(zip(("digest", "first", "last"), m, strict=True)) for m in marks]
                rows.append((page_id, url, host_of(url), key, page.title, None, pieces, spans))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = []
            for pieces, marks, template in zip(*(part.column(c).to_pylist() for c in ("pieces", "marks", "template")), strict=True):
                spans = [(m["digest"], m["first"], m["last"]) for m in marks] if template else []
                texts.append(_joined(pieces, spans, frozenset(template or ())))
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def parsed(pages: DataFrame) -> DataFrame:
    """Every page once, parsed: ``host``, ``title``, and its text or its ``pieces`` and ``marks``."""
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return source.mapInArrow(tidy(_parse), PARSED)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """The subtrees ``host, digest, pages`` of the main parts that recur across many pages of a host."""
    return _recurring(parsed(pages), min_pages, min_share)


def _recurring(pages: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """Templates of parsed pages; an odd digest is prose inside an article, which must stand under many titles."""
    each = pages.filter("key is not null").select("host", "title", F.explode(F.array_distinct("marks.digest")).alias("digest"))
    counts = (
        each.groupBy("host", "digest", "title").agg(F.count("*").alias("pages"))
        .groupBy("host", "digest").agg(F.sum("pages").alias("pages"), F.count("*").alias("titles"))
    )
    sizes = pages.groupBy("host").agg(F.count("*").alias("all_pages"))
    prose = F.col("digest").bitwiseAND(F.lit(1)) == 1
    common = F.when(prose, (F.col("titles") >= MIN_TITLES) & (F.col("titles") >= F.col("all_pages") * TITLE_SHARE)).otherwise(
        F.col("pages") >= F.least(F.col("all_pages") * min_share, F.lit(MANY_PAGES))
    )
    return counts.filter(F.col("pages") >= min_pages).join(sizes, "host").filter(common).select("host", "digest", "pages")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """The main text of every page: ``page_id, url, text, n_chars``.

    The main part is the outermost ``article`` elements, or the one of them that holds
    more than half of their text, else ``main``, else the whole page.  A null or empty
    page, and one without any text, gives an empty text; a null id or address stays
    null, and pages without a host count as one host.  Equal rows come back as often as
    they are there.  Other columns are ignored; an empty table gives no rows.  White
    space of any script becomes one space.
    """
    known = staged(parsed(pages), "pages").frame
    template = staged(_recurring(known, min_pages, min_share), "templates").frame
    waiting = known.filter("key is not null")
    each = waiting.select("key", "host", F.explode(F.array_distinct("marks.digest")).alias("digest"))
    # A template on many pages is a hot key; a page's own subtrees are all that one group holds.
    drops = salted_join(each, template, ["host", "digest"], spread=["key"]).groupBy("key").agg(F.collect_set("digest").alias("template"))
    # As a table its size is known before the join, so texts move only if many pages hold template.
    drops = staged(drops, "page-templates").frame
    late = waiting.select("page_id", "url", "key", "pieces", "marks").join(drops, "key", "left").select("page_id", "url", "pieces", "marks", "template")
    out = known.filter("key is null").select("page_id", "url", "text").unionByName(late.mapInArrow(tidy(_settle), "page_id long, url string, text string"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
