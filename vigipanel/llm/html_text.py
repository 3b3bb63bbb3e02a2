"""Operator 6: main text of web pages by tree scoring.

The page becomes a tree of elements.  Paragraphs pass points for their length and commas to
their parent and, halved and so on, to the elements above; an element's points are discounted
by the share of its text that stands in links.  The best container and those of its siblings
that score enough, or read like running text, are kept; what is a menu, notice, advert, form
or comment by its tag, role or name is left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigipanel.llm.common import map_batches

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"  # comment
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)",  # doctype, processing instruction, odd end tag
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
# Elements whose text is no part of an article.
DROPPED = frozenset(
    "head script style noscript template nav header footer aside form button select option textarea input fieldset "
    "iframe object embed applet canvas svg audio video map menu dialog title xmp noframes noembed".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math meter nobr output progress q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr br".split()
)
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
# An opening tag of the second group ends an open element of the first.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
    "menu nav ol p pre section table ul".split()
)
ENDED_BY = {
    "a": frozenset(["a"]),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]), "p": ENDS_P, "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]),
}
ENDS = {by: frozenset(tag for tag, all_by in ENDED_BY.items() if by in all_by) for by in frozenset().union(*ENDED_BY.values())}
# Where looking for an element to end stops.
SCOPES = frozenset("html body table td th ul ol dl div article section main aside nav header footer form blockquote".split())

# Whole name parts of class, id and role that mark what is not the article.
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense banner breadcrumb breadcrumbs byline-share comment comments "
    "commentlist commenting complementary contentinfo cookie cookies consent dialog disclaimer discussion disqus footer footnav gdpr header masthead "
    "menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promos promoted "
    "promotion recommend recommended related replies reply respond search share sharing sidebar sidebars signup site-header site-footer skip social "
    "sponsor sponsored sponsors subscribe subscription tabs tags teaser toolbar toc widget widgets".split()
)
ARTICLE = frozenset("article articlebody body content entry hentry main page post story text".split())
NOT_ARTICLES = frozenset("ad ads advert comment comments promo recommended related replies reply sponsored teaser".split())
NAME_PART = re.compile(r"[a-z0-9]+")
# Names that say what an element has or lacks, not what it is: has-sidebar, ad-free.
MODIFIER = re.compile(r"(?:has|have|with|without|no|hide|show)[-_].*|.*[-_](?:free|less|enabled|disabled|open|closed|visible|hidden)")

LEAST_POINTS, SIBLING_SHARE = 10.0, 0.2


class Element:
    __slots__ = ("tag", "attrs", "parent", "children", "points", "chars", "commas", "link_chars", "hidden", "holds_article", "prose")

    def __init__(self, tag: str, attrs: str, parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []
        self.points, self.chars, self.commas, self.link_chars = 0.0, 0, 0, 0
        self.hidden = self.holds_article = False
        self.prose = 0

    def names(self) -> set[str]:
        """Parts of class, id and role; a modifier has none."""
        out: set[str] = set()
        if self.attrs:
            for key, value in ATTRIBUTE.findall(self.attrs):
                if key.lower() in ("class", "id", "role"):
                    for word in value.strip("\"'").lower().split():
                        out.add(word)
                        if not MODIFIER.fullmatch(word):
                            out.update(NAME_PART.findall(word))
        return out

    def is_link(self) -> bool:
        """An anchor without an address is a place, not a link."""
        return any(key.lower() == "href" for key, _ in ATTRIBUTE.findall(self.attrs))

    def invisible(self) -> bool:
        if not self.attrs:
            return False
        found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(self.attrs)}
        style = found.get("style", "").replace(" ", "")
        return "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def parse(page: str) -> Element:
    """The element tree; end tags that are missing or astray are mended as browsers do, roughly.

    Tags are looked for among the open elements only if one of that name is open.
    """
    root = Element("#root", "", None)
    here, at, n = root, 0, len(page)
    opened: Counter[str] = Counter()

    def close(node: Element) -> Element:
        """Ends `node` and what is open inside it."""
        inner = here
        while inner is not node.parent:
            opened[inner.tag] -= 1
            inner = inner.parent
        return node.parent

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            here.children.append(page[at:])
            break
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if opened[name] > 0:
                node = here
                # An inline end tag does not reach beyond its block.
                while node.tag != name and not (name in INLINE and node.tag not in INLINE):
                    node = node.parent
                if node.tag == name:
                    here = close(node)
            continue
        if any(opened[tag] > 0 for tag in ENDS.get(name, ())):
            node, ends = here, ENDS[name]
            while node is not root and (node.tag in ends or node.tag not in SCOPES):
                if node.tag in ends:
                    here = close(node)
                node = node.parent
        element = Element(name, m["attrs"], here)
        here.children.append(element)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            element.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif name not in VOID:
            # A slash before the end closes nothing else: it ends an unquoted value, or is ignored.
            here = element
            opened[name] += 1
    return root


def _walk(root: Element) -> list[Element]:
    """Elements in page order, without those that are dropped as a whole."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Element) and not c.hidden)
    return out


def _unwanted(node: Element, prose: int, by_name: bool) -> bool:
    """By tag or attribute, or by a name where the element holds no article.

    What holds most of the page's `prose` is its layout, whatever it is called, unless it is
    called adverts, comments or the like.
    """
    if node.invisible():
        return True
    if node.tag in DROPPED:
        # A heading block inside an article is its own; other headers are the site's.
        return not (node.tag == "header" and _inside(node, ("article", "main")))
    if not by_name or not node.attrs or node.tag in ("html", "body"):
        return False
    if node.tag in INLINE and _inside(node, ("article",)):
        return False  # a word of the article, however it is marked
    names = node.names()
    bad = names & UNWANTED
    if node.tag in ("article", "main"):
        return bool(bad & NOT_ARTICLES)
    if bad == {"header"} and names & ARTICLE:
        return False
    if 2 * node.prose > prose and not bad & NOT_ARTICLES:
        return False
    return bool(bad) and not node.holds_article


def _inside(node: Element, tags: tuple[str, ...]) -> bool:
    while node.parent is not None:
        node = node.parent
        if node.tag in tags:
            return True
    return False


def _mark_and_measure(root: Element, by_name: bool = True) -> list[Element]:
    """Hides what is unwanted; the rest in page order, with the counts of their whole texts."""
    for node in reversed(_walk(root)):
        wanted = node.tag in ("article", "main") and not node.names() & NOT_ARTICLES
        if (wanted or node.holds_article) and node.parent is not None:
            node.parent.holds_article = True
        if node.tag not in DROPPED and node.tag != "a":
            node.prose = sum(len(c.strip()) if isinstance(c, str) else c.prose for c in node.children)
    todo = [root]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, Element):
                child.hidden = _unwanted(child, root.prose, by_name)
                if not child.hidden:
                    todo.append(child)
    nodes = _walk(root)
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(child.strip())
                node.commas += sum(map(child.count, ",،、，"))
            elif not child.hidden:
                node.chars += child.chars
                node.commas += child.commas
                node.link_chars += child.chars if child.tag == "a" and child.is_link() else child.link_chars
    return nodes


def _is_paragraph(node: Element) -> bool:
    """A paragraph element, or a block with text of its own and no blocks inside."""
    if node.tag in PARAGRAPHS:
        return True
    if node.tag in INLINE or node.tag in ("#root", "html", "body", "ul", "ol", "table", "tr") or not node.chars:
        return False
    return not any(isinstance(c, Element) and c.tag not in INLINE for c in node.children)


def _link_share(node: Element) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def best_container(nodes: list[Element]) -> Element | None:
    """The element with the most points after the discount for links."""
    scored: dict[int, Element] = {}
    for node in nodes:
        if not _is_paragraph(node) or not node.chars:
            continue
        points = 1 + node.commas + min(node.chars / 100, 3.0)
        up, level = node.parent, 0
        while up is not None and up.tag != "#root" and level < 4:
            if up.tag not in INLINE:
                up.points += points / (1, 2, 6, 9)[level]
                scored[id(up)] = up
                level += 1
            up = up.parent
    best, most = None, 0.0
    for node in scored.values():
        bonus = 25.0 if node.tag in ("article", "main") else 5.0 if node.names() & ARTICLE else 0.0
        value = (node.points + bonus) * (1 - _link_share(node))
        node.points = value
        if value > most:
            best, most = node, value
    return best


def _kept(best: Element) -> list[Element]:
    """The best container with the siblings that belong to it, in page order."""
    if best.parent is None or best.tag in ("body", "html", "article"):
        return [best]
    limit = max(LEAST_POINTS, SIBLING_SHARE * best.points)
    out = []
    for node in best.parent.children:
        if node is best:
            out.append(node)
        elif isinstance(node, Element) and not node.hidden and node.chars:
            share = _link_share(node)
            running = node.tag == "p" and (share < 0.25 and node.chars > 80 or share == 0)
            heading = node.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and share < 0.5
            if node.points >= limit and share < 0.5 or running or heading:
                out.append(node)
    return out


def _blocks(top: Element) -> Iterator[str]:
    """Texts between block borders, in page order."""
    parts: list[str] = []
    todo: list[Element | str | None] = [top]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            parts.append(item)
            continue
        if item is not None and item.hidden:
            # What is left out still parts the words around it.
            parts.append(" ")
            continue
        if item is not None and item.tag in INLINE:
            if item.tag == "br":
                parts.append(" ")
            todo.extend(reversed(item.children))
            continue
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts = []
        if text:
            yield text
        if item is not None:
            todo.append(None)
            todo.extend(reversed(item.children))
    text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
    if text:
        yield text


def main_text(page: str | None) -> str:
    """Blocks of the main text, one per line; empty if there is none."""
    if not page:
        return ""
    # Where the names leave nothing they are not heeded.
    return _text(page) or _text(page, by_name=False)


def _text(page: str, by_name: bool = True) -> str:
    root = parse(page)
    best = best_container(_mark_and_measure(root, by_name))
    if best is None:
        return "\n".join(_blocks(root))
    return "\n".join(text for node in _kept(_article_around(best) or best) for text in _blocks(node))


def _article_around(best: Element) -> Element | None:
    """The outermost article element around the best container: its parts belong together."""
    node, found = best, None
    while node is not None:
        if node.tag == "article":
            found = node
        node = node.parent
    return found


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column("html")]
        arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).

    A null or empty page gives an empty text.  Rows are independent: repeated rows, null ids
    and urls and empty tables pass through; other columns are ignored.  A page of any length is
    parsed whole; of containers with equal points the first wins.  Ids are whole numbers or text of them; the cast of
    another id fails.
    """
    source = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")
    )
    texts = map_batches(source, _extract, "page_id bigint, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
