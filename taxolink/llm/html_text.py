"""Main-text extraction from HTML by scoring the element tree.

A tolerant parser builds the tree (implied paragraph and list ends, void elements, raw-text elements).
Elements that never hold article text, and those whose class, id or role names a menu, notice, advert,
sidebar or comment area, are cut. A name cuts no inline element, no ``article`` (but a comment inside one) or
``main``, and nothing that holds more than half of the page's prose, unless another ``article``, ``main`` or element
named like them holds a fifth of it, or the name is that of a thread and the rest of the page has 80 characters of
prose. Where an ``article`` or ``main`` has text, nothing with an unwanted name outside it stays. On a page with less than 80
characters of prose every character outside links counts as prose. A form under the same conditions, or with an article in it, is a plain container. If fewer than 80
characters are left and none of them in an ``article`` or ``main``, the page is read again without the cuts by name, and
that text is taken if it is more than twice as long. Every paragraph-like block of enough text then passes points to its parent
(all of them) and its further ancestors (a shrinking part): one, plus its commas, plus one per 100
characters up to three. A container's points are discounted by its link density. The best container is kept,
with siblings that score well or read like prose, and the link-free lists, quotes, tables and short sections
among these. Beside an ``article`` or ``main`` only those with its tag and classes (ids differ) count. Containers of one tag and
class that share the points evenly (half of the best or more) are kept together, and so are headings directly before the
first kept element, unless it has an ``h1``. Of containers with equal points the first on the page is the best.

Output text: character references decoded, white space inside a block turned into one space, blocks
trimmed and joined in page order by one newline. ``<br>`` is white space. Nothing is capped.

Defined results: null, empty or text-free html gives an empty text; text outside any block is a block of
its own; when no block is long enough to score, the ``article`` or ``main`` element, or else the body,
is the container; repeated pages give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("script style noscript template head title nav footer aside form iframe object svg canvas button "
                 "select textarea input dialog menu audio video map".split())
#: Sections of a page that are cut whole; they are blocks like any other while the tree is built.
SECTIONS = frozenset("nav aside footer form dialog menu".split())
BLOCK = SECTIONS | frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 "
                             "h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead "
                             "tr ul".split())
CLOSES_P = BLOCK - {"html", "body", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
#: An opening tag ends these open elements, up to the nearest of the given borders.
ENDS = {"li": ({"li"}, {"ul", "ol"} | DROP), "dd": ({"dd", "dt"}, {"dl"} | DROP), "dt": ({"dd", "dt"}, {"dl"} | DROP),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
        "option": ({"option"}, {"select"})}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
PROSE = HEADINGS | {"p"}
#: Blocks of an article that are kept without points, if free of links, among the kept siblings.
SHORT = PROSE | frozenset("ul ol dl blockquote pre table figure details section div".split())
#: Elements that stand in a head; any other tag, and text, ends an open head.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
SCORED = frozenset(["p", "pre", "td", "blockquote", "li", "dd", "h2", "h3"])

#: Fixed word lists for class, id and role names. A name is split at hyphens, underscores and case changes; it is
#: unwanted if it has an unwanted word, unless it only says how a page is laid out ("with-sidebar", "comments-open").
UNWANTED = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert alertdialog announcement announcements banner breadcrumb "
    "breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disclaimer disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification notifications overlay pager "
    "pagination paywall popup promo promotion promoted recommendation recommendations recommended related replies respond "
    "responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser teasers toast "
    "toolbar topbar widget widgets".split())
#: With one of these words a name tells the subject of a section ("related-work", "social-history").
TOPIC = frozenset("work works research literature study studies method methods theory theories concept concepts history science "
                  "sciences algorithm algorithms analysis".split())
#: Names of readers' threads, which can be longer than the article above them.
THREAD = frozenset("comment comments commentlist disqus replies respond responses".split())
LAYOUT = frozenset("with has no without open closed enabled disabled not".split())
SITE_HEADERS = frozenset(["header", "site-header", "page-header", "siteheader", "pageheader", "top-header"])
WANTED = re.compile(r"(^|[\s_-])(article|content|entry|main|post|story|text|body)($|[\s_-])")
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")

MIN_CHARS = 25
#: An extracted text with fewer characters is little: the page is read again without the cuts by name.
MIN_ARTICLE = 80


class Node:
    __slots__ = ("tag", "names", "classes", "kids", "parent", "score", "hidden", "prose")

    def __init__(self, tag: str, names: list[str], parent: Node | None, hidden: bool = False,
                 classes: frozenset[str] = frozenset()):
        self.tag, self.names, self.parent, self.hidden, self.classes = tag, names, parent, hidden, classes
        self.kids: list[Node | str] = []
        self.score = 0.0
        self.prose = 0


class TreeBuilder(HTMLParser):
    """Build the tree of one page; unclosed and stray tags are taken as browsers do, roughly."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("html", [], None)

    def _end_head(self, whole: bool = False):
        """Leave an open head whose end tag is omitted; with ``whole`` also from inside its elements."""
        at = self.open
        while whole and at.parent is not None and at.tag != "head":
            at = at.parent
        if at.tag == "head":
            self.open = at.parent

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            self._end_head(whole=tag == "body")
            return
        if tag not in IN_HEAD:
            self._end_head()
        self._imply_ends(tag)
        given = dict(attrs)
        names = [n for k in ("class", "id", "role") for n in (given.get(k) or "").split()]
        style = (given.get("style") or "").replace(" ", "").lower()
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style
        node = Node(tag, names, self.open, hidden, frozenset((given.get("class") or "").split()))
        self.open.kids.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "use", "circle", "rect") and self.open.tag == tag:
            self.open = self.open.parent

    def _imply_ends(self, tag):
        if tag in CLOSES_P:
            self._close({"p"}, (BLOCK | DROP) - {"p"})
        if tag in HEADINGS and self.open.tag in HEADINGS:
            self.open = self.open.parent
        if tag in ENDS:
            ends, borders = ENDS[tag]
            while self._close(ends, borders):
                pass

    def _close(self, tags, borders) -> bool:
        at = self.open
        while at.parent is not None and at.tag not in borders or at.tag in tags:
            if at.tag in tags:
                self.open = at.parent
                return True
            at = at.parent
        return False

    def handle_endtag(self, tag):
        if tag in VOID or tag in ("html", "body"):
            return
        at = self.open
        while at.parent is not None and at.tag != tag:
            if tag not in BLOCK and tag not in DROP and at.tag in BLOCK:  # an inline end tag does not close blocks
                return
            at = at.parent
        if at.parent is not None:
            self.open = at.parent

    def handle_data(self, data):
        if data.strip():
            self._end_head()
        self.open.kids.append(data)


def _cut_by_tag(node: Node) -> bool:
    if node.hidden or node.tag in DROP and node.tag != "form":
        return True
    if node.tag == "header":  # a page's header goes; an article's own heading stays
        up = node.parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        return up is None
    return False


def _unwanted_words(node: Node) -> set[str]:
    """The unwanted words among an element's names; of a site header's names, ``header``."""
    found: set[str] = set()
    for name in node.names:
        words = {w.lower() for w in WORDS.findall(name)}
        if not words & (LAYOUT | TOPIC):
            found |= words & UNWANTED
        if name.lower() in SITE_HEADERS:
            found.add("header")
    return found


def _prune(node: Node) -> None:
    """Cut what goes by its tag or is hidden. Forms are left to :func:`_prune_named`."""
    stack = [node]
    while stack:
        at = stack.pop()
        at.kids = [k for k in at.kids if isinstance(k, str) or not _cut_by_tag(k)]
        stack.extend(k for k in at.kids if not isinstance(k, str))


def _measure(root: Node) -> None:
    """Give every element its prose: characters outside links, in blocks of at least :data:`MIN_CHARS`, in and below it."""
    nodes: list[Node] = []
    own: dict[int, list[int]] = {}
    stack: list[tuple[Node, Node, bool]] = [(root, root, False)]
    while stack:
        at, block, linked = stack.pop()
        nodes.append(at)
        at.prose = 0
        linked = linked or at.tag == "a"
        if at.tag in BLOCK:
            block = at
        chars = own.setdefault(id(block), [0, 0])
        for kid in at.kids:
            if isinstance(kid, str):
                n = len(SPACE.sub(" ", kid.strip()))
                chars[0] += n
                chars[1] += 0 if linked else n
            else:
                stack.append((kid, block, linked))
    for at in reversed(nodes):  # kids come after their parents in nodes
        every, free = own.get(id(at), (0, 0))
        at.prose += free if every >= MIN_CHARS else 0
        if at.parent is not None:
            at.parent.prose += at.prose
    if root.prose < MIN_ARTICLE:  # a page of little prose: every character outside links counts
        for at in reversed(nodes):
            at.prose = own.get(id(at), (0, 0))[1] + sum(k.prose for k in at.kids if not isinstance(k, str))


def _articles(root: Node) -> list[Node]:
    """The article and main elements with text that no element with an unwanted name holds."""
    found: list[Node] = []
    stack = [root]
    while stack:
        at = stack.pop()
        if at.tag in ("article", "main"):
            if _plain(at):
                found.append(at)
        elif at.names and _unwanted_words(at):
            continue
        stack.extend(k for k in at.kids if not isinstance(k, str))
    return found


def _prune_named(root: Node, names: bool = True) -> list[tuple[Node, list[Node | str]]]:
    """Cut forms and, with ``names``, elements with unwanted names; the changed elements with the kids they had.

    Stay: inline elements; main and article elements (but comments in an article); what holds more than half of the
    page's prose, unless the article is evidently elsewhere: where an article or main element has text, nothing with an
    unwanted name outside it stays. A form goes by its tag, under the same half.
    """
    _measure(root)
    articles = _articles(root)
    marked = [n for n in _walk(root) if n.prose and (n.tag in ("article", "main") or n.tag in BLOCK and any(
        map(WANTED.search, n.names)) and not _unwanted_words(n))]

    def above(node: Node, tags: tuple[str, ...]) -> bool:
        up = node.parent
        while up is not None and up.tag not in tags:
            up = up.parent
        return up is not None

    def beside(node: Node) -> int:
        """Most prose of one marked element that neither holds ``node`` nor lies in it."""
        near = set(map(id, _walk(node)))
        up = node.parent
        while up is not None:
            near.add(id(up))
            up = up.parent
        return max((n.prose for n in marked if id(n) not in near), default=0)

    inside = {id(n) for a in articles for n in _walk(a)}
    around: set[int] = set()
    for a in articles:
        up = a.parent
        while up is not None and id(up) not in around:
            around.add(id(up))
            up = up.parent

    def stays(node: Node, words: set[str]) -> bool:
        if articles and id(node) not in inside and id(node) not in around:
            return False
        if node.prose * 2 <= root.prose:
            return False
        if words & THREAD:  # a thread can be longer than its article
            return root.prose - node.prose < MIN_ARTICLE
        return beside(node) * 5 < root.prose

    cuts: list[tuple[Node, list[Node | str]]] = []
    stack = [root]
    while stack:
        at = stack.pop()
        kids: list[Node | str] = []
        for kid in at.kids:
            if not isinstance(kid, str):
                if kid.tag == "form" and not stays(kid, set()) and not any(
                        n.tag in ("article", "main") and n.prose for n in _walk(kid)):
                    continue
                words = _unwanted_words(kid) if names and kid.names else set()
                if words:
                    if kid.tag in ("article", "main"):
                        cut = kid.tag == "article" and bool(words & THREAD) and above(kid, ("article",))
                    elif kid.tag in INLINE and not any(n.tag in BLOCK for n in _walk(kid)):
                        cut = False
                    else:
                        cut = not stays(kid, words)
                    if cut:
                        continue
                stack.append(kid)
            kids.append(kid)
        if len(kids) < len(at.kids):
            cuts.append((at, at.kids))
            at.kids = kids
    return cuts


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        at = stack.pop()
        yield at
        stack.extend(k for k in reversed(at.kids) if not isinstance(k, str))


def _texts(node: Node) -> Iterator[tuple[str, bool]]:
    """Text pieces below a node, with whether each is inside a link."""
    stack: list[tuple[Node | str, bool]] = [(node, node.tag == "a")]
    while stack:
        at, linked = stack.pop()
        if isinstance(at, str):
            yield at, linked
        else:
            stack.extend((k, linked or not isinstance(k, str) and k.tag == "a") for k in reversed(at.kids))


def _plain(node: Node) -> str:
    return SPACE.sub(" ", "".join(t for t, _ in _texts(node))).strip()


def link_density(node: Node) -> float:
    all_chars = linked = 0
    for t, a in _texts(node):
        n = len(t) - sum(map(len, re.findall(r"\s{2,}", t)))
        all_chars += n
        linked += n * a
    return linked / all_chars if all_chars else 0.0


def _own_text(node: Node) -> str:
    """Text of a block without the blocks inside it."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(node.kids))
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            out.append(at)
        elif at.tag == "br":
            out.append(" ")
        elif at.tag not in BLOCK:
            stack.extend(reversed(at.kids))
    return SPACE.sub(" ", "".join(out)).strip()


def score_tree(root: Node) -> list[Node]:
    """Pass every paragraph's points to its ancestors; the scored containers, best first."""
    seen: dict[int, Node] = {}
    for node in _walk(root):
        if node.tag not in SCORED and node.tag not in ("div", "section"):
            continue
        text = _own_text(node)
        if len(text) < MIN_CHARS:
            continue
        points = (1.0 + text.count(",") + min(len(text) // 100, 3)) * (1.0 - link_density(node))
        at = node.parent if node.tag in SCORED else node
        level = 0
        while at is not None:
            if at.tag in BLOCK:
                at.score += points / (1 if level == 0 else 2 if level == 1 else level * 3)
                seen[id(at)] = at
                level += 1
            at = at.parent
    for node in seen.values():
        if node.tag in ("article", "main") or any(map(WANTED.search, node.names)):
            node.score += 25
        node.score *= 1.0 - link_density(node)
    return sorted(seen.values(), key=lambda n: -n.score)


def _chosen(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    ranked = score_tree(root)
    if not ranked:
        for node in _walk(root):
            if node.tag in ("article", "main"):
                return [node]
        return [root]
    best = ranked[0]
    # a paragraph's neighbours count with it, and an article inside the best container's ancestors stays whole
    up = best
    while up.parent is not None:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    marked = best.tag in ("article", "main")  # the page says what its article is: only its like belong to it
    peak = _peaks(root)
    floor = best.score * 0.2
    if not marked:
        best = _climb(best, peak)
    if best.parent is None:
        return [best]
    kids = [k for k in best.parent.kids if not isinstance(k, str)]

    if marked:
        return [k for k in kids if k is best or _like(k, best) and k.score >= floor]
    kept = [k is best or k.score >= floor or _like(k, best) and peak[id(k)] >= floor
            or k.tag in PROSE and _reads_like_prose(k) for k in kids]
    first = kept.index(True)
    last = len(kept) - 1 - kept[::-1].index(True)
    short = [k.tag in SHORT and _linkless(k) for k in kids]
    for i in range(first, last):
        kept[i] = kept[i] or short[i]
    # the closing sections of an article in sibling elements: the like of the best, if it has a class or a second one
    if best.classes or sum(k for kid, k in zip(kids, kept) if _like(kid, best)) > 1:
        for i in range(last + 1, len(kids)):
            if not short[i] or not _like(kids[i], best):
                break
            kept[i] = True
    return _headline(best.parent, kids, kept) + [kid for kid, k in zip(kids, kept) if k]


def _like(kid: Node, other: Node) -> bool:
    return kid.tag == other.tag and kid.classes == other.classes


def _peaks(root: Node) -> dict[int, float]:
    """Per element the best score in and below it."""
    peak: dict[int, float] = {}
    for node in reversed(list(_walk(root))):  # kids come after their parents
        peak[id(node)] = max([node.score, *(peak[id(k)] for k in node.kids if not isinstance(k, str))])
    return peak


def _climb(best: Node, peak: dict[int, float]) -> Node:
    """The container whose like share the points evenly: paragraphs in wrappers of their own count as one article."""
    top, at = best, best
    while at.parent is not None:
        if any(not isinstance(k, str) and k is not at and _like(k, at) and peak[id(k)] * 2 >= best.score
               and link_density(k) < 0.25 for k in at.parent.kids):
            top = at
        at = at.parent
    return top


def _headline(parent: Node, kids: list[Node], kept: list[bool]) -> list[Node]:
    """Headings directly before the first kept element, or before the element that it begins."""
    first = kept.index(True)
    if any(n.tag == "h1" for kid, k in zip(kids, kept) if k for n in _walk(kid)):
        return []
    out: list[Node] = []
    before: list[Node | str] = parent.kids[:next(i for i, k in enumerate(parent.kids) if k is kids[first])]
    while True:
        while before:
            at = before.pop()
            if not (at.strip() if isinstance(at, str) else _plain(at)):
                continue
            if isinstance(at, str) or at.tag not in HEADINGS or not _linkless(at):
                return out[::-1]
            out.append(at)
        if out or parent.parent is None:
            return out[::-1]
        before = parent.parent.kids[:next(i for i, k in enumerate(parent.parent.kids) if k is parent)]
        parent = parent.parent


def _linkless(node: Node) -> bool:
    return bool(_plain(node)) and link_density(node) == 0


def _reads_like_prose(node: Node) -> bool:
    text, density = _plain(node), link_density(node)
    return len(text) > 80 and density < 0.25 or bool(text) and density == 0 and text[-1] in ".!?"


def _blocks(node: Node) -> Iterator[str]:
    """Trimmed block texts in page order: text between block borders is one block."""
    part: list[str] = []
    stack: list[Node | str | None] = [None, *reversed(node.kids)]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            part.append(at)
        elif at is not None and at.tag == "br":
            part.append(" ")
        elif at is None or at.tag in BLOCK:
            text = SPACE.sub(" ", "".join(part)).strip()
            if text:
                yield text
            part = []
            if at is not None:
                stack.append(None)
                stack.extend(reversed(at.kids))
        else:
            stack.extend(reversed(at.kids))


def _chosen_text(root: Node) -> str:
    return "\n".join(b for node in _chosen(root) for b in _blocks(node))


def extract_text(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    root = builder.root
    _prune(root)
    cuts = _prune_named(root)
    text = _chosen_text(root)
    if cuts and len(text) < MIN_ARTICLE and not (text and _articles(root)):
        for node, kids in cuts:
            node.kids = kids
        _prune_named(root, names=False)
        for node in _walk(root):
            node.score = 0.0
        whole = _chosen_text(root)
        if len(whole) > 2 * len(text):
            return whole
    return text


def extract_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) to pages; one pass, no shuffle, page by page.

    The html column is dropped. Input columns named like the added ones are replaced.
    """
    others = [f for f in pages.schema.fields if f.name not in (column, "text", "n_chars")]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one page at a time as a Python string: the batch itself stays in Arrow buffers
            texts = [extract_text(h.as_py()) for h in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*names, "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "text string", "n_chars long"])
    return pages.select(*names, pages[column].cast("string")).mapInArrow(run, schema)
