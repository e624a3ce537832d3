"""Main text of web pages by tree scoring.

A page becomes a tree; scripts, menus, footers, forms, notices, adverts, comments and the like are taken out; a form or a
container with such a name stays if the page's prose is in it, as some pages are one form. Each
paragraph then passes points for its length and its commas to its ancestors, in full to the nearest, less to those
further up; a container's points are discounted by the share of its text that is in links. The best container is kept
(the article around it, if there is one) with those of its siblings that read like text. Every block of what is kept
is a line, in page order, with character references decoded and white space made single.

A null or empty page, and one without text, gives the empty text; a very long page is read whole, in time in proportion
to its length; of containers with equal points the first is kept; broken markup is read as browsers do where it
matters (unclosed paragraphs and items, stray end tags, cut-off pages); repeated rows each get their result; an empty
table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, raw, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

# Element names by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style noscript template iframe svg math object canvas textarea title xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head nav footer aside form button select option input label fieldset menu dialog search audio video map applet".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes: elements of these names, up to the nearest of the second group.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
SCOPE = frozenset("table td th caption button object body html".split())

# Words of class and id that mark what is not the article; the second group counts outside articles only.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu sidebar sidenav breadcrumb breadcrumbs pagination pager comment comments commentlist commentary disqus reply replies respond discussion notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending footer copyright widget toolbar skip hidden".split())
OUTER_NOISE = frozenset("header masthead topbar top bottom meta search alert message tags toc side rail extra legal".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words that say how a page is laid out or what it goes without: a name with one of them says nothing about its element.
LAYOUT = frozenset("no not non with without has have enabled disabled off on layout xs sm md lg xl visible page template".split())
#: Of the words of noise those of what readers write.
READERS = frozenset("comment comments commentlist commentary disqus reply replies respond discussion".split())
#: Elements that can hold a whole page whatever they are called.
CONTAINERS = frozenset("div section table tbody tr td center form".split())
LIKELY = frozenset("article body content entry main page post text blog story hentry".split())


class Node:
    __slots__ = ("children", "doubtful", "heads", "link", "name", "names", "paragraphs", "parent", "points", "prose", "size")

    def __init__(self, name: str, parent: Node | None, names: frozenset[str] = frozenset()):
        self.name, self.parent, self.names = name, parent, names
        self.children: list[Node | str] = []
        self.points = 0.0
        self.size = self.link = 0
        self.doubtful = self.heads = False  # left out unless it holds the page; holds a title, an article or the main part
        self.prose = self.paragraphs = 0  # characters outside links, and paragraphs with some


def _names(attributes: dict[str, str]) -> tuple[frozenset[str], frozenset[str]]:
    """Words of class and id, and those of them that can mark noise: a name such as no-sidebar or hidden-xs can't."""
    every, marks = set(), set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
        every |= words
        if not words & LAYOUT:
            marks |= words
    return frozenset(every), frozenset(marks)


KEPT, DOUBTFUL, NO_ARTICLE = range(3)


def _judged(name: str, a: dict[str, str], names: frozenset[str], marks: frozenset[str], in_article: bool, mild: bool) -> int:
    """Whether an element can be part of the article: KEPT, NO_ARTICLE, or DOUBTFUL for containers that look like none."""
    if name == "form":
        return DOUBTFUL
    if name in DROPPED:
        return NO_ARTICLE
    if name == "article" and in_article and marks & NOISE:
        return NO_ARTICLE  # an entry within the article, such as a reader's comment
    if name in ("html", "body", "article", "main"):
        return KEPT
    if name == "header" and not in_article:
        return NO_ARTICLE
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return NO_ARTICLE
    if mild and name in CONTAINERS:
        return KEPT
    doubt = NO_ARTICLE if name not in CONTAINERS or marks & READERS else DOUBTFUL
    if a.get("role") in ROLES or marks & NOISE:
        return doubt
    return doubt if not in_article and marks & OUTER_NOISE and not names & LIKELY else KEPT  # an entry's header is not the page's


def _without_doubtful(root: Node) -> Node:
    """Takes doubtful containers out, but for those that hold the page: two paragraphs or more and at least 80 % of the prose,
    or a title, an article or the main part with a paragraph and at least half of the prose."""
    in_link = 0
    for node, leaving in _walk(root):
        if not leaving:
            in_link += node.name == "a"
            node.prose = 0 if in_link else sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
            continue
        in_link -= node.name == "a"
        node.heads |= node.name in ("h1", "article", "main")
        node.paragraphs += node.name in ("p", "pre", "blockquote") and node.prose >= 80
        if node.parent is not None:
            node.parent.prose += node.prose
            node.parent.heads |= node.heads
            node.parent.paragraphs += node.paragraphs

    def holds_the_page(x: Node) -> bool:
        return x.paragraphs >= 2 and x.prose >= 0.8 * root.prose or x.heads and x.paragraphs >= 1 and x.prose >= 0.5 * root.prose

    for node, leaving in _walk(root):
        if not leaving and any(isinstance(c, Node) and c.doubtful for c in node.children):
            node.children = [c for c in node.children if isinstance(c, str) or not c.doubtful or holds_the_page(c)]
    return root


def after_raw_text(page: str, name: str, pos: int) -> int:
    """Where the page goes on behind an element whose content is no markup, such as a script; else ``pos``."""
    if name not in RAW_TEXT:
        return pos
    close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
    return close.end() if close else len(page)


def parse(page: str, keep_all: bool = False, mild: bool = False) -> Node:
    """The page as a tree without what can't be article text; with ``keep_all`` only scripts and the like go, with
    ``mild`` containers stay whatever they are called."""
    open_now: Counter = Counter()  # elements by name
    root = at = Node("#root", None)
    skip: Node | None = None  # the outermost element being left out
    inside = 0  # open articles
    pos = 0
    size = len(page)
    while pos < size:
        m = TOKEN.search(page, pos)
        end = m.start() if m else size
        if end > pos and skip is None:
            at.children.append(page[pos:end])
        if not m:
            break
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and skip is None:
                at.children.append(m[0][9:-3])
            continue
        if m[1] or m[4]:  # an end tag: closes the nearest open element of its name, if there is one
            if not open_now[name]:
                continue
            node: Node | None = at
            while node.name != name:
                node = node.parent
            while True:
                done, at = at, at.parent
                open_now[done.name] -= 1
                inside -= done.name == "article"
                if done is skip:
                    skip = None
                if done is node:
                    break
            continue
        if name in RAW_TEXT:
            pos = after_raw_text(page, name, pos)
            continue
        if name == "br":
            if skip is None:
                at.children.append(" ")
            continue
        closes, until = CLOSES.get(name, (frozenset(["p"]), SCOPE) if name in BLOCKS else (None, None))
        if closes and any(open_now[x] for x in closes):
            node, hit, left = at, None, sum(open_now[x] for x in closes)
            while left and node.name not in until:
                if node.name in closes:
                    hit, left = node, left - 1
                node = node.parent
            if hit is not None:
                while True:
                    done, at = at, at.parent
                    open_now[done.name] -= 1
                    inside -= done.name == "article"
                    if done is skip:
                        skip = None
                    if done is hit:
                        break
        if name in VOID:
            continue
        text = m[3] if m[2] else m[6]
        found = {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(text)} if text.strip(" /") else {}
        names, marks = _names(found) if found else (frozenset(), frozenset())
        node = Node(name, at, names)
        if skip is None:
            verdict = _judged(name, found, names, marks, inside > 0, mild) if not keep_all else NO_ARTICLE * (name == "head")
            if verdict == NO_ARTICLE:
                skip = node
            else:
                node.doubtful = verdict == DOUBTFUL
                at.children.append(node)
        if text.rstrip().endswith("/") and name not in BLOCKS:
            if skip is node:
                skip = None
            continue
        inside += name == "article"
        open_now[name] += 1
        at = node
    return root if keep_all else _without_doubtful(root)


def _clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Nodes on entering (False) and leaving (True), without recursion: pages can be nested deeply."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, leaving = stack.pop()
        yield node, leaving
        if not leaving:
            stack.append((node, True))
            stack += [(c, False) for c in reversed(node.children) if isinstance(c, Node)]


def _score(root: Node) -> list[Node]:
    """Gives every container its points; returns those that have any, in page order."""
    texts: dict[int, list[str]] = {}
    found: list[Node] = []
    in_link = 0
    for node, leaving in _walk(root):
        if not leaving:
            in_link += node.name == "a"
            own = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
            node.size += own
            node.link += own if in_link else 0
            continue
        in_link -= node.name == "a"
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.link += node.link
        if node.name in ("p", "pre", "td", "blockquote", "li", "dd", "div", "section"):
            text = _clean(" ".join(inline(node)))
            if text:
                points = min(len(text) / 100, 3) + text.count(",") + (1 if len(text) >= 25 else 0)
                points *= 1 - node.link / max(1, node.size)
                up, level = node.parent, 1
                while up is not None and level <= 5:
                    if up.parent is not None:
                        if not up.points:
                            found.append(up)
                            up.points = 0.01 + 2 * bool(up.names & LIKELY)
                        up.points += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
                    up, level = up.parent, level + 1
    return found


def inline(node: Node) -> Iterator[str]:
    """A node's own text: what stands in it but not in a block below it, so that no text counts twice."""
    stack: list[Node | str] = list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif x.name not in BLOCKS:
            stack += reversed(x.children)


def lines(nodes: list[Node]) -> list[str]:
    """Blocks of text below ``nodes`` in page order."""
    out: list[str] = []
    piece: list[str] = []

    def flush():
        if piece:
            if text := _clean("".join(piece)):
                out.append(text)
            piece.clear()

    for root in nodes:
        stack: list[Node | str | None] = [root]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                piece.append(x)
            elif x.name in BLOCKS:
                flush()
                stack.append(None)
                stack += reversed(x.children)
            else:
                stack += reversed(x.children)
        flush()
    return out


def _best(root: Node) -> list[Node]:
    """The best container with the siblings that are kept."""
    found = _score(root)
    if not found:
        return [root]
    worth = lambda n: n.points * (1 - n.link / max(1, n.size))
    top = max(found, key=worth)  # the first of equals
    main = None
    up: Node | None = top
    while up is not None:
        if up.name == "article" or up.name == "main" and (main is None or main.name != "article"):
            main = up
        up = up.parent
    if main is not None:
        top = main
    if top.parent is None or top.name in ("body", "html"):
        return [top]
    least = max(5.0, worth(top) * 0.2)
    kept: list[Node] = []
    for x in top.parent.children:
        if not isinstance(x, Node):
            continue
        titled = top not in kept and any(n.name in ("h1", "h2") for n, leaving in _walk(x) if not leaving)  # a title's wrapper
        density = x.link / max(1, x.size)
        similar = x.names and x.names == top.names
        if x is top or worth(x) + (worth(top) * 0.2 if similar else 0) >= least:
            kept.append(x)
        elif (titled or x.name in ("p", "pre", "blockquote", "ul", "ol", "table", *HEADINGS)) and density < 0.25 and x.size:
            kept.append(x)
    return kept


def main_text(page: str) -> str:
    """Containers that look like no part of an article stay where they hold the page. Where nothing is left all the same,
    containers are kept whatever they are called, if there is an article or a heading in them."""
    found = lines(_best(parse(page)))
    if not found and page.strip():
        again = parse(page, mild=True)
        if any(n.name in ("article", "main", "h1") for n, leaving in _walk(again) if not leaving):
            found = lines(_best(again))
    return "\n".join(found)


def all_text(page: str) -> str:
    """Every visible block of a page."""
    return "\n".join(lines([parse(page, keep_all=True)]))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py().decode("utf-8", "replace")) for x in batch["_html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select("page_id", "url", raw(F.col("html")).alias("_html"))
    kind = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return narrow.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def op9_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``; see the module's text for nulls and broken markup."""
    return extracted(table(spark, sf_dir, "pages"))
