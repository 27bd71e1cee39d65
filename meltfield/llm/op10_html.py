"""Main text of web pages by tree scoring.

A forgiving tokenizer builds a tree of structural elements (inline markup is transparent, raw-text elements are
skipped whole, unclosed paragraphs and list items end where HTML ends them).  Every text block passes points for its
length and commas to its ancestors, less the further away; a container's score is discounted by its link
density, and by half if its class or id has a word of boilerplate.  The best container is kept with those siblings that
score well or read like prose.

Menus, side columns, dialogs and what is hidden go by element or role.  Page headers, forms and containers marked by a word
of class or id (sidebar, comments, advert ...) go too, unless one is a wrapper of the page: it holds the greater part of
the page's unlinked text, and either the headline or, on a page without one, nearly all of that text.  A class that speaks of the
layout (``no-sidebar``, ``has-comments``, ``menu-open``, ``hidden-xs``) marks nothing.  Link lists inside the kept
container go by their link density.

Defined results: a null or empty page, or one without text, has the empty string and 0 characters; broken markup never fails
(an unfinished tag or comment at the end is dropped; behind a quote that never ends in its tag, quotes no longer hide a
``>``); very long, deep or unclosed pages are processed whole, in time linear in their length; of containers with equal
scores the first is the best; repeated rows are extracted independently; extra columns are not read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltfield.llm._batches import map_text

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s(?:[^>"']|"[^"]*"|'[^']*')*|/)?)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
#: The same without quotes, for the rest of a page behind a quote that never ends.
_PLAIN_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?!))>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Fixed values of HTML: elements by how they are parsed.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea select title noembed noframes audio video".split())
STRUCTURAL = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot caption tr td th blockquote pre figure figcaption "
    "nav header footer aside form fieldset legend address details summary hgroup center menu dialog search label button".split()
)
ENDS_PARAGRAPH = STRUCTURAL - frozenset("html body label button".split()) | {"hr"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}

#: Elements and roles that never hold the article; elements and words of class or id that mark boilerplate, unless it is a wrapper of the page.
DROPPED = frozenset("nav footer aside button menu dialog search label head".split())
DROPPED_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar".split())
MARKED = frozenset("form fieldset".split())
MARKED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar toolbar comment comments commentlist disqus reply replies respond pagination pager widget widgets skip hidden paywall outbrain taboola".split()
)
#: Words that make a class speak of the layout: before others, behind others, anywhere; and "side" marks only alone or with one of these.
LAYOUT_FRONT = frozenset("no not without with has have is hidden".split())
LAYOUT_END = frozenset("open opened closed enabled disabled active inactive".split())
LAYOUT_ANYWHERE = frozenset("by layout".split())
SIDE = frozenset("bar bars nav menu column col rail box panel".split())
#: Share of the unlinked text that a wrapper without the headline holds at least.
WRAPPER_SHARE = 0.9
#: What is left of the score of a container with a word of boilerplate.
MARKED_SCORE = 0.5
#: Prior of a container by element.
PRIOR = {"article": 30.0, "main": 20.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0}
#: Table parts that an end tag from inside does not close, but for those of tables and of the article itself.
CELL_EDGE, CROSSES_CELLS = frozenset("td th table".split()), frozenset("table tr tbody thead tfoot article main".split())
LISTS = frozenset("ul ol dl div section table".split())
CELLS, CELL_SCORE = frozenset("td tr tbody".split()), 15.0
#: Containers above a block that get points of it.
LEVELS = 8
CONTAINERS = frozenset("html body main article section div td blockquote pre center figure table tbody tr".split())


#: What a node is: kept, marked by element or word, gone by element or role.
_KEPT, _MARKED, _GONE = 0, 1, 2


class _Node:
    __slots__ = ("tag", "parent", "state", "drop", "points", "chars", "linked", "links", "index", "container", "headline")

    def __init__(self, tag, parent, state, index):
        self.tag, self.parent, self.index = tag, parent, index
        #: ``state`` is the node's own, ``drop`` holds for what lies in it.
        self.state = state
        self.drop = state == _GONE or (parent is not None and parent.drop)
        self.points = self.chars = self.linked = self.links = 0
        self.headline = tag in ("h1", "main")
        self.container = self if tag in CONTAINERS else parent.container  # the nearest container, itself included


def marking(value: str) -> frozenset:
    """Words of boilerplate in a class or id, and "header"; a class that speaks of the layout has none."""
    out = set()
    for token in value.split():
        words = [w.lower() for w in _PART.findall(token)]
        if not words or (len(words) > 1 and (words[0] in LAYOUT_FRONT or words[-1] in LAYOUT_END)) or not LAYOUT_ANYWHERE.isdisjoint(words):
            continue
        out |= MARKED_WORDS.intersection(words)
        if "header" in words:
            out.add("header")
        if "side" in words and (len(words) == 1 or not SIDE.isdisjoint(words)):
            out.add("side")
    return frozenset(out)


def _state(tag: str, attributes: str, inside_article: bool) -> int:
    if tag in DROPPED:
        return _GONE
    state = _MARKED if tag in MARKED or (tag == "header" and not inside_article) else _KEPT
    if not attributes or tag in ("html", "body", "main", "article"):
        return state
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            found = marking(value)
            if found and (not inside_article or found != {"header"}):
                state = _MARKED
        elif name == "role":
            if value.strip().lower() in DROPPED_ROLES:
                return _GONE
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return _GONE
    return state


def blocks(page: str):
    """(nodes, blocks) of a page; a block is (node, text, characters in links, links), in page order, outside elements that are gone."""
    root = _Node("html", None, _KEPT, 0)
    nodes, found, stack = [root], [], [root]
    opened: dict[str, list[int]] = {}  # places in the stack of the open elements of each name
    cells: list[int] = []  # of the open table parts that end tags do not cross
    parts: list[str] = []
    linked = links = in_link = 0

    def end_block():
        nonlocal linked, links, in_link
        if parts:
            node = stack[-1]
            if not node.drop:
                text = " ".join("".join(parts).split())
                if text:
                    found.append((node, text, linked, links))
            parts.clear()
        linked = links = 0

    def last(*tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def pop_to(k):
        while len(stack) > k:
            tag = stack.pop().tag
            opened[tag].pop()
            if tag in CELL_EDGE:
                cells.pop()

    at, n, lowered, token, absent = 0, len(page), None, _TOKEN, set()
    while at < n:
        m = token.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                if not stack[-1].drop:
                    text = html.unescape(m[0])
                    parts.append(text)
                    if in_link:
                        linked += len(text.strip())
            continue
        if m[5] is not None:
            if page[at - 1] != ">":
                break  # an unfinished tag at the end of the page
            if '"' in m[6] or "'" in m[6]:
                token = _PLAIN_TOKEN
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                if lowered is None:
                    lowered = page.lower()
                    if len(lowered) != n:  # a few characters change length
                        lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in page)
                stop = -1 if tag in absent else lowered.find("</" + tag, at)
                if stop < 0:
                    absent.add(tag)
                    stop = n if tag in ("script", "style", "title", "textarea", "noscript") else at
                at = stop
            continue
        if tag == "a":
            in_link = not closing
            links += not closing
        elif tag in ("br", "hr", "img", "wbr", "input"):
            if tag == "hr":
                end_block()
            elif tag != "wbr":
                parts.append(" ")
        elif tag in ("html", "body", "head"):
            end_block()
        elif tag in STRUCTURAL:
            end_block()
            in_link = 0
            if closing:
                k = last(tag)
                if k and (tag in CROSSES_CELLS or not cells or cells[-1] <= k):
                    pop_to(k)
            else:
                if tag in ENDS_PARAGRAPH and stack[-1].tag == "p":
                    pop_to(len(stack) - 1)
                if tag in CLOSES and (k := last(*CLOSES[tag])) > last(*SCOPE[tag]):
                    while stack[k - 1].tag in CLOSES[tag]:
                        k -= 1
                    pop_to(k)
                if tag[0] == "h" and len(tag) == 2 and stack[-1].tag[0] == "h" and len(stack[-1].tag) == 2:
                    pop_to(len(stack) - 1)
                node = _Node(tag, stack[-1], _state(tag, attributes, bool(opened.get("article"))), len(nodes))
                nodes.append(node)
                opened.setdefault(tag, []).append(len(stack))
                if tag in CELL_EDGE:
                    cells.append(len(stack))
                stack.append(node)
    end_block()
    return nodes, found


def _drop_marked(nodes: list[_Node], found: list) -> None:
    """Sets ``drop`` of marked nodes that are no wrapper of the page, and of all that lies in them."""
    plain = [0] * len(nodes)
    for node, text, linked, _ in found:
        plain[node.index] += len(text) - min(linked, len(text))
    for node in reversed(nodes):  # children come after their parents
        if node.parent is not None and not node.drop:
            plain[node.parent.index] += plain[node.index]
            node.parent.headline |= node.headline
    total = plain[0]
    for node in nodes:
        if node.parent is not None and node.parent.drop:
            node.drop = True
        elif node.state == _MARKED:
            share = plain[node.index] / max(total, 1)
            node.drop = not (share > 0.5 and (node.headline or (share >= WRAPPER_SHARE and not nodes[0].headline)))


def points(text: str, linked: int) -> float:
    """What a block passes on: for being text, for commas, for length, discounted by its links."""
    n = len(text)
    if n < 25:
        return 0.2 * (1 - min(1.0, linked / n))
    return (1 + text.count(",") + min(n / 100, 3)) * (1 - min(1.0, linked / n))


def score(node: _Node) -> float:
    """A container's points and prior, discounted by its link density and by a word of boilerplate."""
    return (node.points + PRIOR.get(node.tag, 0.0)) * (1 - node.linked / max(node.chars, 1)) * (MARKED_SCORE if node.state == _MARKED else 1.0)


def main_text(page: str | None) -> str:
    """Blocks of the article, joined by an empty line."""
    if not page:
        return ""
    nodes, found = blocks(page)
    _drop_marked(nodes, found)
    found = [x for x in found if not x[0].drop]
    if not found:
        return ""
    for node, text, linked, links in found:
        node.chars += len(text)
        node.linked += min(linked, len(text))
        node.links += links
        p, share, k, up = points(text, linked), 1.0, 0, node.container
        while up is not None and k < LEVELS:
            up.points += p * share
            k += 1
            share = 0.5 if k == 1 else 1 / (3 * k)
            up = up.parent and up.parent.container
    for node in reversed(nodes):
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.linked += node.linked
            up.links += node.links

    best = max((x for x in nodes if x.tag in CONTAINERS and x.chars and not x.drop and (x.tag not in CELLS or score(x) >= CELL_SCORE)), key=lambda x: (score(x), -x.index))
    kept = {best}
    if best.parent is not None:
        level = max(10.0, 0.2 * best.points)
        for x in nodes:
            if x.parent is best.parent and x is not best and x.chars and not x.drop:
                density = x.linked / x.chars
                if (x.points >= level and density < 0.3) or (x.tag == "p" and (x.chars > 80 and density < 0.25)) or (x.tag == "article" and best.tag == "article"):
                    kept.add(x)
    kept_nodes = [False] * len(nodes)
    for i, x in enumerate(nodes):
        menu = x.tag in LISTS and x.links >= 3 and x.linked > 0.8 * x.chars
        kept_nodes[i] = x in kept or (x.parent is not None and kept_nodes[x.parent.index] and not menu)
    return "\n\n".join(text for node, text, _, _ in found if kept_nodes[node.index])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """``(page_id, url, text)`` of every page."""

    def run(piece: pa.RecordBatch) -> dict:
        texts = [main_text(x) for x in piece.column("html").to_pylist()]
        return {"page_id": piece.column("page_id"), "url": piece.column("url"), "text": pa.array(texts, pa.string())}

    chosen = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(markup).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    return map_text(chosen, "html", run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns."""
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
