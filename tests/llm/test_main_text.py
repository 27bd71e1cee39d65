"""Main text of pages: a plain version of the scoring on well-formed pages, wrappers named like boilerplate, and time."""

import random
import time
import xml.etree.ElementTree as ET

import pytest

from meltfield.llm import op10_html as op

PROSE = "This is a sentence of an article, with a few commas, and it goes on for a while. "
ARTICLE = "<h1>Headline</h1>" + "".join(f"<p>{PROSE * 2}Number {i}.</p>" for i in range(4))
PLAIN = "\n\n".join(["Headline", *(f"{PROSE * 2}Number {i}." for i in range(4))])
WRAPPERS = "no-sidebar with-sidebar has-comments side-by-side menu-open hidden-xs share-enabled related-content".split()


@pytest.mark.parametrize("name", WRAPPERS)
def test_a_wrapper_keeps_the_article(name):
    assert op.main_text(f'<body><nav><a href="/">Menu</a></nav><div class="{name}">{ARTICLE}</div><div class="ad">Buy this now</div></body>') == PLAIN
    assert op.main_text(f'<body class="x"><div id="{name}">{ARTICLE.replace("h1", "p")}</div></body>') == PLAIN
    assert op.main_text(f'<form class="{name}"><header class="site"><a href="/">Home</a></header><article class="{name}">{ARTICLE}</article></form>') == PLAIN


@pytest.mark.parametrize("box", ['class="sidebar"', 'class="post-comments"', 'id="comments"', 'class="cookieNotice"', 'role="dialog"', "hidden", 'style="display: none"', 'class="side-bar"', 'class="ad"'])
def test_a_box_beside_the_article_goes(box):
    for more in (1, 40):  # even if it is longer than the article
        assert op.main_text(f"<body><div>{ARTICLE}</div><div {box}>{'<p>Some other text, which is long, and longer still.</p>' * more}</div></body>") == PLAIN
        assert op.main_text(f"<body><div class='has-sidebar'><div>{ARTICLE}</div><div {box}>{'<p>Some other text, which is long, and longer still.</p>' * more}</div></div></body>") == PLAIN


def test_the_first_of_two_equal_containers_is_best():
    a, b = (f"<div><blockquote><p>{x * 130}</p></blockquote></div>" for x in "ab")
    assert op.main_text(f"<section>{a}</section><section>{b}</section>").startswith("a" * 130)


@pytest.mark.parametrize("unit", ["<div>x</section>", "<ul><li>some text", "<svg>x", '<a "> "', "<div>x<li>y", "<table><tr><td>x</div>", "<p>x<table>", "<div class='menu'>x", "<dl><dd>x<dt>", "<b>x<a href=y>"])
def test_time_is_linear(unit):
    def seconds(n):
        start = time.process_time()
        op.main_text("<section><div>" + unit * n)
        return time.process_time() - start

    seconds(1000)
    assert seconds(100_000) < 40 * max(seconds(10_000), 0.02)


def plain_main_text(page: str) -> str:
    """The scoring by its definition, over a parsed tree."""
    body = ET.fromstring(page)
    order, parent, boxes = [], {}, []

    def walk(x, up):
        order.append(x)
        parent[x] = up
        if x.text:
            boxes.append((x, x.text))
        for c in x:
            walk(c, x)
            if c.tail:
                boxes.append((x, c.tail))

    walk(body, None)

    def chain(x):
        while x is not None:
            yield x
            x = parent[x]

    gone = {x for x in order if any(y.tag in ("nav", "footer") for y in chain(x))}
    boxes = [(x, " ".join(t.split())) for x, t in boxes if t.strip() and x not in gone]
    inside = lambda x: [(y, t) for y, t in boxes if x in chain(y)]
    text = {x: sum(len(t) for _, t in inside(x)) for x in order}
    headline = {x: any(y.tag in ("h1", "main") and x in chain(y) for y in order if y not in gone) for x in order}
    marked = {x for x in order if x.get("class") in ("sidebar", "comments") or x.tag == "form"}
    for x in order:
        share = text[x] / max(text[body], 1)
        if x in marked and x not in gone and not (share > 0.5 and (headline[x] or (share >= 0.9 and not headline[body]))):
            gone |= {y for y in order if x in chain(y)}
    boxes = [(x, t) for x, t in boxes if x not in gone]
    if not boxes:
        return ""
    got = dict.fromkeys(order, 0.0)
    for x, t in boxes:
        for k, y in enumerate([y for y in chain(x) if y.tag in op.CONTAINERS][:8]):
            worth = 0.2 if len(t) < 25 else 1 + t.count(",") + min(len(t) / 100, 3)
            got[y] += worth * (1 if k == 0 else 0.5 if k == 1 else 1 / (3 * k))
    score = {x: (got[x] + op.PRIOR.get(x.tag, 0)) * (0.5 if x in marked else 1) for x in order}
    places = [x for x in order if x.tag in op.CONTAINERS and x not in gone and inside(x)]
    best = max(places, key=lambda x: (score[x], -order.index(x)))
    kept = [best]
    for x in parent[best] if parent[best] is not None else []:
        chars = sum(len(t) for _, t in inside(x))
        if x is not best and chars and (got[x] >= max(10, 0.2 * got[best]) or (x.tag == "p" and chars > 80) or (x.tag == best.tag == "article")):
            kept.append(x)
    return "\n\n".join(t for y, t in boxes if any(k in chain(y) for k in kept))


def random_page(rng):
    def words():
        return " ".join(rng.choice(["word", "comma,", "longerword", "x"]) for _ in range(rng.choice([1, 3, 12, 40, 90])))

    def node(depth):
        if depth == 0 or rng.random() < 0.35:
            return f"<{(t := rng.choice(['p', 'h2', 'h1', 'p', 'p']))}>{words()}</{t}>"
        tag = rng.choice(["div", "div", "section", "article", "blockquote", "main", "nav", "footer", "form", "div"])
        mark = rng.choice(["", "", "", ' class="sidebar"', ' class="comments"', ' class="no-sidebar"'])
        inner = "".join(node(depth - 1) for _ in range(rng.randint(1, 4)))
        return f"<{tag}{mark if tag in ('div', 'section') else ''}>{words() + ' ' if rng.random() < 0.2 else ''}{inner}</{tag}>"

    return "<html>" + "".join(node(4) for _ in range(rng.randint(1, 4))) + "</html>"


def test_pages_match_the_plain_scoring():
    rng, full = random.Random(3), 0
    for _ in range(1500):
        page = random_page(rng)
        want = plain_main_text(page)
        assert op.main_text(page) == want, page
        full += bool(want)
    assert full > 1000
