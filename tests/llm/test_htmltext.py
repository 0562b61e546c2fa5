import math
import random
import re
import time
from html import unescape
from html.parser import HTMLParser

import pytest

from tallyspark.llm import htmltext
from tallyspark.llm.htmltext import main_text

STORY = [f"Paragraph {i} tells the story &amp; goes on, with several words in it." for i in range(4)]
CLEAN = "\n".join(["A title", *map(unescape, STORY)])
BODY = "<h1>A title</h1>" + "".join(f"<p>{p}</p>" for p in STORY)
EXTRA = {
    "nav": "<nav><ul><li><a href='/a'>Home</a></li><li><a href=/b>News</a></li></ul></nav>",
    "header": "<header><h2>The Site</h2><p>Since ages ago we write very long slogans about ourselves, here.</p></header>",
    "footer": "<footer>&copy; someone, all rights reserved and much more legal text that is long, long, long.</footer>",
    "aside": "<aside><p>Read on: a long teaser of another story that is not part of this one at all.</p></aside>",
    "ad": "<div class='ad'>Buy this. Buy that. Buy it all, and then buy some more of what you never needed.</div>",
    "ad2": "<div id=top class=\"box ad-slot\"><p>Buy this now.</p></div>",
    "notice": "<div class=cookie-notice><p>We use cookies for this and for that, accept them all or go away.</p></div>",
    "form": "<form action=x><label>Name</label><input name=n><button>Send it</button></form>",
    "script": "<script>var t=\"</p><p>no\"; if (a<b) go();</script><style>p{margin:0}</style>",
    "comments": "<section id='comments'><h3>Comments</h3><p>I think that this is a very good story, thanks.</p></section>",
    "sidebar": "<div class=\"left sidebar\"><ul><li>One thing</li><li>Other thing</li></ul></div>",
    "header name": "<div id='header'><p>The name of the site and its many words of welcome to everyone.</p></div>",
    "comment list": "<ol class='commentlist'><li>A reader says many things about this story here.</li></ol>",
    "comment": "<!-- <p>not shown</p> -->",
}


@pytest.mark.parametrize("name", EXTRA)
@pytest.mark.parametrize("shell", ["<article>{}</article>", "<div id=c>{}</div>", "<main><div>{}</div></main>"])
def test_leaves_out(name, shell):
    x = EXTRA[name]
    assert main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{x}{shell.format(BODY)}{x}</body></html>") == CLEAN


def test_names_of_wrappers():
    assert main_text(f"<body><div class='has-sidebar'>{BODY}</div>{EXTRA['sidebar']}") == CLEAN
    assert main_text(f"<body><div class='banner page'><article>{BODY}</article></div>{EXTRA['footer']}") == CLEAN


def test_inside_the_article():
    inside = BODY + EXTRA["ad"] + EXTRA["comments"] + EXTRA["form"]
    assert main_text(f"<body>{EXTRA['nav']}<article>{inside}</article>") == CLEAN


def test_unclosed_and_nested_markup():
    html = "<article><h1>T</h1><p><b>One <i>bold</i>text.<br><p>Two\n\t words &eacute;&#233;&nbsp;x.<ul><li>a<li>b</ul>tail</article>"
    assert main_text(html) == "T\nOne boldtext.\nTwo words éé x.\na\nb\ntail"


@pytest.mark.parametrize("html", [None, "", "  \n", "<p></p>", "<!-- x", "<script>x</script>"])
def test_no_text(html):
    assert main_text(html) == ""


def test_odd_pages():
    assert main_text("just words") == "just words"
    assert main_text("<p title='a>b'>x</p>") == "x"
    assert main_text("<nav>only a menu</nav>") == "" and main_text("<footer>legal</footer>") == ""
    assert main_text("a < b <3 and c") == "a < b <3 and c"
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert len(main_text("<p>" + "word " * 200000)) == 999999
    assert main_text('<p title="never closed>one</p><p>two</p>') != None  # noqa: E711


def by_template(html):
    """The generated pages hold one article with headings and paragraphs, some unclosed."""
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:h1|p|li|ul|br)>", re.sub(r"</?(?:b|i|a)\b[^>]*>", "", inner))
    return "\n".join(t for t in (" ".join(unescape(p).split()) for p in parts) if t)


def test_all_generated_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in htmltext.extract(rows).collect()}
    assert len(got) == 250
    for r in rows.collect():
        assert got[r.page_id].text == by_template(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_edges(spark):
    kind = "page_id long, url string, html string, text string, n_chars int"
    assert htmltext.extract(spark.createDataFrame([], kind)).count() == 0
    got = htmltext.extract(spark.createDataFrame([(1, None, None, "x", 1), (1, "u", "<p>é😀</p>", "x", 1)], kind)).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "u", "é😀", 2), (1, None, "", 0)]


@pytest.mark.parametrize(
    "name", ["post overflow-hidden", "article-body left-sidebar", "navy-text", "job-search-guide", "social-history", "data-widget content", "commentary", "widget"]
)
def test_names_that_hold_the_article(name):
    inner = f"<h1>A title</h1><div class='{name}'>{BODY.removeprefix('<h1>A title</h1>')}</div>"
    assert main_text(f"<body>{EXTRA['nav']}<article>{inner}{EXTRA['ad']}</article>{EXTRA['footer']}") == CLEAN


def test_hidden_is_an_attribute():
    assert main_text("<article><p title='the hidden cost'>One two.</p><p hidden>No.</p><p data-x=hidden>Three.</p></article>") == "One two.\nThree."


def test_comments_that_are_articles():
    comments = "<section class='comments'>" + "<article class='comment'><p>I think that this is a good story.</p></article>" * 3 + "</section>"
    assert main_text(f"<body><article>{BODY}{comments}</article>{EXTRA['footer']}") == CLEAN


def test_what_density_overrules():
    six = "".join(f"<p>{p}</p>" for p in STORY)
    assert main_text(f"<article><div class='related-work'>{six}</div><p>one line</p></article>") == CLEAN.removeprefix("A title\n") + "\none line"
    assert main_text(f"<body><form><div>{BODY}</div>{EXTRA['nav']}</form></body>") == CLEAN


def test_nothing_else_is_dropped():
    assert main_text("<article><p>We know where <math><mi>x</mi>=2</math> holds<object data=x> too</object>.</p><p>Yes.</p></article>") == "We know where x=2 holds too.\nYes."
    assert main_text(f"<article><h1>A title</h1><p>By someone</p><div>{BODY.removeprefix('<h1>A title</h1>')}</div>an end</article>") == CLEAN.replace("\n", "\nBy someone\n", 1) + "\nan end"


@pytest.mark.parametrize("piece", ["<title>", "<p title='", '<a "', "<script>x", "<", "<!--", "<li><ul>", "<p>x<b ", "</p", "<dd><span>", "<td a='>'", "&#"])
def test_a_megabyte_of_broken_markup(piece):
    start = time.time()
    main_text("<p>Some words.</p>" + piece * (1_000_000 // len(piece)))
    assert time.time() - start < 12 * (1_000_000 // len(piece)) / 100_000 + 2


class Dom(HTMLParser):
    """A tree of [tag, mark, children, number], children being trees and texts, of pages whose tags all close."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.open, self.count = [["#root", False, [], 0]], 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.count += 1
        node = [tag, tag in ("nav", "footer", "aside") or dict(attrs).get("class") == "ad", [], self.count]
        self.open[-1][2].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][2].append(data)


def counted(node, link=False, marked=False):
    """(characters, tags below, link characters, link tags below) of a tree, by recursion."""
    marked = marked or node[1]
    inside = link or marked or node[0] == "a"
    total = [0, 0, 0, 0]
    for child in node[2]:
        if isinstance(child, str):
            size = len(child.strip())
            total = [total[0] + size, total[1], total[2] + size * inside, total[3]]
        else:
            own = counted(child, inside, marked)
            is_link = child[0] == "a" or child[1] or marked
            total = [total[0] + own[0], total[1] + own[1] + 1, total[2] + own[2], total[3] + own[3] + is_link]
    return total


def composite(c, t, lc, lt, ratio):
    if c == 0:
        return 0.0
    t, l, lt = max(t, 1), max(lc, 1), max(lt, 1)
    if lc == 0 and ratio == 0:  # a page without links: the base of the logarithm would be one
        return c / t
    return c / t * max(0.0, math.log(c / l * t / lt, math.log(c / max(1, c - lc) * lc + ratio * c + math.e)))


def plain_extract(html):
    """The method once more, by recursion over a tree of another parser."""
    root = Dom(html).open[0]
    whole = counted(root)
    ratio = whole[2] / max(1, whole[0])
    best = (-1,)

    def walk(node, path):
        nonlocal best
        if node[1]:
            return 0.0
        sums = sum(walk(c, [*path, node]) for c in node[2] if not isinstance(c, str))
        dense = composite(*counted(node), ratio)
        best = max(best, (sums, dense, -node[3], [*path, node]), key=lambda x: x[:3])
        return dense

    walk(root, [])
    path = best[3]
    threshold = min(composite(*counted(x), ratio) for x in [x for x in path if x[0] not in ("#root", "html")] or path)
    outer_tags = ("#root", "html", "body")
    semantic = [k for k, x in enumerate(path) if x[0] in ("article", "main")] or [k for k, x in enumerate(path) if x[0] not in outer_tags]
    lines, now = [], []

    def cut():
        lines.append(" ".join(unescape("".join(now)).split()))
        now.clear()

    def few_links(node):
        c, _, lc, _ = counted(node)
        return 2 * lc <= c

    def is_menu(node):
        c, _, lc, lt = counted(node)
        return 2 * lc > c and lt >= 3 and node[0] in htmltext.MENUS

    def show(node, depth, keep):
        """depth: the node's place on the path, or None."""
        if node[1]:
            return
        block = node[0] in htmltext.BLOCK
        if block:
            cut()
        centre = depth == len(path) - 1
        outer = node[0] in ("#root", "html", "body")
        lenient = depth is not None and (bool(semantic) and depth >= semantic[0] or centre and outer)
        keep = keep or centre and not outer
        before = True
        for child in node[2]:
            if isinstance(child, str):
                if keep or lenient:
                    now.append(child)
            elif depth is not None and depth + 1 < len(path) and child is path[depth + 1]:
                before = False
                show(child, depth + 1, False)
            elif not is_menu(child) if keep else depth is not None and (
                not is_menu(child)
                if lenient
                else composite(*counted(child), ratio) >= threshold > 0 or child[0] in ("h1", "h2") and before and few_links(child)
            ):
                show(child, None, True)
            elif child[0] in htmltext.BLOCK:
                cut()
        if block:
            cut()

    show(root, 0, False)
    cut()
    return "\n".join(x for x in lines if x)


def random_page(rng):
    def words(n):
        return " ".join(rng.choice(["alpha", "be", "gamma", "a", "delta", "epsilon"]) for _ in range(n))

    def part(depth):
        kind = rng.choice(["p", "p", "p", "div", "div", "ul", "h2", "section", "nav", "ad", "links"])
        if depth > 3 or kind in ("p", "h2"):
            link = f" <a href=x>{words(rng.randint(1, 3))}</a>" if rng.random() < 0.3 else ""
            return f"<{'p' if kind != 'h2' else 'h2'}>{words(rng.randint(1, 60))}{link}</{'p' if kind != 'h2' else 'h2'}>"
        if kind == "links":
            return "<div>" + "".join(f"<a href=x>{words(2)}</a> " for _ in range(4)) + "</div>"
        inner = "".join(part(depth + 1) for _ in range(rng.randint(1, 5)))
        tag = {"ad": "div", "ul": "div"}.get(kind, kind)
        return f"<{tag}{' class=ad' if kind == 'ad' else ''}>{inner}</{tag}>"

    body = "".join(part(0) for _ in range(rng.randint(1, 6)))
    shell = rng.choice(["{}", "<article>{}</article>", "<div>{}</div><footer>some legal words</footer>", "<main>{}</main><div>x y</div>"])
    return f"<html><body>{shell.format(body)}</body></html>"


def test_against_plain_recursion(monkeypatch):
    """Marks are taken as they are on both sides; what overrules them has tests of its own."""
    monkeypatch.setattr(htmltext, "_marked", lambda page: [m > 0 for m in page.mark])
    rng = random.Random(1)
    for _ in range(400):
        page = random_page(rng)
        assert main_text(page) == plain_extract(page)


LONG = [f"Long paragraph {i} goes on and on about the story, with many words that make it dense and plain to read for everyone." for i in range(3)]
PARTS = {
    "second section": ("<section><p>{0}</p><p>{1}</p></section><section><h2>Second</h2><p>Short one.</p></section>", "{0}\n{1}\nSecond\nShort one."),
    "list": ("<div><p>{0}</p><p>{1}</p></div><ul><li>one</li><li>two</li><li>three</li><li>four</li><li>five</li><li>six</li></ul>", "{0}\n{1}\none\ntwo\nthree\nfour\nfive\nsix"),
    "table": ("<div><p>{0}</p><p>{1}</p></div><table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>", "{0}\n{1}\na\nb\nc\nd"),
    "short closing": ("<div><p>{0}</p><p>{1}</p></div><div><p>Short closing part with <b>bold</b> words.</p></div>", "{0}\n{1}\nShort closing part with bold words."),
    "link paragraph": ("<p>{0}</p><p>{1}</p><p><a href=x>Source document here</a></p>", "{0}\n{1}\nSource document here"),
    "two links": ("<div><p>{0}</p><p>{1}</p></div><div><a href=x>One source</a> and <a href=y>another</a></div>", "{0}\n{1}\nOne source and another"),
    "quote": ("<h2>Words</h2><div><p>{0}</p><p>{1}</p></div><blockquote>It is so.</blockquote>", "Words\n{0}\n{1}\nIt is so."),
    "figure": ("<div><p>{0}</p><p>{1}</p></div><figure><img src=x><figcaption>A picture</figcaption></figure><p>End.</p>", "{0}\n{1}\nA picture\nEnd."),
    "steps": ("<div><div><h3>Step 1</h3><p>{0}</p></div><div><h3>Step 2</h3><p>Do it.</p></div></div>", "Step 1\n{0}\nStep 2\nDo it."),
    "words between": ("first words<div><p>{0}</p><p>{1}</p></div>last words", "first words\n{0}\n{1}\nlast words"),
}
GONE = {
    "p.ad": "<p class='ad'>Buy now and buy a lot more of it</p>",
    "reader comments": "<div class='reader-comments'><h3>What you say</h3><p>I like this story, it is good.</p></div>",
    "comment section": "<div id=comment-section><p>I like this story, it is good.</p><p>So do I, and more than you do.</p></div>",
    "discussion": "<section class=discussion><p>I like this story, it is good and it is long.</p></section>",
    "comment": "<div class=comment><p>I like this story, it is good.</p></div><div class=comment><p>So do I.</p></div>",
    "p.comment": "<p class=comment>I like this story, it is good.</p>",
    "comments by shape": "<div class=xyz>" + "".join(f"<div><b>Reader {i}</b> <time>2 May 2024</time><p>I like this story, it is good.</p></div>" for i in range(3)) + "</div>",
    "comments by date": "<h3>Your voice</h3>" + "".join(f"<div class=q><span>Ann, {i} hours ago</span><p>I like this story, it is good.</p></div>" for i in (2, 3)),
    "menu": "<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div>",
}


@pytest.mark.parametrize("shell", ["<div id=content>{}</div>", "<div id=page><div class=story>{}</div></div>", "<article>{}</article>", "<main><div>{}</div></main>"])
@pytest.mark.parametrize("part", PARTS)
def test_every_part_of_an_article_stays(part, shell):
    html, want = PARTS[part]
    page = f"<body>{EXTRA['nav']}{shell.format(html.format(*LONG))}{EXTRA['footer']}</body>"
    assert main_text(page) == want.format(*LONG)


@pytest.mark.parametrize("shell", ["<div id=content>{}</div>", "<article>{}</article>", "<main><div>{}</div></main>"])
@pytest.mark.parametrize("name", GONE)
def test_comments_and_adverts_of_any_name_go(name, shell):
    page = f"<body>{EXTRA['nav']}{shell.format(BODY + GONE[name])}{EXTRA['footer']}</body>"
    assert main_text(page) == CLEAN


def test_an_article_that_is_one_link():
    assert main_text("<article><p><a href=x>Read the whole document there</a></p></article>") == "Read the whole document there"


def test_sections_with_dates_are_no_comments():
    parts = "".join(f"<section><h2>Day {i}</h2><p>On 2024-05-0{i} they went on, {LONG[i]}</p></section>" for i in range(1, 3))
    assert main_text(f"<body><div>{parts}</div></body>").count("Day") == 2


def test_implied_end_tags_reach_any_depth():
    assert main_text("<article><ul><li>" + "<i>" * 1000 + "one<li>two</ul></article>") == "one\ntwo"
