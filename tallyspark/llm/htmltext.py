"""Main-text extraction by composite text density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import of_text

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg select head".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody"
    " td tfoot th thead tr ul".split()
)
#: A start tag of the key ends an open element of the values.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that the end tags implied by CLOSES never reach past.
FENCE = set("ul ol dl table article section div main body nav aside form menu".split())
ASIDE = set("nav aside footer menu dialog button search".split())
ASIDE_ROLE = set("navigation banner contentinfo complementary search form dialog menu alert".split())
_NAME = (
    r"(?:ads?|adsense|adsby\w*|ad-?(?:box|slot|unit)|adverts?|advertis\w+|sponsor(?:s|ed)?|promos?|promotions?|banner"
    r"|nav|navbar|navigation|menu|menubar|breadcrumbs?|side-?bar|rail|foot(?:er)?|masthead|(?:site|page|top)-?(?:header|bar)|toolbar|cookies?|consent|gdpr"
    r"|notices?|notification|alert|popup|modal|overlay|related|recommend(?:ed|ations?)|shar(?:e|ing)|social"
    r"|newsletter|subscri(?:be|ption)|signup|log-?in|search|widgets?|pagination|pager|tags?-?list|skip-?link|hidden|{})"
)
_COMMENT = r"comment-?list|comments|respond|disqus|replies"
#: Names made of these words alone, one of the first among them, are names of readers' comments.
COMMENT_WORDS = set("comment comments commentlist discussion discussions replies responses disqus".split())
BESIDE_COMMENT = set("reader readers user users visitor section list area thread threads wrap wrapper container item body text content box block the single post posts node stream feed reply".split())
_WHOLE = r"(?:(?:site|page|main|top|bottom|global|primary|secondary|post|entry)[-_])?{0}(?:[-_]{0})*(?:[-_](?:box|bar|list|links?|buttons?|wrap|wrapper|container|form|area|section|block|posts|inner))?"
#: Whole names (of class or id) of what is no article, and those of them that hold prose as dense as one.
ASIDE_NAME = re.compile(_WHOLE.format(_NAME.format(_COMMENT)), re.I)
COMMENT_NAME = re.compile(_WHOLE.format(f"(?:{_COMMENT})"), re.I)
HEADER_NAME = set("header copyright".split())
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
#: Why an element is marked: its tag, role or being hidden; a form; its name; the name of a list of comments.
HARD, FORM, NAMED, COMMENTS = 1, 2, 3, 4
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: What can be a menu without being named one.
MENUS = set("div ul ol dl section span center".split())
INLINE = set("a b i em strong".split())
#: Links that make a menu of what holds little else.
LINKS = 3
#: The most characters of a comment's first line, and of a comment that is known by its shape alone.
BYLINE, COMMENT = 60, 2000
#: When something was written, as comments have it.
WHEN = re.compile(r"\b(?:\d+ (?:second|minute|hour|day|week|month|year)s? ago|yesterday|just now|\d{4}-\d\d-\d\d|\d{1,2}[./ ](?:\d{1,2}|[A-Z][a-z]{2,8})[./ ]\d{2,4}|[A-Z][a-z]{2,8} \d{1,2},? \d{4})\b")
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: The same where quotes do not pair.
PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
OTHER = re.compile(r"<[!?/][^>]*+>")
RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}


def tags_of(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether an end tag, tag, attributes) of all markup in order; the tag is empty for comments and what else shows nothing.

    Raw elements are one such piece up to their end tag, or their start tag alone if
    none follows. Time is in proportion to the page: what was sought in vain, an
    end tag or the end of a quoted value, is not sought again.
    """
    at, last, quoted, endless = 0, html.rfind(">"), True, set()
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4) + 3
            end = len(html) if end < 3 else end
            yield at, end, False, "", ""
            at = end
            continue
        if at > last:
            return
        m = TAG.match(html, at) if quoted else None
        if not m and (m := PLAIN.match(html, at)):
            quoted = False
        if not m:
            end = m.end() if (m := OTHER.match(html, at)) else 0
            if end:
                yield at, end, False, "", ""
            at = end or at + 1
            continue
        tag, end = m[2].lower(), m.end()
        if tag in RAW and not m[1]:
            after = None if tag in endless else RAW_END[tag].search(html, end)
            if not after:
                endless.add(tag)
            yield at, after.end() if after else end, False, "", ""
            at = after.end() if after else end
            continue
        yield at, end, bool(m[1]), tag, m[3]
        at = end


def _of_comments(name: str) -> bool:
    words = re.split(r"[-_]+", name.lower())
    return not COMMENT_WORDS.isdisjoint(words) and COMMENT_WORDS.union(BESIDE_COMMENT).issuperset(words)


class Page:
    """The element tree as parallel lists; element 0 is the root, and parents come before their children."""

    def __init__(self, html: str):
        self.tag, self.parent, self.mark = ["#root"], [-1], [0]
        self.content: list[tuple[int, str | None]] = []  # (element, text), or (element, None) at a block's edge
        stack, open_, at = [0], {}, 0
        for start, end, closing, tag, attrs in tags_of(html):
            if start > at:
                self.content.append((stack[-1], html[at:start]))
            at = end
            if not tag:
                continue
            if closing:
                if open_.get(tag):
                    self._close(stack, open_, tag)
                elif tag in BLOCK:
                    self.content.append((stack[-1], None))
                continue
            if tag in BLOCK and tag != "br" and open_.get("p"):
                self._close_within(stack, open_, ("p",))
            if tag in CLOSES:
                self._close_within(stack, open_, CLOSES[tag])
            if tag in ("body", "html") and open_.get(tag):
                continue
            if tag in BLOCK:
                self.content.append((stack[-1], None))
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.mark.append(self._mark(tag, attrs, open_))
            if tag not in VOID and not attrs.endswith("/"):
                stack.append(len(self.tag) - 1)
                open_.setdefault(tag, []).append(len(stack) - 1)
        if at < len(html):
            self.content.append((stack[-1], html[at:]))

    def _close(self, stack, open_, tag) -> None:
        while True:
            name = self.tag[stack.pop()]
            open_[name].pop()
            if name in BLOCK:
                self.content.append((stack[-1], None))
            if name == tag:
                return

    def _close_within(self, stack, open_, tags) -> None:
        """End the innermost of ``tags``, unless an element that implied end tags do not reach past is further in."""
        innermost = lambda names: max((open_[t][-1] for t in names if open_.get(t)), default=-1)
        if (at := innermost(tags)) > innermost(FENCE):
            self._close(stack, open_, self.tag[stack[at]])

    @staticmethod
    def _mark(tag, attrs, open_) -> int:
        if tag == "form":
            return FORM
        if tag in ASIDE or tag == "header" and not (open_.get("article") or open_.get("main")):
            return HARD
        if not attrs or tag in ("html", "body"):
            return 0
        have: dict[str, str] = {}
        for name, *value in ATTR.findall(attrs):
            have.setdefault(name.lower(), "".join(value))
        role = have.get("role", "").lower().split()
        if role and role[0] in ASIDE_ROLE or "hidden" in have or have.get("aria-hidden", "").strip().lower() == "true" or UNSEEN.search(have.get("style", "")):
            return HARD
        if tag in ("article", "main") or tag in INLINE and open_.get("p"):
            return COMMENTS if tag == "article" and any(map(_of_comments, have.get("class", "").split())) else 0
        inside = open_.get("article") or open_.get("main")
        names = [x for key in ("class", "id") for x in have.get(key, "").split()]
        if any(COMMENT_NAME.fullmatch(x) or _of_comments(x) for x in names):
            return COMMENTS
        return NAMED if any(ASIDE_NAME.fullmatch(x) or not inside and x.lower() in HEADER_NAME for x in names) else 0


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Composite text density: characters a tag, lowered the more of them are link text."""
    if not chars:
        return 0.0
    tags, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars * link_chars / max(1, chars - link_chars) + body_ratio * chars + math.e)
    return chars / tags * max(0.0, math.log(max(1e-9, chars / lc * tags / lt)) / math.log(base)) if base > 1 else chars / tags


class Densities:
    """Text, tags and densities of every element, and the sums of children's densities.

    What ``marked`` elements hold counts as link text under link tags, which makes their
    density zero and lowers that of the elements around them.
    """

    def __init__(self, page: Page, marked: list[bool]):
        n = len(page.tag)
        self.out = marked[:]
        link = [False] * n
        for e in range(1, n):
            p = page.parent[e]
            self.out[e] = self.out[e] or self.out[p]
            link[e] = self.out[e] or link[p] or page.tag[e] == "a"
        self.chars, self.links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        self.link_tags = link_tags
        for e, text in page.content:
            if text and (size := len(text.strip())):
                self.chars[e] += size
                self.links[e] += size * link[e]
        for e in range(n - 1, 0, -1):
            p = page.parent[e]
            self.chars[p] += self.chars[e]
            self.links[p] += self.links[e]
            tags[p] += tags[e] + 1
            link_tags[p] += link_tags[e] + (self.out[e] or page.tag[e] == "a")
        ratio = self.links[0] / max(1, self.chars[0])
        each = zip(self.chars, tags, self.links, link_tags, self.out, strict=True)
        self.dense = [0.0 if out else density(c, t, lc, lt, ratio) for c, t, lc, lt, out in each]
        self.sums = [0.0] * n
        for e in range(1, n):
            self.sums[page.parent[e]] += self.dense[e]
        self.centre = max(range(n), key=lambda e: (not self.out[e], self.sums[e], self.dense[e], -e))


def main_text(html: str | None) -> str:
    """The article's text, one line for each block; empty for null, blank or textless pages, and those of menus and the like alone.

    Every element's density is its characters per tag, less the more of them are link
    text. The element whose children's densities sum highest is the centre, and the
    least density from it up to the body is the threshold. Everything around the centre
    is kept, short or long, up to the article or main element that holds it, or else up
    to the child of the body that does, or the body where that is the centre itself; but for
    menus, that is what holds mostly links, LINKS of them or more. Further out is kept what is
    as dense as the threshold, and headings before the path.

    Menus, notices, forms, comments and the like, by tag, role, whole name or, for comments,
    by shape, count as link text, so that their density is zero and they go. But a name,
    or being a form, does not count for an element that holds both the centre found
    without them and half of the text.
    """
    if not html or html.isspace():
        return ""
    page = Page(html)
    return _select(page, Densities(page, _marked(page)))


def _marked(page: Page) -> list[bool]:
    """Which elements are menus, notices and the like: those that :class:`Page` marks, unless density overrules it."""
    n = len(page.tag)
    for e in _shaped_like_comments(page):
        page.mark[e] = page.mark[e] or COMMENTS
    marked = [m > 0 for m in page.mark]
    holds = [t in ("article", "main") for t in page.tag]
    for e in range(n - 1, 0, -1):
        holds[page.parent[e]] |= holds[e]
    trial = [m == COMMENTS or m == HARD and not h for m, h in zip(page.mark, holds, strict=True)]
    if trial != marked:
        found = Densities(page, trial)
        plain = found.chars[0] - sum(found.chars[e] for e in range(1, n) if trial[e] and not found.out[page.parent[e]])
        e = found.centre
        while e > 0:
            if marked[e] and 2 * found.chars[e] >= plain:
                marked[e] = trial[e]
            e = page.parent[e]
    return marked


def _shaped_like_comments(page: Page) -> list[int]:
    """Elements that repeat side by side in one shape, each a short line that says who or when and then a text; and what holds nothing else.

    The shape is the tags of an element's children, runs of one tag taken once. A line
    before is a name, or holds a date, and each element has a time of its own.
    """
    n = len(page.tag)
    children: list[list[int]] = [[] for _ in range(n)]
    for e in range(1, n):
        children[page.parent[e]].append(e)
    texts: list[list[str]] = [[] for _ in range(n)]
    size, timed = [0] * n, [t == "time" for t in page.tag]
    for e, text in page.content:
        if text and not text.isspace():
            texts[e].append(text)
            size[e] += len(text.strip())
    for e in range(n - 1, 0, -1):
        timed[e] = timed[e] or any(WHEN.search(t) for t in texts[e] if len(t) <= BYLINE)
        size[page.parent[e]] += size[e]
        timed[page.parent[e]] |= timed[e]
    found, like = [], [False] * n
    for p in range(n):
        if not timed[p] or len(children[p]) < 2:
            continue
        groups: dict[tuple, list[int]] = {}
        for e in children[p]:
            own = children[e]
            tags = tuple(page.tag[c] for k, c in enumerate(own) if not k or page.tag[c] != page.tag[own[k - 1]])
            lead = own and size[own[0]] <= BYLINE and page.tag[own[0]] not in HEADINGS and len(own) > 1
            if timed[e] and lead and size[e] <= COMMENT and page.tag[e] not in INLINE:
                groups.setdefault((page.tag[e], tags), []).append(e)
        for own in groups.values():
            if len(own) > 1:
                found += own
                for e in own:
                    like[e] = True
    for p in {page.parent[e] for e in found}:
        rest = [c for c in children[p] if not like[c] and size[c] and page.tag[c] not in HEADINGS and page.mark[c] == 0]
        if not rest and page.tag[p] not in ("#root", "html", "body", "article", "main"):
            found.append(p)
        else:  # a heading right before the first of them is theirs
            first = next(k for k, c in enumerate(children[p]) if like[c])
            if first and page.tag[children[p][first - 1]] in HEADINGS:
                found.append(children[p][first - 1])
    return found


def _select(page: Page, found: Densities) -> str:
    n = len(page.tag)
    dense, out = found.dense, found.out
    path = [found.centre]
    while path[-1]:
        path.append(page.parent[path[-1]])
    outer = ("#root", "html", "body")
    threshold = min(dense[e] for e in [e for e in path if page.tag[e] not in outer[:2]] or path)
    around = [k + 1 for k, e in enumerate(path) if page.tag[e] in ("article", "main")] or [k + 1 for k, e in enumerate(path) if page.tag[e] not in outer]
    lenient = set(path[: max(around, default=0)])
    menu = lambda e: 2 * found.links[e] > found.chars[e] and found.link_tags[e] >= LINKS and page.tag[e] in MENUS
    whole = page.tag[found.centre] not in outer or not any(page.parent[e] == found.centre for e in range(1, n))
    kept = [False] * n
    kept[found.centre] = whole
    if not whole:
        lenient.add(found.centre)
    towards = dict(zip(path[1:], path, strict=False))
    on_path = set(path)
    for e in range(1, n):
        p = page.parent[e]
        if out[e]:
            continue
        if kept[p]:
            kept[e] = not menu(e)
        elif p in on_path and e not in on_path:
            if p in lenient:
                kept[e] = not menu(e)
            else:
                kept[e] = dense[e] >= threshold > 0 or page.tag[e] in HEADINGS and e < towards[p] and 2 * found.links[e] <= found.chars[e]
    blocks, now = [], []
    for e, text in page.content:
        if text is None:
            blocks.append(now)
            now = []
        elif kept[e] or e in lenient and not out[e]:
            now.append(text)
    blocks.append(now)
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)`` for every row of ``pages``; see :func:`main_text`. Other columns are ignored."""
    text = of_text("string", pa.string(), main_text, F.col(html_col))
    found = pages.select(F.col(id_col), F.col(url_col), text.alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
