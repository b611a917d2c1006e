"""Operator 4: main text of web pages as the maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import with_computed

# Fixed values of the HTML standard: elements that stay in a line, that have no content, whose content is no markup.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements of formulas; they stay in a line too.
MATH = frozenset("math semantics maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover none".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe object canvas select noframes audio video".split())
#: Of RAW, those whose content is markup after all: without an end tag they are read on after.
MARKUP = frozenset("noscript template object canvas select audio video".split())
#: The elements of a drawing that hold markup of the page again, and the other start tags, besides CLOSES_P, that end a drawing left open.
INTEGRATION = frozenset("foreignobject desc title".split())
ENDS_SVG = frozenset("b big body br center code dd dt em embed head i img li listing main menu meta nobr ruby s small span strong strike sub sup tt u var".split())
#: An end or start tag of these closes an open one of the same group.
IMPLIED = {"p": "p", "li": "li", "dt": "d", "dd": "d", "tr": "tr", "td": "td", "th": "td", "option": "option"}
#: Start tags that close an open paragraph.
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Every other element of the standard; a start tag of none of these that runs into the next tag is no tag.
KNOWN = INLINE | MATH | VOID | RAW | INTEGRATION | ENDS_SVG | CLOSES_P | frozenset("html caption colgroup datalist details dir figcaption figure frame frameset hgroup legend marquee noembed optgroup option search slot summary svg tbody td tfoot th thead tr xmp annotation annotation-xml".split())

# A quote opens a value only behind =. A tag ends at > or in front of the next <.
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(>|(?=<))|<[!?/][^>]*+>", re.S)
# A quote that is not closed holds the rest.
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s\"'>][^\s>]*+)))?+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Only attributes with one of these words in them can hide an element.
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_STYLE_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)

# Labelled pages are put together from these: b words are boilerplate, c words are content.
BOILERPLATE = [
    '<nav><ul><li><a href="#">b b</a></li><li><a href="#">b</a></li></ul></nav>', '<div class="menu"><ul><li><a>b</a></li><li><a>b</a></li></ul></div>', '<header class="site-header"><div class="logo"><a>b</a></div><p>b b</p></header>',
    '<header><h1>b b</h1><nav><a>b</a> <a>b</a></nav></header>', '<div id="header"><h2>b b</h2><p>b b b</p></div>', '<div class="navbar"><a>b</a><a>b</a></div>', '<div class="breadcrumb breadcrumbs"><a>b</a> <span>b</span></div>',
    '<aside><h3>b</h3><p>b b b b</p></aside>', '<aside class="sidebar"><div class="widget"><h3>b b</h3><ul><li><a>b b</a></li></ul></div></aside>', '<div id="sidebar"><p>b b b b b b</p></div>', '<section class="sidebar related"><h2>b</h2><p>b b b b</p></section>',
    '<footer>b b b b</footer>', '<footer class="site-footer"><p>b b b b b</p><ul><li><a>b</a></li></ul></footer>', '<div id="footer"><p>b b b b</p></div>', '<div class="copyright">b b b b</div>', '<div class="legal disclaimer terms"><p>b b b</p></div>',
    '<div class="cookie cookies consent"><p>b b b b b b</p><button>b</button></div>', '<div class="notice"><p>b b b b b</p></div>', '<div class="cookie-notice banner" role="dialog">b b b b <a>b</a></div>', '<section class="alert gdpr privacy"><p>b b b b</p></section>', '<div id="overlay" class="popup modal paywall"><p>b b b b</p></div>',
    '<div class="ad">b b b b b</div>', '<div class="ads advert advertisement"><p>b b b b b</p></div>', '<div class="sponsored sponsor promo promotion"><h3>b b</h3><p>b b b b b</p></div>', '<aside class="ad-slot"><p>b b b</p></aside>', '<div id="banner"><a>b b b</a></div>',
    '<form action="#"><label>b</label><input><p>b b b</p><button>b</button></form>', '<form class="search"><label>b b</label></form>', '<div class="newsletter subscribe signup"><h3>b b</h3><p>b b b b</p><form><label>b</label></form></div>', '<div class="login register"><p>b b b</p></div>', '<fieldset><legend>b</legend><label>b b</label></fieldset>',
    '<section class="comments"><h2>b b</h2><div class="comment"><p>b b b b b b b</p></div></section>', '<div id="comments"><ol><li><p>b b b b b b</p></li></ol></div>', '<ul class="comment-list"><li><article class="comment"><p>b b b b b</p></article></li></ul>', '<div class="replies reply respond discussion feedback reviews"><p>b b b b b</p></div>', '<div class="disqus thread responses"><p>b b b b</p></div>',
    '<div class="share social sharing"><a>b</a><a>b</a></div>', '<div class="related recommended more"><h3>b b</h3><ul><li><a>b b b b</a></li></ul></div>', '<div class="pagination pager"><a>b</a> <a>b</a></div>', '<div class="skip"><a>b b</a></div>', '<div class="tags meta byline author-box"><a>b</a> b b</div>',
    '<div role="navigation"><a>b</a></div>', '<div role="banner"><p>b b</p></div>', '<div role="contentinfo"><p>b b b</p></div>', '<div role="complementary"><p>b b b b</p></div>', '<div role="search"><label>b</label></div>', '<menu><li>b</li><li>b</li></menu>', '<dialog><p>b b b</p></dialog>', '<div class="toolbar topbar top"><span>b</span></div>', '<div class="bottom bar"><span>b b</span></div>',
]
CONTENT = [
    "<article>{}</article>", '<main><article class="post">{}</article></main>', "<main>{}</main>", '<div id="content">{}</div>', '<div class="content"><div class="post-body">{}</div></div>', '<div class="article entry-content">{}</div>', '<section class="story article-body">{}</section>',
    '<div id="main"><div class="text">{}</div></div>', '<div role="main">{}</div>', '<article itemprop="articleBody"><section>{}</section></article>', '<div class="page"><div class="entry">{}</div></div>', '<div class="container wrapper"><div class="row"><article>{}</article></div></div>', "<div>{}</div>", "{}",
]
BODY = [
    "<h1>c c c c</h1><p>c c c c c c c c</p><p>c c c c <a>c c</a> c c c</p>{}<p>c c c c</p>",
    "<h1>c c c</h1><p><b>c c c c c</b><br><p>c c c c c c</p><h2>c c</h2><p>c c c c c</p>{}<ul><li>c c c c</li><li>c c c <a>c</a></li></ul><p>c c c</p>",
    "<h2>c c</h2><p>c c c c c c c c c</p><blockquote><p>c c c c c</p></blockquote><pre>c c c</pre>{}<table><tr><th>c</th><td>c c</td></tr></table><p>c</p><figure><figcaption>c c c</figcaption></figure>",
    "c c c c c c c c c c c c c c c c c c<br><br>c c c c c c c c c c c<h2>c c</h2>c c c c c c c c c c c{}c c c c c c c c",
    "<p>c c c c c c</p><div><p>c c c c c c</p></div><h3>c c</h3><ol><li>c c c c</li></ol><dl><dt>c</dt><dd>c c c</dd></dl>{}<p>c c <em>c</em> c</p><section><h2>c c</h2><p>c c c c c</p></section>",
]

#: Highest score of a word, highest and lowest of a tag; between them they are learned.
WORD_MOST = 1.0
TAG_MOST, TAG_LEAST = -0.02, -2.0
#: Score of a stretch of boilerplate by its own marks, whatever its length: what stands behind it must be worth more to be joined.
HOLE = -1.0
RIDGE = 0.01
#: Least weight of an element's own marks by which it stands for content as a whole.
CONTAINER = 1.0
#: Elements that hold a whole page only by mistake; any other that holds over half of its words and its heading is a wrapper.
NO_WRAPPER = frozenset("nav aside footer header menu dialog".split())


def labelled_pages() -> Iterator[str]:
    """Pages of every container and body, with boilerplate around and within them, each piece in several places."""
    k = 0
    for container in CONTENT:
        for body in BODY:
            own = [BOILERPLATE[(k + j * 7) % len(BOILERPLATE)] for j in range(6)]
            k += 5
            yield "<html><head><title>b b</title></head><body>" + "".join(own[:3]) + container.format(body.format(own[3])) + "".join(own[4:]) + "</body></html>"


@dataclass
class Open:
    """An element with its marks. weigh() fills in what it holds, and the sum of the weights of its marks and of all above."""

    tag: str
    above: Open | None = None
    marks: tuple = ()
    hidden: bool = False
    #: Whether what comes next is part of a drawing.
    drawing: bool = False
    #: Its runs: from the start tag's to the one before the end tag's.
    first: int = 0
    last: int = 0
    words: int = 0
    #: Whether it holds the heading or the element of an article.
    leads: bool = False
    #: Weight of its own marks, those that an element above has too not counted.
    own: float = 0.0
    total: float = 0.0

    def all_marks(self) -> tuple:
        """Its marks and those above, each once, the outermost first. It takes the depth of the element; learning alone asks for it."""
        parts, at = [], self
        while at:
            parts.append(at.marks)
            at = at.above
        return tuple(dict.fromkeys(m for marks in reversed(parts) for m in marks))


@dataclass
class Run:
    """Text between two tags with the element around it, or a tag, where text is None, with its element."""

    text: str | None
    tag: str = ""
    within: Open | None = None
    breaks: bool = False
    words: int = 0


def _attributes(attributes: str) -> dict[str, str]:
    """Values by name in lower case, '' where there is none; of several of one name the first."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), a or b or c)
    return found


def _hides(attributes: str) -> bool:
    """Whether an element is hidden: by an attribute hidden, by aria-hidden of the value true, or by the display:none that counts in its style."""
    if not _MAY_HIDE.search(attributes):
        return False
    found = _attributes(attributes)
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true":
        return True
    display, fixed = "", False
    for declaration in _STYLE_COMMENT.sub(" ", found.get("style", "")).split(";"):
        name, _, value = declaration.partition(":")
        value, _, important = value.lower().partition("!")
        if name.strip().lower() == "display" and (important or not fixed):
            display, fixed = value.strip(), bool(important)
    return display == "none"


def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """An element's marks: its name, and the words of its class, id, role and itemprop."""
    marks = [f"<{tag}>"]
    for name, value in _attributes(attributes).items() if "=" in attributes else ():
        if name in ("class", "id", "role", "itemprop"):
            marks += [w.lower() for w in _NAME.findall(value)]
    return tuple(dict.fromkeys(marks))


def parse(page: str) -> tuple[list[Run], list[Open]]:
    """Tags and texts of a page in order, and its elements, each after the one around it; end tags that may be left out are implied.

    Scripts, styles, comments and hidden elements are passed over, drawings (svg) too. The text of formulas (math, without its
    annotations, which no browser shows) and of xmp stays. A start tag of no known element that runs into another tag is text.
    Time is linear in the page.
    """
    root = Open("")
    stack, elements, runs = [root], [root], []
    count: Counter[str] = Counter()
    hidden = 0
    endless: set[str] = set()

    def pop() -> None:
        nonlocal hidden
        gone = stack.pop()
        gone.last = len(runs)
        count[gone.tag] -= 1
        hidden -= gone.hidden

    def add(text: str) -> None:
        if text and not hidden:
            runs.append(Run(text, within=stack[-1], words=len(text.split())))

    # Behind the last > there is no tag.
    at, start, end = 0, 0, page.rfind(">") + 1
    while start < end:
        m = _TOKEN.search(page, start, end)
        if not m:
            break
        kind, tag, attributes = m[1], (m[2] or "").lower(), m[3]
        if tag and m[4] != ">" and not (tag in KNOWN and (kind or not attributes.strip() or "=" in attributes)):
            # Text such as: a <b and c <d.
            start = m.start() + 1
            continue
        add(page[at : m.start()])
        at = start = m.end()
        if not tag:
            if at == end and m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
                at = len(page)
            continue
        breaks = tag not in INLINE and tag not in MATH
        around = None
        if kind == "/":
            if count[tag] > 0:
                while stack[-1].tag != tag:
                    pop()
                around = stack[-1]
                pop()
        else:
            if stack[-1].drawing and (tag in CLOSES_P or tag in ENDS_SVG):
                while stack[-1].drawing:
                    pop()
            group = IMPLIED.get(tag)
            if group and len(stack) > 1 and IMPLIED.get(stack[-1].tag) == group:
                pop()
            elif tag in CLOSES_P and count["p"] > 0:
                k = len(stack) - 1
                while k and stack[k].tag in INLINE:
                    k -= 1
                if stack[k].tag == "p":
                    while len(stack) > k:
                        pop()
            drawing = stack[-1].drawing
            if attributes.endswith("/") and (drawing or tag in ("svg", "math")):
                pass
            elif tag in RAW and not (drawing and tag in INTEGRATION):
                close = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if close:
                    at = start = close.end()
                elif tag in MARKUP or drawing:
                    endless.add(tag)
                else:
                    at = start = len(page)
            elif tag == "xmp":
                # Its content is text as it stands, so that main_text() must not read references in it.
                close = re.compile(r"</xmp\s*>", re.I).search(page, at)
                text = page[at : close.start() if close else len(page)]
                at = start = close.end() if close else len(page)
                if not hidden and not _hides(attributes):
                    runs.append(Run(None, tag, stack[-1], breaks))
                    add(entities.escape(text, quote=False))
            elif tag not in VOID and not attributes.endswith("/"):
                unseen = tag in ("svg", "annotation", "annotation-xml") or bool(attributes) and _hides(attributes)
                marks = () if tag in INLINE and tag != "a" or tag in MATH else _marks(tag, attributes)
                stack.append(Open(tag, stack[-1], marks, unseen, tag == "svg" or drawing and tag not in INTEGRATION, len(runs)))
                elements.append(stack[-1])
                count[tag] += 1
                hidden += unseen
        if not hidden:
            runs.append(Run(None, tag, around or stack[-1], breaks))
    rest, _, _ = page[at:].partition("<!--")
    add(rest)
    while stack:
        pop()
    return runs, elements


@dataclass
class Weights:
    """Scores of words by the marks around them, and of tags, learned from labelled pages."""

    bias: float
    marks: dict[str, float]
    tags: dict[str, float]
    known: dict[str, float] = field(default_factory=dict)

    def mark(self, name: str) -> float:
        if name in self.marks or name[0] == "<":
            return self.marks.get(name, 0.0)
        got = self.known.get(name)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            # A compound takes the weight of the strongest longer mark within it.
            got = self.known[name] = min((w for k, w in self.marks.items() if len(k) > 4 and k[0] != "<" and k in name), default=0.0)
        return got

    def word(self, within: Open) -> float:
        """Score of a word; 0 is boilerplate."""
        return max(0.0, min(WORD_MOST, self.bias + within.total))

    def weigh(self, runs: list[Run], elements: list[Open]) -> None:
        """Fill in what the elements hold and weigh.

        Each mark counts once, for the outermost element that has it. An element that holds over half of the page's words and the
        heading, or an element of an article, is a wrapper: names such as has-sidebar or page-top don't make it boilerplate.
        """
        for r in runs:
            r.within.words += r.words
        for e in reversed(elements):
            e.leads |= e.tag == "h1" or e.tag in ("article", "main") and sum(map(self.mark, e.marks)) > 0
            if e.above:
                e.above.words += e.words
                e.above.leads |= e.leads
        half = elements[0].words / 2
        stack: list[tuple[Open, tuple]] = []
        seen: set[str] = set()
        for e in elements:
            while stack and stack[-1][0] is not e.above:
                seen.difference_update(stack.pop()[1])
            new = [(m, w) for m in e.marks if m not in seen for w in (self.mark(m),)]
            if e.tag in ("html", "body") or e.leads and e.words > half and e.tag not in NO_WRAPPER:
                new = [x for x in new if x[1] >= 0]
            e.own = sum(w for _, w in new)
            e.total = e.own + (e.above.total if e.above else 0.0)
            stack.append((e, tuple(m for m, _ in new)))
            seen.update(stack[-1][1])


@lru_cache(maxsize=1)
def learned() -> Weights:
    """Logistic weights of marks, by whether a word with them is content, and log-odds of tags between content words, from labelled_pages()."""
    seen: Counter[tuple] = Counter()
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page in labelled_pages():
        runs, _ = parse(page)
        last, follows, after = "", "b", []
        for run in reversed(runs):
            words = (run.text or "").split()
            follows = words[0] if words else follows
            after.append(follows)
        for run, then in zip(runs, reversed(after), strict=True):
            if run.text is not None:
                words = run.text.split()
                seen[run.within.all_marks(), "c" in words] += len(words)
                last = words[0] if words else last
            else:
                (inside if last == "c" and then == "c" else outside)[run.tag] += 1
    names = sorted({m for context, _ in seen for m in context})
    index = {m: i + 1 for i, m in enumerate(names)}
    x, y, n = np.zeros((len(seen), len(names) + 1)), np.zeros(len(seen)), np.zeros(len(seen))
    for i, ((context, good), times) in enumerate(seen.items()):
        x[i, 0] = 1
        x[i, [index[m] for m in context]] = 1
        y[i], n[i] = good, np.sqrt(times)
    w = np.zeros(len(names) + 1)
    ridge = np.full(len(w), RIDGE * 2)
    ridge[0] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * w)
        w += step * min(1.0, 4 / (np.linalg.norm(step) + 1e-12))
    odds = {t: max(TAG_LEAST, min(TAG_MOST, float(np.log((inside[t] + 0.2) / (outside[t] + 0.2))) / 2)) for t in inside.keys() | outside.keys()}
    return Weights(float(w[0]), dict(zip(names, map(float, w[1:]), strict=True)), odds)


def region(scores: Sequence[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch of the largest sum, by one scan; empty if no sum is positive. Of equal ones that begin with nothing they gain nothing by, the first, and of those of one start the longest."""
    best, start, end, total, at = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        total += s
        if total <= 0:
            total, at = 0.0, i + 1
        elif total > best or total == best and at == start:
            best, start, end = total, at, i + 1
    return start, end


def tag_and_word_scores(runs: list[Run], weights: Weights) -> list[float]:
    """Scores of the runs: words by the marks around them, tags by name; a stretch of boilerplate by its marks is one score of HOLE, wherever its tags and words end."""
    scores, hole = [], False
    for r in runs:
        good = weights.word(r.within)
        if good > 0:
            hole = False
            scores.append(r.words * good if r.text is not None else weights.tags.get(r.tag, TAG_MOST))
        else:
            scores.append(0.0 if hole else HOLE)
            hole = True
    return scores


def grown(runs: list[Run], start: int, end: int) -> tuple[int, int]:
    """The region, or the article around it, or else the innermost element with its heading whose own marks stand for content: its first and last lines belong to it, be they short, lists or tables."""
    at = next((r.within for r in runs[start:end] if r.text is not None), None)
    found = None
    while at and at.tag not in ("", "body", "html"):
        if at.first <= start and end <= at.last:
            if at.tag in ("article", "main") and at.own > 0:
                return at.first, at.last
            if found is None and at.own >= CONTAINER and at.leads and at.tag not in INLINE:
                found = at.first, at.last
        at = at.above
    return found or (start, end)


def main_text(page: str | None, weights: Weights | None = None, find: Callable[[Sequence[float]], tuple[int, int]] | None = None) -> str:
    """The blocks of the best region, one a line; boilerplate within it, by its own marks, is left out. find: region(), or another search of the best stretch."""
    if not page:
        return ""
    weights = weights or learned()
    runs, elements = parse(page)
    weights.weigh(runs, elements)
    word = [weights.word(r.within) if r.text is not None else 0.0 for r in runs]
    start, end = (find or region)(tag_and_word_scores(runs, weights))
    start, end = grown(runs, start, end)
    blocks, block = [], []

    def flush() -> None:
        if line := " ".join(entities.unescape("".join(block)).split()):
            blocks.append(line)
        block.clear()

    for r, w in zip(runs[start:end], word[start:end], strict=True):
        if r.text is not None:
            if w > 0:
                block.append(r.text)
        elif r.breaks:
            flush()
        elif r.tag == "br":
            block.append(" ")
    flush()
    return "\n".join(blocks)


EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract_text(pages: DataFrame, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The `keep` columns with text and n_chars (code points) of every page.

    Null or empty html, and pages without a region of positive score: text ''. Broken markup is read as far as it goes:
    unknown end tags are passed over, what is open at the end is closed. Pages of any length are read whole, in linear
    time. Of regions of equal score the first counts. Repeated rows each by itself. Empty tables: no rows. No shuffle; what a
    task holds is one Arrow batch and the runs of one page.
    """

    def make() -> Callable:
        weights = learned()

        def one(page: str | None) -> tuple:
            text = main_text(page, weights)
            return text, len(text)

        return one

    return with_computed(pages, ["html"], keep, EXTRACTED, make)


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
