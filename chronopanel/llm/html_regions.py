"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page is read once into a sequence of tags and texts. Words score positive and tags negative; the contiguous stretch of the
highest sum, found by a linear scan, is the content region. It grows to the ends of the main elements (``article``, ``main``)
that it lies in or cuts; on pages without them to those of containers named as content. Elements that are no part of an
article wherever they stand (menus, footers, forms, adverts, notices, comments and the like) neither score nor are returned.

Weights come from labelled pages: a page with a marked main element labels its own tokens, inside or outside of it. Over at
most about ``LABELLED`` such pages (drawn by a hash of page id and url) Spark counts every kind of token on both sides; a kind weighs the
logarithm of its share inside over its share outside, words from ``LEAST_WORD`` to ``MOST_WORD``, tags from ``LEAST_TAG`` to
``MOST_TAG``. Tokens in left-out elements do not count. Kinds without ``SUPPORT`` pages keep the weights of ``Weights``. Class and id words whose text lies outside on
nearly all labelled pages join the fixed list of names to leave out.

Defined cases: null or empty html, a page without words and a page whose words all lie in left-out elements give the empty text;
repeated pages each keep their row; without labelled pages the fixed weights hold; of equal regions the first one counts;
unclosed tags end with their parent or the page.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import column, map_batches

LABELLED, SUPPORT, SMOOTH, LEAST_WORD, MOST_WORD, LEAST_TAG, MOST_TAG, OUTSIDE = 2_000, 20, 1.0, 0.5, 1.5, -4.0, -0.1, 0.98

# Element and attribute names of the HTML standard and of common page templates.
RAW = {"script", "style", "title", "textarea", "iframe", "xmp", "noframes", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MAIN = {"article", "main"}
MAIN_NAMES = {"article", "articlebody", "body", "content", "entry", "main", "maincontent", "post", "story", "text"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
          "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option",
          "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br"}
PHRASES = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "kbd", "mark", "q", "s", "samp", "small", "strong", "sub", "sup", "time", "u", "var"}
LEFT_OUT = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "button", "select", "datalist", "template", "noscript", "svg", "canvas", "audio", "video", "object",
            "search", "fieldset", "input", "label"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "status"}
NAMES = {"ad", "ads", "adbox", "adslot", "adsense", "adsbygoogle", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie",
         "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "sidebar",
         "aside", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "topbar", "toolbar", "banner", "share", "sharing", "social",
         "related", "recommended", "recommendations", "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "pagination", "pager", "widget", "search",
         "login", "form", "skip", "copyright"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)>|</[^a-zA-Z>][^>]*+>|</>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?", re.I)
SPLIT = re.compile(r"[\s_\-]+")


@dataclass
class Weights:
    """Scores of words, words of links, and tags; names to leave out beside the fixed ones."""

    word: float = 1.0
    link: float = LEAST_WORD
    tag: float = -3.25
    tags: dict[str, float] = field(default_factory=lambda: {"p": -0.5, "br": -0.2, "li": -1.0, "ul": -1.0, "ol": -1.0, "blockquote": -0.5, "pre": -0.5, "section": -1.5, "div": -2.0,
                                                            "td": -1.0, "th": -1.0, "tr": -1.0, "img": -0.5, "figure": -1.0, "figcaption": -1.0, "span": -0.1, "hr": -0.5,
                                                            **{f"h{k}": -0.5 for k in range(1, 7)}, **{t: -0.1 for t in PHRASES}})
    names: frozenset[str] = frozenset()


class Page:
    """The token sequence of a page and the stretches of it that elements cover."""

    def __init__(self, source: str, names: frozenset[str] = frozenset()):
        self.tokens: list[tuple] = []          # (text, None, in a link) or (None, tag name, opening)
        self.left_out: list[tuple] = []        # (first, end, whole name, holds a main element)
        self.main: list[tuple[int, int]] = []
        self.like: list[tuple[int, int]] = []  # containers named as content
        self.classes: list[tuple] = []         # (class or id word, first, end)
        self._stack: list[tuple] = []
        self._open: dict[str, int] = {}
        self._names = names
        self._mains = self._outs = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, last = 0, source.rfind(">")
        while at < len(source):
            mark = source.find("<", at)
            if mark < 0 or mark > last:                                 # no tag ends from here on
                comment = source.find("<!--", at)
                self._text(source[at:comment] if comment >= 0 else source[at:])
                break
            tag = TAG.match(source, mark)
            if tag is None:
                self._text(source[at:mark + 1])
                at = mark + 1
                continue
            if mark > at:
                self._text(source[at:mark])
            at = tag.end()
            name = (tag[2] or "").lower()
            if not name:
                continue
            if tag[1]:
                self._close(name)
            else:
                self._start(name, tag[3])
                if name in RAW:
                    end = re.compile("</" + name + r"(?=[\s/>])[^>]*+>?", re.I).search(source, at)
                    at = end.end() if end else len(source)
                    self._pop()
                elif name == "plaintext":
                    self._text(source[at:])
                    break
        while self._stack:
            self._pop()

    def _text(self, text: str) -> None:
        if text:
            self.tokens.append((html.unescape(text) if "&" in text else text, None, self._open.get("a", 0) > 0))

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCKS and name != "br" and self._open.get("p"):          # a block ends the paragraph before it
            while self._pop() != "p":
                pass
        same = SAME.get(name)
        if same:
            while self._stack and (self._stack[-1][0] in same or (self._stack[-1][0] in PHRASES and any(self._open.get(s) for s in same))):
                if self._pop() == name:
                    break
        first = len(self.tokens)
        self.tokens.append((None, name, True))
        if name in VOID:
            return
        out, words = self._judge(name, attributes)
        self._stack.append((name, first, out, self._mains, words))
        self._open[name] = self._open.get(name, 0) + 1
        if out is not None:
            self._outs += 1
        elif name in MAIN and not self._outs:
            self._mains += 1

    def _judge(self, name: str, attributes: str) -> tuple[bool | None, list[str]]:
        """Whether the element is left out: True by its whole name, False by a part of it, None not at all."""
        inside_main = any(self._open.get(m) for m in MAIN)
        out = True if name in LEFT_OUT and not (name == "header" and inside_main) else None
        words: list[str] = []
        if attributes and name not in ("html", "body"):
            for key, *values in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), (values[0] or values[1] or values[2]).lower()
                if key == "role":
                    out = True if value.strip() in ROLES else out
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                    out = True
                elif key in ("class", "id"):
                    whole = value.split()
                    words += whole
                    for w in whole:
                        parts = SPLIT.split(w)
                        hit = [x for x in parts if x in NAMES and not (inside_main and x == "header")] or w in self._names
                        if hit and name not in PHRASES and (name not in MAIN or len(parts) == 1):
                            out = True if len(parts) == 1 and len(whole) == 1 and w in NAMES else out or False
        return (out and "form" if name == "form" else out), words

    def _pop(self) -> str:
        name, first, out, mains, words = self._stack.pop()
        self._open[name] -= 1
        end = len(self.tokens)
        if out is not None:
            self._outs -= 1
            if self._mains == mains:
                self.left_out.append((first, end, out is True))
        elif name in MAIN and not self._outs:
            self.main.append((first, end))
        elif words and not self._outs and name in ("div", "section", "td") and any(x in MAIN_NAMES for w in words for x in SPLIT.split(w)):
            self.like.append((first, end))
        self.classes.extend((w, first, end) for w in words)
        return name

    def _close(self, name: str) -> None:
        if self._open.get(name):
            while self._pop() != name:
                pass
        elif name in ("p", "br"):
            self.tokens.append((None, name, True))
            return
        self.tokens.append((None, name, False))

    def covered(self) -> list[bool]:
        """Tokens of left-out elements. One named in part only, or a form, that holds over half of the page's words stays."""
        words = [0]
        for text, *_ in self.tokens:
            words.append(words[-1] + (n_words(text) if text else 0))
        change = [0] * (len(self.tokens) + 1)
        for first, end, whole in self.left_out:
            if whole or 2 * (words[end] - words[first]) <= words[-1]:
                change[first] += 1
                change[end] -= 1
        depth, out = 0, []
        for c in change[:-1]:
            depth += c
            out.append(depth > 0)
        return out


def n_words(text: str) -> int:
    """Words of a text; scripts without spaces count every eight characters."""
    return max(len(text.split()), len(text) // 8 if not text.isspace() else 0)


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """First stretch [start, end) of the highest positive sum; (0, 0) if no score is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0.0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, found = total, (start, k + 1)
    return found


def extract(source: str, weights: Weights) -> str:
    """Main text of one page."""
    page = Page(source, weights.names)
    out = page.covered()
    scores = [0.0 if gone else n_words(text) * (weights.link if flag else weights.word) if text is not None else weights.tags.get(name, weights.tag)
              for (text, name, flag), gone in zip(page.tokens, out)]
    start, end = best_stretch(scores)
    if start == end:
        return ""
    marks = page.main or page.like
    around = [m for m in marks if m[0] <= start and end <= m[1]]
    if around:
        start, end = min(around, key=lambda m: m[1] - m[0])
    else:
        cut = [m for m in marks if m[0] < end and start < m[1]]
        start, end = min([start] + [m[0] for m in cut]), max([end] + [m[1] for m in cut])
    pieces = []
    for (text, name, _), gone in zip(page.tokens[start:end], out[start:end]):
        if text is not None:
            if not gone:
                pieces.append(text)
        elif name in BLOCKS:
            pieces.append(" ")
    return " ".join("".join(pieces).split())


def token_kinds(source: str) -> dict[str, tuple[int, int]]:
    """Tokens of a labelled page by kind, inside and outside of its main elements; empty without such an element."""
    page = Page(source)
    if not page.main:
        return {}
    change = [0] * (len(page.tokens) + 1)
    for first, end in page.main:
        change[first + 1] += 1
        change[end] -= 1
    inside, depth, found = [], 0, {}
    for c in change[:-1]:
        depth += c
        inside.append(depth > 0)

    def add(kind: str, n: int, within: bool) -> None:
        a, b = found.get(kind, (0, 0))
        found[kind] = (a + n, b) if within else (a, b + n)

    sizes = [0]
    for (text, name, flag), within, gone in zip(page.tokens, inside, page.covered()):
        n = n_words(text) if text is not None else 0
        sizes.append(sizes[-1] + n)
        if gone:
            continue
        if text is None:
            add("<" + name, 1, within)
        elif n:
            add("link" if flag else "word", n, within)
    for name, first, end in page.classes:
        if sizes[end] > sizes[first]:
            add("." + name, sizes[end] - sizes[first], inside[first])
    return found


def learn(counts: dict[str, tuple[int, int, int]]) -> Weights:
    """Weights from ``kind -> (pages, inside, outside)``."""
    out = Weights()
    total_in = sum(a for k, (_, a, _) in counts.items() if k[0] != ".") + SMOOTH
    total_out = sum(b for k, (_, _, b) in counts.items() if k[0] != ".") + SMOOTH
    names = set()
    for kind, (pages, a, b) in sorted(counts.items()):
        if pages < SUPPORT:
            continue
        value = math.log((a + SMOOTH) / total_in) - math.log((b + SMOOTH) / total_out)
        if kind == "word":
            out.word = min(MOST_WORD, max(LEAST_WORD, value))
        elif kind == "link":
            out.link = min(MOST_WORD, max(LEAST_WORD, value))
        elif kind[0] == "<":
            out.tags[kind[1:]] = max(LEAST_TAG, min(MOST_TAG, value))
        elif b >= OUTSIDE * (a + b):
            names.add(kind[1:])
    out.names = frozenset(names)
    return out


def fit(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: int = LABELLED) -> Weights:
    """Weights from about ``labelled`` pages, all of them if there are fewer."""
    n = pages.count()
    if not n:
        return Weights()
    grain = 1 << 40
    drawn = pages.where(F.pmod(F.xxhash64(F.col(id_col), F.col(url_col)), F.lit(grain)) < int(min(1.0, labelled / n) * grain)).select(F.col(html_col).cast("string").alias("html"))

    def build():
        def step(batch):
            found: dict[str, list[int]] = {}
            for source in column(batch, "html").to_pylist():
                for kind, (a, b) in token_kinds(source or "").items():
                    row = found.setdefault(kind, [0, 0, 0])
                    row[0], row[1], row[2] = row[0] + 1, row[1] + a, row[2] + b
            return {"kind": list(found), **{c: pa.array([r[k] for r in found.values()], pa.int64()) for k, c in enumerate(("pages", "within", "outside"))}}
        return step

    rows = (map_batches(drawn, build, "kind string, pages long, within long, outside long").groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("pages", "within", "outside")))
            .where(F.col("pages") >= SUPPORT).collect())          # kinds of the sample that SUPPORT of its pages hold
    return learn({r["kind"]: (r["pages"], r["within"], r["outside"]) for r in rows})


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: int = LABELLED) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page. No shuffle: pages are read where they lie."""
    weights = fit(pages, id_col, url_col, html_col, labelled)
    frame = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def build():
        def step(batch):
            found = [extract(source or "", weights) for source in column(batch, "html").to_pylist()]
            return {"page_id": column(batch, "page_id"), "url": column(batch, "url"), "text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())}
        return step

    return map_batches(frame, build, "page_id long, url string, text string, n_chars long", 500)
