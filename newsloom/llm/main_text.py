"""Main text of HTML pages: the maximum-scoring contiguous stretch of words and tags.

A page is read once as a sequence of tags and texts. What stands in menus, headers, footers, sidebars, notices, adverts,
forms, reader comments, scripts and styles, by element or by class, id and role, is set aside; a form or marked container
that holds the article, or most words of a page that declares none, stays. In what is left each word scores a positive and each tag a negative weight, learned from labelled pages; a linear scan finds the stretch of the
highest sum. Its texts, cut at block elements, are the main text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.shared import free_name, map_arrow

#: Labelled pages used for the weights, at most.
MAX_LABELLED = 2000

#: Elements that are set aside with all they hold.
FURNITURE = {
    "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu", "head", "title",
    "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "math",
}
#: Words of class, id and role that mark the same on containers, as a whole or as the main word of a compound.
FURNITURE_WORDS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "contentinfo",
    "sidebar", "complementary", "widget", "aside", "notice", "notices", "cookie", "cookies", "consent", "gdpr",
    "alert", "banner", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "share", "sharing", "social", "related", "recommended", "pagination", "pager", "toolbar", "search", "copyright",
    "form", "disclaimer",
}
COMMENT_WORDS = {"comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion"}
#: Elements that class, id and role may set aside.
CONTAINERS = {"article", "center", "dd", "details", "div", "dl", "fieldset", "figure", "form", "hgroup", "ol", "section", "table", "td", "ul"}
#: Words that say nothing at the end of a compound ("ad-slot"), and those that make it say something else ("has-sidebar").
PLAIN_WORDS = {
    "area", "articles", "bar", "block", "box", "buttons", "container", "content", "form", "inner", "items", "links", "list", "posts",
    "section", "slot", "thread", "unit", "wrap", "wrapper",
}
NOT_WORDS = {"has", "with", "without", "no", "is", "not", "hide", "hides", "show", "shows"}
#: Elements that end a block of text.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section",
    "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: White space between words, though no block ends here.
GAPS = {"br", "td", "th", "img", "input"}
#: Elements whose content is not markup.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")

#: Attributes: a quote opens a value only after ``=``, and in a quoted value ``>`` ends nothing.
_ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)*+"

_PIECE = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<!\[CDATA\[.*?\]\]>"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])" + _ATTRIBUTES + r">(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>" + _ATTRIBUTES + r")>"
    r"|<(?P<loose_end>/?)(?P<loose>[a-z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_MARKS = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"[a-z0-9]+")


@dataclass
class _Part:
    """A tag (``tag`` set) or a text."""

    tag: str = ""
    text: str = ""
    aside: int = 0  # how many elements around it are set aside
    link: bool = False
    article: int = -1


@dataclass
class _Element:
    name: str
    at: int
    aside: bool = False
    by_class: bool = False
    holds_article: bool = False
    holds_head: bool = False


@dataclass(frozen=True)
class Weights:
    """Scores of a word in running text and in a link, and of tags by name; all others score ``other``."""

    word: float = 1.0
    linked: float = 0.1
    other: float = -0.5
    tags: dict[str, float] = field(default_factory=dict)


def _main_word(token: str) -> str:
    """A furniture or comment word that a class, id or role says as a whole or as the main word of a compound, or nothing."""
    pieces = _WORD.findall(_CAMEL.sub(" ", token).lower())
    if len(pieces) > 1 and pieces[0] in NOT_WORDS:
        return ""
    while len(pieces) > 1 and pieces[-1] in PLAIN_WORDS:
        pieces.pop()
    return pieces[-1] if pieces and pieces[-1] in FURNITURE_WORDS | COMMENT_WORDS else ""


def _words_of(attributes: str, ids: bool) -> set[str]:
    """The main words of class and role, and of ids if wanted."""
    found = [(m[0].lower(), next((g for g in m[1:] if g), "")) for m in _MARKS.findall(attributes)]
    return {_main_word(x) for kind, value in found if ids or kind != "id" for x in value.split()} - {""}


def parts(page: str) -> list[_Part]:
    """Tags and texts of a page in order, with what is set aside marked, and the declared article each belongs to."""
    out: list[_Part] = []
    stack: list[_Element] = []
    closed: list[tuple[_Element, int, bool]] = []
    aside = links = 0
    article, articles = -1, 0
    article_depth = 0

    def close(element: _Element, ended: bool) -> None:
        nonlocal aside, links, article, article_depth
        if element.aside:
            closed.append((element, len(out), ended))
            aside -= 1
        if element.name == "a":
            links -= 1
        if element.name in ("article", "main"):
            article_depth -= 1
            if not article_depth:
                article = -1

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            out.append(_Part(text=html.unescape(raw), aside=aside, link=links > 0, article=article))
        elif raw:
            out.append(_Part(text=" ", aside=aside, link=links > 0, article=article))

    at = 0
    for m in _PIECE.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["loose"]
        if not name:
            continue
        name = name.lower()
        if m["end"] or m["loose_end"]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if place is not None:
                for element in reversed(stack[place:]):
                    close(element, True)
                del stack[place:]
            out.append(_Part(tag=name, aside=aside, article=article))
            continue
        # What a start tag ends by itself.
        if name == "body":
            ends = [i for i, e in enumerate(stack) if e.name == "head"]
        elif name in ("p", "li", "option", "tr", "td", "th", "dt", "dd"):
            within = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(name, ("dl", "select", "div", "td", "section", "article", "aside", "blockquote", "li"))
            low = max((i for i, e in enumerate(stack) if e.name in within), default=-1)
            ends = [i for i, e in enumerate(stack) if i > low and e.name == name]
        else:
            ends = []
        if ends:
            for element in reversed(stack[ends[0] :]):
                close(element, True)
            del stack[ends[0] :]
        out.append(_Part(tag=name, aside=aside, article=article))
        if name in VOID or (m["attributes"] or "").rstrip().endswith("/") and name in ("svg",):
            continue
        element = _Element(name, len(out) - 1)
        if name in ("article", "main", "h1"):
            for e in stack:
                e.holds_head = True
                e.holds_article |= name != "h1"
        # Within an article an id is an anchor, and a discussion is the author's.
        marks = _words_of(m["attributes"] or m["rest"] or "", not article_depth) if name in CONTAINERS else set()
        comment = bool(marks & COMMENT_WORDS - ({"discussion"} if article_depth else set()))
        by_class = bool(marks & FURNITURE_WORDS) and name != "article"
        element.aside = name in FURNITURE or comment or by_class
        element.by_class = by_class and not comment and name not in FURNITURE
        if name in ("article", "main"):
            if not article_depth and not element.aside and aside == sum(e.aside and e.name == "form" for e in stack):
                article, articles = articles, articles + 1
            article_depth += 1
        aside += element.aside
        links += name == "a"
        stack.append(element)
    text(page[at:])
    for element in reversed(stack):
        close(element, False)

    def stays(element: _Element, end: int) -> None:
        """Take the element's own mark off what it holds, and no other."""
        for part in out[element.at + 1 : end]:
            part.aside -= 1

    left = []
    for element, end, ended in closed:  # inner ones first
        if element.holds_head and (element.by_class or not ended) or element.holds_article and element.name == "form":
            stays(element, end)
        elif element.by_class or element.name == "form":
            left.append((element, end))
    if left and _declared(out) < 0:
        n = [len(part.text.split()) for part in out]
        for element, end in left:
            held = range(element.at + 1, end)
            level = out[element.at].aside + 1
            if 2 * sum(n[i] for i in held if out[i].aside == level) > sum(n):
                stays(element, end)
    return out


def _declared(found: list[_Part]) -> int:
    """The declared article with the most words, or -1."""
    words: Counter[int] = Counter()
    for part in found:
        if part.article >= 0 and not part.aside and part.text:
            words[part.article] += len(part.text.split())
    return max(words, key=lambda k: (words[k], -k)) if any(words.values()) else -1


def region(found: list[_Part], weights: Weights) -> tuple[int, int]:
    """The stretch of the highest sum; of equal ones the first and longest. Empty if no word scores."""
    chosen = _declared(found)
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for at, part in enumerate(found):
        if part.aside:
            continue
        inside = chosen < 0 or part.article == chosen
        if part.tag:
            score = weights.tags.get(part.tag, weights.other) * (0.1 if chosen >= 0 and inside else 1.0)
        else:
            n = len(part.text.split())
            score = n * (weights.word if not part.link or (chosen >= 0 and inside) else weights.linked)
            if not inside:
                score = -n * weights.word - weights.word
        if total <= 0:
            total, begin = 0.0, at
        total += score
        if total > best + 1e-12:
            best, span = total, (begin, at + 1)
    return span


def whole_blocks(found: list[_Part], span: tuple[int, int]) -> tuple[int, int]:
    """The stretch together with the rest of the blocks at its ends, which tags inside a line may have cut off."""
    begin, end = span
    if begin == end:
        return span
    while begin > 0 and found[begin].tag not in BLOCKS and found[begin - 1].tag not in BLOCKS:
        begin -= 1
    while end < len(found) and found[end].tag not in BLOCKS and found[end - 1].tag not in BLOCKS:
        end += 1
    return begin, end


def main_text(page: str | None, weights: Weights) -> str:
    """The main text of a page: its blocks in order, one to a line. Null, empty and wordless pages give an empty text."""
    found = parts(page or "")
    begin, end = whole_blocks(found, region(found, weights))
    blocks, held = [], []

    def flush() -> None:
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            blocks.append(line)

    for part in found[begin:end]:
        if part.tag:
            if part.tag in BLOCKS:
                flush()
            elif part.tag in GAPS and not part.aside:
                held.append(" ")
        elif not part.aside:
            held.append(part.text)
    flush()
    return "\n".join(blocks)


def counts(page: str | None) -> dict[str, tuple[int, int]]:
    """For a page that declares its article: how often each tag, plain word and linked word is inside and outside it."""
    found = parts(page or "")
    chosen = _declared(found)
    out: Counter[tuple[str, bool]] = Counter()
    if chosen < 0:
        return {}
    for part in found:
        inside = part.article == chosen and not part.aside
        if part.tag:
            out[part.tag, inside] += 1
        else:
            out["#linked" if part.link else "#word", inside] += len(part.text.split())
    return {k: (out[k, True], out[k, False]) for k in {k for k, _ in out}}


def fit(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> Weights:
    """Weights from at most ``MAX_LABELLED`` pages (in the order of a hash of their ids) that declare their article.

    A word weighs the logarithm of its odds of being inside, a tag that of its odds of being outside, both held within
    bounds that keep words positive and tags negative. Without labelled pages the bounds' middle is used.
    """
    labelled = pages.where(F.contains(F.lower(html_column), F.lit("<article"))).select(id_column)
    ids = labelled.orderBy(F.xxhash64(id_column), id_column).limit(MAX_LABELLED).distinct()
    chosen = pages.select(F.col(id_column).alias("id"), F.col(html_column).alias("html")).join(
        F.broadcast(ids.withColumnRenamed(id_column, "id")), "id", "left_semi"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[tuple[str, int]] = Counter()
            for page in batch.column(0).to_pylist():
                for k, (a, b) in counts(page).items():
                    total[k, 0] += a
                    total[k, 1] += b
            names = sorted({k for k, _ in total})
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string())] + [pa.array([total[k, i] for k in names], pa.int64()) for i in (0, 1)],
                ["name", "inside", "outside"],
            )

    rows = (
        map_arrow(chosen.select("html"), run, "name string, inside long, outside long")
        .groupBy("name")
        .agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
        .collect()
    )
    seen = {r["name"]: (r["i"], r["o"]) for r in rows}
    if not seen:
        return Weights()
    odds = lambda k: math.log((seen.get(k, (0, 0))[0] + 1) / (seen.get(k, (0, 0))[1] + 1))
    bound = lambda x, lo, hi: min(max(x, lo), hi)
    word, linked = bound(odds("#word"), 0.5, 2.0), bound(odds("#linked"), 0.05, 0.5)
    tags = {k: -bound(-odds(k), 0.1, 2.0) for k in seen if k[0] != "#"}
    return Weights(word, linked, -0.5, tags)


def extract(pages: DataFrame, weights: Weights, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Add ``main_text`` to the id: one row per row of ``pages``.

    A null page has an empty text; long pages are read whole. Repeated rows give repeated rows, an empty table none. Only the
    two columns are read; an id called ``main_text`` becomes ``main_text_``.
    """
    named = free_name(id_column, ["main_text"])
    kind = pages.schema[id_column].dataType
    schema = T.StructType([T.StructField(named, kind), T.StructField("main_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(p, weights) for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [named, "main_text"])

    return map_arrow(pages.select(F.col(id_column), F.col(html_column).cast("string")), run, schema)
