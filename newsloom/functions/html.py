"""HTML functions: regular expressions and array functions over one page's source, no parser and no UDF."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.functions.text import strip

# Elements that never hold article text.
NOISE_TAGS = ["script", "style", "iframe", "nav", "footer", "header", "aside"]
# Elements that hold code, not text.
CODE_TAGS = ["script", "style", "template", "noscript"]
# Elements whose contents are not read as markup.
FLAT_TAGS = [*CODE_TAGS, "iframe"]
# Places to look for the article body, most specific first.
CONTENT_SELECTORS = [
    "article",
    '[role="article"]',
    ".post-content",
    ".article-content",
    ".entry-content",
    ".content",
    "main",
]
# Meta elements holding the publication date, in order.
DATE_METAS = [
    ("property", "article:published_time"),
    ("name", "publication_date"),
    ("name", "date"),
    ("name", "pubdate"),
]
# Link relations and meta elements holding a site logo, in order.
LOGO_RELS = ["icon", "shortcut icon", "apple-touch-icon"]
LOGO_METAS = [("property", "og:image"), ("name", "twitter:image")]
# Three-letter codes of languages and their two-letter ones.
SHORT_CODES = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl",
    "dut": "nl", "rus": "ru", "zho": "zh", "chi": "zh", "jpn": "ja", "kor": "ko", "ara": "ar", "pol": "pl", "tur": "tr",
}
# Elements that start a new block of text.
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head"
    "|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
)

# Attributes, in whose quoted values ``>`` ends nothing. A quote opens a value only after ``=``: elsewhere it is a character.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)*+"""

#: What follows the name in an opening tag: nothing, or attributes.
REST = rf"(?:[\s/]{_ATTRIBUTES})?>"

#: Any tag; what only looks like one ends at the next ``>``.
TAG = rf"(?s)</?[A-Za-z]{_ATTRIBUTES}>|<[^>]*>"

_CUT = "\u0001"
_ENTITIES = json.dumps({"apos": "'", **{n: chr(c) for n, c in sorted(name2codepoint.items()) if n != "amp"}})


def remove_elements(html: Column, tags: list[str]) -> Column:
    """Drop elements with their contents. One pass per name, as a shared pattern would need a back-reference.

    Code elements hold no markup and end at their first closing tag. Of others, which may nest, the depth is followed.
    """
    for tag in tags:
        flat = rf"(?is)<{tag}{REST}.*?</{tag}\s*>"
        html = F.regexp_replace(html, flat, "") if tag in FLAT_TAGS else _without_nested(html, tag)
    return html


def _without_nested(html: Column, tag: str) -> Column:
    """The page without the elements of a name. An element that is never closed is left as it is."""

    def cut(pieces: Column) -> Column:
        opens, closes = F.lit(rf"(?is)^<{tag}{REST}"), F.lit(rf"(?is)^</{tag}\s*>")

        def step(at: Column, piece: Column) -> Column:
            opened, closed = F.rlike(piece, opens), F.rlike(piece, closes)
            depth = at["depth"] + F.when(opened, 1).when(closed & (at["depth"] > 0), -1).otherwise(0)
            ended = closed & (at["depth"] == 1)
            kept = F.when(ended, F.regexp_replace(piece, closes, F.lit(""))).when(depth == 0, piece)
            return F.struct(
                depth.alias("depth"),
                # What an element holds is put back if its end never comes.
                F.when(depth == 0, F.concat(at["out"], F.array(F.coalesce(kept, F.lit(""))))).otherwise(at["out"]).alias("out"),
                F.when(depth == 0, F.array().cast("array<string>")).otherwise(F.concat(at["held"], F.array(piece))).alias("held"),
            )

        start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"))
        walk = F.aggregate(pieces, start, step)
        return let(walk, lambda w: F.array_join(F.concat(w["out"], w["held"]), ""))

    # An opening tag that is followed by another one before any closing tag of the name.
    nested = rf"(?is)<{tag}[\s/>](?:[^<]++|<(?!/?{tag}[\s/>]))*+<{tag}[\s/>]"

    def without(page: Column) -> Column:
        pieces = F.split(page, rf"(?i)(?=</?{tag}[\s/>])")
        flat = F.regexp_replace(page, rf"(?is)<{tag}{REST}.*?</{tag}\s*>", "")
        return F.when(F.rlike(page, F.lit(nested)), let(pieces, cut)).otherwise(flat)

    # Bound: each of the steps mentions its input several times, and they are nested.
    return let(html, without)


def clean_html(html: Column) -> Column:
    """The page without scripts, styles, frames and page furniture."""
    return remove_elements(html, NOISE_TAGS)


def remove_comments(html: Column) -> Column:
    return F.regexp_replace(html, "(?s)<!--.*?-->", "")


def remove_code(html: Column) -> Column:
    """The page without comments and without elements whose contents are code."""
    return remove_elements(remove_comments(html), CODE_TAGS)


def decode_entities(text: Column) -> Column:
    """Named and numeric character references; the ampersand comes last so that nothing is decoded twice."""
    # One foldable expression instead of a literal per entity keeps plans small.
    table = F.from_json(F.lit(_ENTITIES), "map<string,string>")

    def put(out: Column, ref: Column) -> Column:
        char = F.when(ref.startswith("#"), _character(F.substring(ref, 2, 8))).otherwise(F.try_element_at(table, ref))
        return F.coalesce(F.replace(out, F.concat(F.lit("&"), ref, F.lit(";")), char), out)

    def decoded(raw: Column) -> Column:
        refs = F.regexp_extract_all(raw, F.lit("&([A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"), F.lit(1))
        kept = F.filter(F.array_distinct(refs), lambda ref: ~ref.isin("amp", "#38", "#x26", "#X26"))
        full = F.regexp_replace(F.aggregate(kept, raw, put), "&(?:amp|#38|#[xX]26);", "&")
        return F.when(raw.contains("&"), full).otherwise(raw)

    return let(text, decoded)


def _character(code: Column) -> Column:
    value = F.when(
        F.lower(F.substring(code, 1, 1)) == "x", F.conv(F.substring(code, 2, 10), 16, 10).cast("bigint")
    ).otherwise(code.try_cast("bigint"))
    usable = value.between(1, 0xD7FF) | value.between(0xE000, 0x10FFFF)
    hexed = F.lpad(F.hex(F.when(usable, value).otherwise(F.lit(0xFFFD))), 8, "0")
    return F.decode(F.unhex(hexed), "UTF-32")


def text_nodes(html: Column) -> Column:
    """Text between tags, nodes separated by blank lines, references decoded. Comments and code are left out."""
    return decode_entities(F.regexp_replace(remove_code(html), TAG, "\n\n"))


def rendered_text(html: Column) -> Column:
    """Text as a reader sees it: blocks and line breaks start a line, inline elements leave no gap."""
    broken = F.regexp_replace(remove_code(html), rf"(?is)</?(?:{BLOCK_TAGS}|br){REST}", "\n")
    bare = F.regexp_replace(F.regexp_replace(broken, TAG, ""), "[ \t\r]+", " ")
    return strip(F.regexp_replace(decode_entities(bare), " ?\n[ \n]*", "\n"))


def title(html: Column) -> Column:
    return strip(decode_entities(F.regexp_extract(remove_comments(html), rf"(?is)<title{REST}(.*?)</title>", 1)))


def declared_language(html: Column) -> Column:
    """Language the page declares for itself, by the primary part of its code; empty if none.

    Three-letter codes of languages that have one of two letters are given as those.
    """
    found = F.lower(F.regexp_extract(remove_comments(html), r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z]{2,3})(?![A-Za-z])""", 1))
    short = F.create_map(*[F.lit(x) for pair in SHORT_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(short, found), found)


def _raw_attribute(tag: Column, name: str) -> Column:
    """Value of an attribute as it is written in the source of one tag, without its quotes; empty if absent."""
    written = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^"'\s>][^\s>]*)""", 1)
    return F.regexp_replace(written, r"""(?s)^(["'])(.*)\1$""", "$2")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in the source of one tag; empty if absent."""
    return decode_entities(_raw_attribute(tag, name))


def tags(html: Column, name: str) -> Column:
    """Source of every opening tag of a kind, in page order. Tags written inside comments or scripts do not count."""
    return F.regexp_extract_all(remove_code(html), F.lit(rf"(?is)(<{name}{REST})"), F.lit(1))


def _attributes(html: Column, tag: str, *names: str) -> Column:
    """One struct of raw attribute values per opening tag of a kind."""
    return F.transform(tags(html, tag), lambda t: F.struct(*[_raw_attribute(t, n).alias(n) for n in names]))


def _decoded(values: Column) -> Column:
    return F.transform(F.filter(values, lambda v: v != ""), decode_entities)


def links(html: Column) -> Column:
    """Targets of all anchors in page order."""
    return _decoded(F.transform(tags(html, "a"), lambda t: _raw_attribute(t, "href")))


def images(html: Column) -> Column:
    """Sources of all images in page order."""
    return _decoded(F.transform(tags(html, "img"), lambda t: _raw_attribute(t, "src")))


def large_images(html: Column, min_side: int = 100) -> Column:
    """Sources of the images declared larger than ``min_side`` in both directions."""
    pixels = lambda v: F.coalesce(F.regexp_extract(v, r"^\s*(\d{1,9})", 1).try_cast("int"), F.lit(0))
    big = F.filter(
        _attributes(html, "img", "src", "width", "height"),
        lambda img: (pixels(img["width"]) > min_side) & (pixels(img["height"]) > min_side),
    )
    return _decoded(F.transform(big, lambda img: img["src"]))


def _first_where(found: Column, key: str, value: str, take: str) -> Column:
    """Attribute ``take`` of the first entry whose ``key`` is ``value``; null if absent or empty."""
    hits = F.filter(found, lambda entry: F.lower(entry[key]) == value)
    return F.nullif(F.try_element_at(hits, F.lit(1))[take], F.lit(""))


def publication_date(html: Column) -> Column:
    """Publication date as the page gives it, null if it gives none.

    In this order: the known meta elements, the first ``time`` element that has one, ``datePublished`` in JSON-LD, and
    an element of that ``itemprop``.
    """
    in_metas = let(
        _attributes(html, "meta", "property", "name", "content"),
        lambda metas: F.coalesce(*[_first_where(metas, key, value, "content") for key, value in DATE_METAS]),
    )
    times = F.filter(F.transform(tags(html, "time"), lambda t: _raw_attribute(t, "datetime")), lambda at: at != "")
    structured = F.when(F.contains(html, F.lit("datePublished")), F.coalesce(_date_in_json(html), _date_in_item(html)))
    return decode_entities(F.coalesce(in_metas, F.try_element_at(times, F.lit(1)), structured))


def _date_in_json(html: Column) -> Column:
    scripts = rf"""(?is)<script(?=[^>]*application/ld\+json){REST}(.*?)</script"""
    text = F.array_join(F.regexp_extract_all(html, F.lit(scripts), F.lit(1)), "\n")
    return F.nullif(F.regexp_extract(text, r'"datePublished"\s*:\s*"([^"\\]+)"', 1), F.lit(""))


def _date_in_item(html: Column) -> Column:
    found = F.regexp_extract_all(remove_code(html), F.lit(r"""(?is)(<[a-z][^\s>]*\s(?=[^>]*\bitemprop\s*=\s*["']?datePublished\b)[^>]*>)"""), F.lit(1))
    dates = F.transform(found, lambda t: F.coalesce(F.nullif(_raw_attribute(t, "content"), F.lit("")), _raw_attribute(t, "datetime")))
    return F.try_element_at(F.filter(dates, lambda d: d != ""), F.lit(1))


def logo(html: Column) -> Column:
    """Icon link or preview image of the page, as written; null if none."""
    in_links = let(
        _attributes(html, "link", "rel", "href"),
        lambda found: F.coalesce(*[_first_where(found, "rel", rel, "href") for rel in LOGO_RELS]),
    )
    in_metas = let(
        _attributes(html, "meta", "property", "name", "content"),
        lambda metas: F.coalesce(*[_first_where(metas, key, value, "content") for key, value in LOGO_METAS]),
    )
    return decode_entities(F.coalesce(in_links, in_metas))


def _opening_pattern(selector: str) -> str:
    if selector.startswith("."):
        name = selector[1:]
        return rf"""(?is)<([a-z][a-z0-9]*)\b[^>]*\sclass\s*=\s*["']?(?:[^"'>]*\s)?{name}(?=[\s"'>])[^>]*>"""
    if selector.startswith("["):
        key, value = selector[1:-1].replace('"', "").split("=")
        return rf"""(?is)<([a-z][a-z0-9]*)\b[^>]*\s{key}\s*=\s*["']?{value}(?=[\s"'>])[^>]*>"""
    return rf"(?is)<({selector}){REST}"


def element_inner(html: Column, pattern: Column) -> Column:
    """Inner source of the first element whose opening tag matches; null if there is none.

    The first group of ``pattern`` is the element's name. Elements of the same name may nest: the source after the
    opening tag is cut at every tag of that name and the depth is followed until it returns to zero. An element that is
    never closed reaches to the end of the page.
    """

    def inner(hit: Column) -> Column:
        pieces = F.split(hit["rest"], F.concat(F.lit("(?i)(?=</?"), hit["name"], F.lit("[\\s/>])")))
        cut = let(pieces, lambda p: F.array_join(F.slice(p, 1, _pieces_inside(p, hit["name"])), ""))
        return F.when(hit["rest"].isNotNull(), cut)

    found = F.struct(
        F.lower(F.call_function("regexp_extract", html, pattern, F.lit(1))).alias("name"),
        F.try_element_at(F.split(html, pattern, 2), F.lit(2)).alias("rest"),
    )
    return let(found.cast("struct<name:string,rest:string>"), inner)


def _pieces_inside(pieces: Column, name: Column) -> Column:
    """How many of the pieces lie before the closing tag of the element they follow."""

    def step(at: Column, piece: Column) -> Column:
        start = F.lower(F.substring(piece, 1, 64))
        # Pieces begin at tags of exactly this name.
        change = (
            F.when(start.startswith(F.concat(F.lit("</"), name)), -1)
            .when(start.startswith(F.concat(F.lit("<"), name)), 1)
            .otherwise(0)
        )
        depth = at["depth"] + change
        moved = F.struct(depth.alias("depth"), (at["kept"] + F.when(depth == 0, 0).otherwise(1)).alias("kept"))
        return F.when(at["depth"] == 0, at).otherwise(moved)

    walk = F.aggregate(pieces, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("kept")), step)
    return walk["kept"]


def main_block(html: Column) -> Column:
    """Source of the article element found by the first selector that matches, else of the body."""
    patterns = F.array(*[F.lit(_opening_pattern(selector)) for selector in CONTENT_SELECTORS])

    def search(page: Column) -> Column:
        found = F.aggregate(
            patterns,
            F.lit(None).cast("string"),
            lambda hit, pattern: F.when(hit.isNotNull(), hit).otherwise(element_inner(page, pattern)),
        )
        return F.coalesce(found, body(page))

    return let(remove_code(html), search)


def body(html: Column) -> Column:
    """Source after the opening ``body`` tag; the page without its head if there is no such tag."""
    inside = F.nullif(F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)", 1), F.lit(""))
    return F.coalesce(inside, F.regexp_replace(html, r"(?is)<head\b.*?</head\s*>", ""))


def text_blocks(html: Column, max_link_share: float = 0.5) -> Column:
    """Running text of a page: blocks, however short, that are no heading and consist mostly of unlinked text.

    Character references stay as written, so that they can be decoded once for all blocks.
    """
    bare = let(remove_code(clean_html(html)), body)
    marked = F.regexp_replace(bare, rf"(?is)(</?(?:{BLOCK_TAGS}){REST})", f"{_CUT}$1")
    scored = F.transform(
        F.split(marked, _CUT),
        lambda block: F.struct(
            _one_line(block).alias("text"),
            _one_line(
                F.array_join(F.regexp_extract_all(block, F.lit(rf"(?is)<a{REST}(.*?)</a\s*>"), F.lit(1)), " ")
            ).alias("linked"),
            block.rlike(r"(?is)^<h[1-6]\b").alias("heading"),
        ),
    )
    kept = F.filter(
        scored.cast("array<struct<text:string,linked:string,heading:boolean>>"),
        lambda block: ~block["heading"]
        & (F.length(block["text"]) > 0)
        & (F.length(block["linked"]) <= F.length(block["text"]) * max_link_share),
    )
    return F.transform(kept, lambda block: block["text"])


def _one_line(block: Column) -> Column:
    """Text of one block on one line, references as written."""
    bare = F.regexp_replace(F.regexp_replace(block, rf"(?is)<br{REST}", " "), TAG, "")
    return strip(F.regexp_replace(bare, "[ \t\r\n]+", " "))
