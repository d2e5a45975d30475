"""URL functions with the semantics of Python's ``urllib.parse``, as column expressions.

Spark's ``parse_url`` follows the strict Java URI grammar and rejects many real links, so URLs are split with the
regular expression of RFC 3986 appendix B instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.binding import let

# Query parameters that only track the reader.
TRACKING_PARAMS = [
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "fbclid",
    "gclid",
    "msclkid",
    "ref",
    "source",
    "referrer",
    "mc_cid",
    "mc_eid",
]

# Schemes whose last path segment may carry ``;params``, and schemes that allow relative references.
PARAM_SCHEMES = ["", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "sip", "sips", "mms", "sftp", "tel"]
RELATIVE_SCHEMES = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps",
    "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]

_PARTS = "struct<raw:string,scheme:string,netloc:string,path:string,query:string>"
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _tidy(url: Column) -> Column:
    """Drop what URL parsers ignore: leading controls and spaces, and any tab or line break."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def split_url(url: Column) -> Column:
    """Struct of the URL as given (``raw``), scheme (lower case), netloc, path and query; absent parts are empty."""

    def parts(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text["clean"], _SPLIT, i)
        return F.struct(
            text["raw"].alias("raw"),
            F.lower(part(1)).alias("scheme"),
            part(2).alias("netloc"),
            part(3).alias("path"),
            part(4).alias("query"),
        )

    both = let(url, lambda raw: F.struct(raw.alias("raw"), _tidy(raw).alias("clean")), "struct<raw:string,clean:string>")
    return let(both, parts, _PARTS)


def _netloc(url: Column) -> Column:
    return F.regexp_extract(_tidy(url), _SPLIT, 2)


def _decode(text: Column) -> Column:
    """Percent-decode, keeping a malformed ``%`` as it is."""
    return F.try_url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _clean_query(query: Column) -> Column:
    """Parse, drop blank and tracking parameters, gather repeated keys at their first place, encode again."""
    items = F.filter(F.split(query, "&"), lambda item: item.rlike("(?s)=."))
    pairs = F.filter(
        F.transform(
            items,
            lambda item: F.struct(
                _decode(F.substring_index(item, "=", 1)).alias("key"),
                _decode(F.regexp_replace(item, "(?s)^[^=]*=", "")).alias("value"),
            ),
        ),
        lambda pair: ~pair["key"].isin(TRACKING_PARAMS),
    )
    return let(pairs.cast("array<struct<key:string,value:string>>"), _encode_pairs)


def _encode_pairs(pairs: Column) -> Column:
    def encoded(pair: Column) -> Column:
        return F.concat(_encode(pair["key"]), F.lit("="), _encode(pair["value"]))

    keys = F.array_distinct(F.transform(pairs, lambda pair: pair["key"]))
    grouped = F.flatten(F.transform(keys, lambda key: F.filter(pairs, lambda pair: pair["key"] == key)))
    ordered = F.when(F.size(keys) == F.size(pairs), pairs).otherwise(grouped)
    return F.array_join(F.transform(ordered, encoded), "&")


def _unbalanced_brackets(netloc: Column) -> Column:
    return netloc.contains("[") != netloc.contains("]")


def _canonical(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    bare_path = F.when(
        scheme.isin(PARAM_SCHEMES), F.regexp_replace(path, r"(?s)^((?:.*/)?[^/;]*);$", "$1")
    ).otherwise(path)
    return F.concat(
        F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":"))),
        F.lit("//"),
        netloc,
        bare_path,
        F.when(query == "", F.lit("")).otherwise(
            let(_clean_query(query), lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
        ),
    )


def is_valid_url(url: Column) -> Column:
    """True if the URL names a host; null and empty input is invalid."""
    return F.coalesce(_netloc(url) != "", F.lit(False))


def normalize_url(url: Column) -> Column:
    """Canonical URL without tracking parameters and fragment; null if the URL names no host."""
    return let(
        split_url(url),
        lambda p: F.when(p["netloc"] == "", F.lit(None))
        .when(_unbalanced_brackets(p["netloc"]), p["raw"])
        .otherwise(_canonical(p["scheme"], p["netloc"], p["path"], p["query"])),
    )


def _join_path(base_path: Column, ref_path: Column) -> Column:
    """Path of a reference seen from a base path, with dot segments folded."""

    def base_dir(segments: Column) -> Column:
        return F.when(F.element_at(segments, -1) == "", segments).otherwise(
            F.slice(segments, 1, F.size(segments) - 1)
        )

    def without_inner_blanks(segments: Column) -> Column:
        return F.filter(segments, lambda seg, i: (seg != "") | (i == 0) | (i == F.size(segments) - 1))

    def fold(segments: Column) -> Column:
        folded = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda done, seg: F.when(seg == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(seg == ".", done)
            .otherwise(F.concat(done, F.array(seg))),
        )
        closing = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit("")))
        return F.array_join(F.concat(folded, F.coalesce(closing, F.array().cast("array<string>"))), "/")

    ref_segments = F.split(ref_path, "/")
    segments = F.when(ref_path.startswith("/"), ref_segments).otherwise(
        let(
            F.concat(let(F.split(base_path, "/"), base_dir, "array<string>"), ref_segments),
            without_inner_blanks,
            "array<string>",
        )
    )
    return let(
        let(segments, fold),
        lambda path: F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)),
    )


def _target(link: Column, page: Column) -> Column:
    """The parts a link leads to, seen from its page."""
    no_path = link["path"] == ""
    on_page = F.struct(
        page["scheme"].alias("scheme"),
        page["netloc"].alias("netloc"),
        F.when(no_path, page["path"]).otherwise(_join_path(page["path"], link["path"])).alias("path"),
        F.when(no_path & (link["query"] == ""), page["query"]).otherwise(link["query"]).alias("query"),
    )
    unusable = (
        (page["netloc"] == "")
        | ((link["scheme"] != "") & (link["scheme"] != page["scheme"]))
        | ~page["scheme"].isin(RELATIVE_SCHEMES)
        | _unbalanced_brackets(page["netloc"])
    )
    own = F.struct(*[link[name].alias(name) for name in ("scheme", "netloc", "path", "query")])
    chosen = F.when(link["raw"] == "", F.lit(None)).when(link["netloc"] != "", own).when(~unusable, on_page)
    return chosen.cast("struct<scheme:string,netloc:string,path:string,query:string>")


def _resolve(link: Column, page: Column) -> Column:
    canonical = let(_target(link, page), lambda t: _canonical(t["scheme"], t["netloc"], t["path"], t["query"]))
    return F.when(_unbalanced_brackets(link["netloc"]), link["raw"]).otherwise(canonical)


def resolve_url(ref: Column, base: Column) -> Column:
    """Absolute, canonical form of a link found on page ``base``; null where no web address comes out.

    A link with its own host is only canonicalised, so ``//host/x`` stays without a scheme.
    """
    both = F.struct(split_url(ref).alias("link"), split_url(base).alias("page"))
    return let(both.cast(f"struct<link:{_PARTS},page:{_PARTS}>"), lambda b: _resolve(b["link"], b["page"]))


def resolve_urls(refs: Column, base: Column) -> Column:
    """Resolve a list of links: unusable ones dropped, duplicates removed, first-seen order kept."""
    resolved = let(
        split_url(base),
        lambda page: F.transform(F.transform(refs, split_url), lambda link: _resolve(link, page)),
        "array<string>",
    )
    return F.array_distinct(F.filter(resolved, lambda url: url.isNotNull()))


def source_domain(url: Column) -> Column:
    """Network location without a leading ``www.``; empty if there is none, null for empty input."""
    netloc = _netloc(url)
    return F.when(url == "", F.lit(None)).otherwise(F.regexp_replace(netloc, r"^www\.", ""))


def display_domain(url: Column) -> Column:
    """Lower-case host name for grouping in a listing, without the first ``www.``; ``Other`` if there is none."""
    netloc = _netloc(url)
    host = F.lower(F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":\d*$", ""))
    bare = F.regexp_replace(host, r"^(.*?)www\.", "$1")
    return F.when(F.coalesce(host, F.lit("")) == "", F.lit("Other")).otherwise(bare)


def article_id(url: Column) -> Column:
    return F.md5(url)


def url_lines(text: Column) -> Column:
    """The URLs of a newline-separated text, trimmed, blank lines removed."""
    trimmed = F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda line: line != "")


def date_in_path(url: Column) -> Column:
    """The day in a path like ``/2024/06/01/``, as ``2024-06-01``; null if there is none."""
    pattern = r"^[^?#]*?/((?:19|20)\d\d)[/-](0?[1-9]|1[0-2])[/-](0?[1-9]|[12]\d|3[01])(?=[/?#-]|$)"
    parts = [F.lpad(F.regexp_extract(url, pattern, i), n, "0") for i, n in ((1, 4), (2, 2), (3, 2))]
    return F.when(F.rlike(url, F.lit(pattern)), F.concat_ws("-", *parts))
