from __future__ import annotations

import random
from urllib.parse import parse_qsl, urlencode, urljoin, urlparse

import pytest
from helpers import evaluate

from newsloom.functions import urls


def expected_normal(url):
    """What the standard library makes of a URL, tracking parameters and fragment removed."""
    if not url:
        return None
    try:
        parts = urlparse(url)
    except ValueError:
        return url
    if not parts.netloc:
        return None
    grouped: dict[str, list[str]] = {}
    for key, value in parse_qsl(parts.query):
        grouped.setdefault(key, []).append(value)
    kept = {k: v for k, v in grouped.items() if k not in urls.TRACKING_PARAMS}
    return parts._replace(query=urlencode(kept, doseq=True), fragment="").geturl()


def expected_resolved(ref, base):
    if not ref:
        return None
    try:
        relative = not urlparse(ref).netloc
        return expected_normal(urljoin(base, ref) if relative else ref)
    except ValueError:
        return ref


TABLE = [
    ("HTTP://A.com/x;", "http://A.com/x"),
    ("http://a.com/x;p?b=&a=1&c=2&a=3", "http://a.com/x;p?a=1&a=3&c=2"),
    ("http://a.com/?A=1&flag", "http://a.com/?A=1"),
    ("http://a.com/?a=1;b=2", "http://a.com/?a=1%3Bb%3D2"),
    ("http://a.com/?x=[1]&y=%zz&z=~*", "http://a.com/?x=%5B1%5D&y=%25zz&z=~%2A"),
    ("http://a.com/é?é=ü", "http://a.com/é?%C3%A9=%C3%BC"),
    ("//a.com/y#f", "//a.com/y"),
    ("/rel", None),
    ("data:image/png;base64,xx", None),
    ("http://[bad/x", "http://[bad/x"),
    (None, None),
    ("", None),
    ("http://a.com?x=1", "http://a.com?x=1"),
    ("  http://a.com/q", "http://a.com/q"),
    ("http://a.com/p?q#", "http://a.com/p"),
    ("http://a.com/a b|c?x=[1]", "http://a.com/a b|c?x=%5B1%5D"),
    ("http://a.com/x;;", "http://a.com/x;;"),
    ("http://a.com/\tx\ny", "http://a.com/xy"),
] + [(f"http://a.com/?k=1&{p}=z&j=2", "http://a.com/?k=1&j=2") for p in urls.TRACKING_PARAMS]


def test_normalize_table(spark):
    got = evaluate(spark, [u for u, _ in TABLE], urls.normalize_url)
    assert got == [want for _, want in TABLE]
    assert got == [expected_normal(u) for u, _ in TABLE]


def test_normalize_agrees_with_standard_library(spark):
    rng = random.Random(7)
    keys = ["a", "b", "A", "utm_source", "ref", "é", "x y", "", "%41", "a%20b", "source", "q+r", "~*"]
    values = ["", "1", "a b", "ü", "%zz", "%41", "a=b", "+", "x;y", "[1]", "~*-_.", "%e2%82%ac", "&amp", "%%41", "/?:@"]
    hosts = ["a.com", "www.A.com:80", "u:p@h.org", "", "x.example.net"]
    paths = ["", "/", "/a/b", "/a;", "/a;p", "/a;b/c;", "/a b", "/é", "/x;;"]
    cases = []
    for _ in range(1200):
        query = "&".join(
            rng.choice(keys) + rng.choice(["=", "", "="]) + rng.choice(values) for _ in range(rng.randint(0, 6))
        )
        url = rng.choice(["http:", "https:", "", "ftp:", "HTTP:", "foo:"]) + "//" + rng.choice(hosts) + rng.choice(paths)
        url += ("?" + query if query else "") + rng.choice(["", "#f", "#"])
        cases.append(url)
    got = evaluate(spark, cases, urls.normalize_url)
    wrong = [(c, g, expected_normal(c)) for c, g in zip(cases, got) if g != expected_normal(c)]
    assert wrong == []


def test_normalize_is_idempotent_on_web_urls(spark):
    cases = [u for u, want in TABLE if want and want.startswith("http") and "[bad" not in want]
    once = evaluate(spark, cases, urls.normalize_url)
    assert evaluate(spark, once, urls.normalize_url) == once


@pytest.mark.parametrize(
    "ref,want",
    [
        ("img.png", "http://a.com/x/img.png"),
        ("/img.png", "http://a.com/img.png"),
        ("../i.png", "http://a.com/i.png"),
        ("?q=1", "http://a.com/x/y?q=1"),
        ("//c.com/i.png", "//c.com/i.png"),
        ("data:image/png;base64,xx", None),
        ("mailto:a@b", None),
        ("", None),
    ],
)
def test_resolve_table(spark, ref, want):
    assert evaluate(spark, [(ref, "http://a.com/x/y")], urls.resolve_url) == [want]


def test_resolve_agrees_with_standard_library(spark):
    bases = [
        "http://a.com/x/y", "http://a.com", "https://a.com/", "http://a.com/x/y/?b=1", "http://a.com/x/../y?ref=z&k=1",
        "/nobase", "", "http://a.com/a//b/c",
    ]
    refs = [
        "i.png", "/i.png", "../i.png", "../../../i.png", "./i.png", ".", "..", "a/./b/../c", "?q=1", "#f", "//c.com/i",
        "http://d.com/i?utm_source=1&z=2", "https:rel", "http:rel.png", "mailto:x@y", "a//b", "/a//b/", "a/b/", "é.png",
        "i.png?x=1&x=2#t", "javascript:void(0)", "a b.png", "...", "/..", "/.", "x/..", "g?y/./x",
    ]
    cases = [(r, b) for b in bases for r in refs]
    got = evaluate(spark, cases, urls.resolve_url)
    wrong = [(c, g, expected_resolved(*c)) for c, g in zip(cases, got) if g != expected_resolved(*c)]
    assert wrong == []


def test_domains(spark):
    cases = ["http://www.a.com/x", "http://u:p@A.com:80/", "http://WWW.a.com", "/rel", None, ""]
    assert evaluate(spark, cases, urls.source_domain) == ["a.com", "u:p@A.com:80", "WWW.a.com", "", None, None]
    assert evaluate(spark, cases, urls.display_domain) == ["a.com", "a.com", "a.com", "Other", "Other", "Other"]


def test_url_list_keeps_first_seen_order(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [(["b.png", "a.png", "b.png?utm_source=x", "mailto:x@y", ""], "http://h.com/")], "refs array<string>, base string"
    )
    got = df.select(urls.resolve_urls(F.col("refs"), F.col("base")).alias("r")).first()["r"]
    assert got == ["http://h.com/b.png", "http://h.com/a.png"]


def test_url_lines(spark):
    assert evaluate(spark, [" http://a \n\n\thttp://b\r\n  "], urls.url_lines) == [["http://a", "http://b"]]
