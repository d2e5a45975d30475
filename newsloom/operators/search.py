"""Text search over articles, with and without a prebuilt index of postings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import ACCENTED, PLAIN, fold, words
from newsloom.operators.terms import STOP

#: Rows of a sorted page and all before it, at most, before matches are counted by ranges.
MOST_SORTED = 10_000
#: Characters of an id that make a range: ids are hexadecimal digests, so there are 4,096 ranges of three.
ID_BEGINNING = 3

#: Fields a search looks at (fixed values).
FIELDS = ["title", "content", "summary", "keywords"]


@dataclass
class Query:
    """What a search text asks for: any of ``terms``, all ``phrases``, and none of what is negated."""

    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    without_terms: list[str] = field(default_factory=list)
    without_phrases: list[str] = field(default_factory=list)


def _fold(text: str) -> str:
    return text.lower().translate(str.maketrans(ACCENTED, PLAIN))


def read_query(q: str) -> Query:
    """Quoted phrases are required, a leading minus excludes, other words are alternatives; stop words say nothing."""
    if not q:
        raise ValueError("nothing to search for")
    asked = Query()
    for minus, phrase, word in re.findall(r'(?<!\S)(-?)"([^"]+)"|(\S+)', q):
        negated = minus == "-" or (not phrase and word.startswith("-"))
        if phrase:
            (asked.without_phrases if negated else asked.phrases).append(_fold(phrase))
        found = [w for w in re.findall(r"[^\W_]+", _fold(phrase or word)) if w not in STOP]
        if not negated:
            asked.terms.extend(found)
        elif not phrase:
            asked.without_terms.extend(found)
    return asked


def searchable(df: DataFrame, fields: list[str]) -> list[tuple[str, Column]]:
    """Text of each field that exists, lists of strings joined by line breaks."""
    types = dict(df.dtypes)
    texts = []
    for name in fields:
        if name in types:
            value = F.array_join(name, "\n") if types[name].startswith("array") else F.col(name)
            texts.append((name, F.coalesce(value, F.lit(""))))
    return texts


def _has_word(text: Column, wanted: list[str]) -> Column:
    if not wanted:
        return F.lit(False)
    alternatives = "|".join(wanted)
    return text.rlike(rf"(^|[^\p{{L}}\p{{N}}])({alternatives})([^\p{{L}}\p{{N}}]|$)")


def _phrase_filter(text: Column, query: Query) -> Column:
    passed = F.lit(True)
    for phrase in query.phrases:
        passed = passed & text.contains(phrase)
    for phrase in query.without_phrases:
        passed = passed & ~text.contains(phrase)
    return passed


def matches(articles: DataFrame, q: str, fields: list[str] = FIELDS) -> DataFrame:
    """Articles matching ``q``, found by scanning their text. One narrow pass, no shuffle."""
    query = read_query(q)
    text = fold(F.concat_ws("\n", *[value for _, value in searchable(articles, fields)]))
    hit = _has_word(F.col("_text"), query.terms) & ~_has_word(F.col("_text"), query.without_terms)
    return (
        articles.withColumn("_text", text).filter(hit & _phrase_filter(F.col("_text"), query)).drop("_text")
    )


def build_postings(articles: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """The text index: (term, _id, field, tf). Stop words are not indexed."""
    each = F.explode(
        F.array(*[F.struct(F.lit(n).alias("field"), fold(v).alias("text")) for n, v in searchable(articles, fields)])
    )
    return (
        articles.select("_id", each.alias("f"))
        .select("_id", F.col("f.field").alias("field"), F.explode(words(F.col("f.text"))).alias("term"))
        .filter(~F.col("term").isin(STOP))
        .groupBy("_id", "field", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
        .select("term", "_id", "field", "tf")
    )


def write_postings(articles: DataFrame, path: str, files: int | None = None) -> None:
    """Write the index in term order, so a search reads only the row groups its terms can be in.

    Range partitioning by term and article splits a term that is in every article over many files.
    """
    postings = build_postings(articles)
    keys = ["term", "_id"]
    ranged = postings.repartitionByRange(files, *keys) if files else postings.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def matches_indexed(articles: DataFrame, postings: DataFrame, q: str, fields: list[str] = FIELDS) -> DataFrame:
    """Articles matching ``q``, found through the index; only candidates are read for phrases.

    The terms are literals, so they are pushed down to the scan of the index. An article is grouped per task first,
    and only its key is shuffled.
    """
    query = read_query(q)
    wanted, unwanted = query.terms, query.without_terms
    found = (
        postings.filter(F.col("term").isin(wanted + unwanted))
        .groupBy("_id")
        .agg(F.max(F.col("term").isin(wanted)).alias("hit"), F.max(F.col("term").isin(unwanted)).alias("bad"))
        .filter(F.col("hit") & ~F.col("bad"))
        .select("_id")
    )
    candidates = articles.join(found, "_id", "left_semi")
    if not (query.phrases or query.without_phrases):
        return candidates
    text = fold(F.concat_ws("\n", *[value for _, value in searchable(articles, fields)]))
    return candidates.filter(_phrase_filter(text, query))


def _check(skip: int) -> None:
    if skip < 0:
        raise ValueError("skip must not be negative")


def page(
    matched: DataFrame, limit: int = 10, skip: int = 0, after_id: str | None = None, at_once: int = MOST_SORTED
) -> DataFrame:
    """One page of matches in ``_id`` order. A limit of zero or less gives an empty page.

    ``after_id`` goes on behind an article, by the last id of the page before: ids up to it are not read again, and nothing is
    counted. A ``skip`` that reaches further than ``at_once`` rows counts the matches by ranges of their ids; only the ranges
    that hold the page are then sorted, so no task has to hold all rows before it.
    """
    _check(skip)
    rows = matched if after_id is None else matched.filter(F.col("_id") > after_id)
    limit = max(limit, 0)
    if limit and skip + limit > at_once:
        found = _id_ranges(rows.select("_id"), limit, skip, at_once)
        if found is None:
            return rows.limit(0)
        least, most, before = found
        rows = rows.filter((F.col("_id") >= least) & (F.substring("_id", 1, len(most)) <= most))
        skip -= before
    return rows.orderBy("_id").offset(skip).limit(limit)


def _id_ranges(ids: DataFrame, limit: int, skip: int, at_once: int) -> tuple[str, str, int] | None:
    """Least and greatest beginning of the ids on a page, and how many matches come before these; None behind the last one.

    Ids with one beginning are a range. A range with more rows than are sorted at once is counted again by longer beginnings.
    """
    beginning, before = "", 0
    while True:
        length = len(beginning) + ID_BEGINNING
        inside = ids.filter(F.col("_id").startswith(beginning)) if beginning else ids
        counts = inside.groupBy(F.substring("_id", 1, length).alias("range")).count()
        # A row for each beginning, whatever the number of matches.
        upto = F.sum("count").over(Window.orderBy("range")) + before
        on_page = counts.select("range", "count", upto.alias("upto")).filter(
            (F.col("upto") > skip) & (F.col("upto") - F.col("count") < skip + limit)
        )
        first = F.min(F.col("upto") - F.col("count")).alias("first")
        hit = on_page.agg(F.min("range").alias("least"), F.max("range").alias("most"), first, F.sum("count").alias("rows")).first()
        if hit["least"] is None:
            return None
        whole = hit["least"] != hit["most"] or len(hit["least"]) < length
        if whole or hit["rows"] <= at_once:
            return hit["least"], hit["most"], hit["first"]
        beginning, before = hit["least"], hit["first"]


def meta(matched: DataFrame, limit: int = 10, skip: int = 0) -> DataFrame:
    """One row: total, page, total_pages."""
    _check(skip)
    pages = F.ceil(F.col("total") / limit) if limit > 0 else F.lit(1)
    number = skip // limit + 1 if limit > 0 else 1
    return matched.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(number).cast("long").alias("page"), pages.cast("long").alias("total_pages")
    )


def search(
    articles: DataFrame | None,
    q: str,
    limit: int = 10,
    skip: int = 0,
    postings: DataFrame | None = None,
    after_id: str | None = None,
) -> tuple[DataFrame | None, DataFrame | dict]:
    """Page of articles and its meta row. Without a collection the answer is empty, page 1 of 1."""
    if articles is None:
        return None, {"total": 0, "page": 1, "total_pages": 1}
    matched = matches(articles, q) if postings is None else matches_indexed(articles, postings, q)
    return page(matched, limit, skip, after_id), meta(matched, limit, skip)
