"""From requested URLs to enriched articles, errors and counts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import urls
from newsloom.functions.dates import is_recent, timestamp_literal
from newsloom.operators import classifier, language, reporting
from newsloom.operators.extraction import extract, fill_logos, filter_recent, resolve_logo
from newsloom.operators.keywords import extract_keywords
from newsloom.operators.summary import summarize
from newsloom.operators.terms import as_lists
from newsloom.schema import as_articles
from newsloom.session import materialise
from newsloom.sources import pages as page_source
from newsloom.sources import store


@dataclass(frozen=True)
class Run:
    """What a run gives: articles in the fixed schema, error rows, and one outcome per input after fan-out.

    Links of listings that were not followed are outcomes too, ``left_out``.
    """

    articles: DataFrame
    errors: DataFrame
    outcomes: DataFrame


class Scraped(NamedTuple):
    """``left_out`` has (url, n_left_out) of the listings with more links than were followed."""

    extracted: DataFrame
    errors: DataFrame
    left_out: DataFrame


def left_out_outcomes(left_out: DataFrame) -> DataFrame:
    """An outcome for each link that was not followed, by the listing's URL; a listing's links are bounded by its page."""
    return left_out.select("url", F.explode(F.sequence(F.lit(1), "n_left_out"))).select("url", F.lit("left_out").alias("outcome"))


def scrape(
    requested: DataFrame,
    pages: DataFrame,
    keep_link: Callable[[Column], Column] | None = page_source.looks_like_article,
    known_assets: DataFrame | None = None,
    link_limit: int | None = 10,
) -> Scraped:
    """One extracted row per distinct canonical URL behind the request, errors, and what listings had beyond the limit.

    ``extracted.content`` is null where no strategy found any. URLs are reduced to distinct keys before pages are
    joined, so neither a URL asked for many times nor a page fetched many times makes a hot key.
    """
    valid = urls.is_valid_url(F.col("url"))
    keys = page_source.requested_keys(requested)
    # Written once: articles and errors come from the same answer, and later branches read narrow rows.
    asked = materialise(page_source.lookup_ids(keys, pages), "requested")
    fanned = page_source.fan_out(page_source.with_source(asked, pages), keep=keep_link, limit=link_limit)
    fanned = materialise(fanned.select("url", "listing_url", "pos", "n_left_out"), "fanned")
    targets = materialise(fanned.select("url").distinct(), "targets")
    linked = page_source.lookup_ids(targets.join(keys, "url", "left_anti"), pages)
    known = asked.join(targets, "url", "left_semi").unionByName(linked)
    fetched = materialise(known, "fetched")
    extracted = extract(page_source.with_source(fetched, pages)).drop("page_id")
    if known_assets is not None:
        extracted = fill_logos(extracted, known_assets, pages)
    missing = asked.filter(F.col("page_id").isNull()).select("url").unionByName(fetched.filter(F.col("page_id").isNull()).select("url"))
    errors = reporting.invalid_url_errors(requested, valid).unionByName(reporting.missing_page_errors(missing.distinct()))
    left_out = fanned.filter((F.col("pos") == 0) & (F.col("n_left_out") > 0))
    return Scraped(resolve_logo(extracted), errors, left_out.select(F.col("listing_url").alias("url"), "n_left_out"))


def with_language(articles: DataFrame, model: language.LanguageModel | None, key: str = "url") -> DataFrame:
    """Declared language first, the detector's where a page declares none; without a detector that stays null.

    ``key`` names one row.
    """
    if model is None:
        return articles
    silent = articles.filter(F.col("language").isNull()).select(key, "content")
    detected = language.detect(silent, key, "content", model).withColumnRenamed("language", "_detected")
    return (
        articles.join(detected, key, "left")
        .withColumn("language", F.coalesce("language", "_detected"))
        .drop("_detected")
    )


def enrich(
    articles: DataFrame,
    model: PipelineModel | None = None,
    method: str = "combined",
    n_keywords: int = 10,
) -> DataFrame:
    """Add summary, keywords and verdict, joined back by URL. Rows without content pass through unenriched."""
    with_content = articles.filter(F.col("content") != "")
    summaries = summarize(with_content, "url", "content").select("url", "summary")
    keywords = as_lists(extract_keywords(with_content, "url", "content", method, n_keywords), "url")
    enriched = articles.join(summaries, "url", "left").join(keywords, "url", "left")
    if model is None:
        return enriched
    texts = with_content.select("url", F.concat_ws(" ", "title", "content").alias("text"))
    return enriched.join(classifier.score(texts, "url", "text", model), "url", "left")


def process_urls(
    requested: DataFrame,
    pages: DataFrame,
    as_of: dt.datetime,
    max_age_days: int = 180,
    model: PipelineModel | None = None,
    language_model: language.LanguageModel | None = None,
    known_assets: DataFrame | None = None,
    method: str = "combined",
    n_keywords: int = 10,
    link_limit: int | None = 10,
) -> Run:
    """The whole job. Extraction is written once to the shared folder, since every later branch reads it."""
    extracted, errors, left_out = scrape(requested, pages, known_assets=known_assets, link_limit=link_limit)
    extracted = materialise(extracted, "extracted")
    readable = extracted.filter(F.col("content").isNotNull())
    recent = filter_recent(readable, as_of, max_age_days)
    # Written too: summary, verdict and every keyword method read the articles, some of them more than once.
    told = materialise(with_language(recent, language_model), "told")
    enriched = enrich(told, model, method, n_keywords)
    stamped = enriched.withColumn("_id", urls.article_id(F.col("url"))).withColumn(
        "scraped_at", timestamp_literal(as_of)
    )
    is_kept = F.lit(True) if max_age_days <= 0 else is_recent(F.col("publication_date"), as_of, max_age_days)
    outcomes = extracted.select(
        "url",
        F.when(F.col("content").isNull(), "dropped").when(is_kept, "article").otherwise("stale").alias("outcome"),
    ).unionByName(errors.select("url", F.lit("error").alias("outcome"))).unionByName(left_out_outcomes(left_out))
    return Run(as_articles(stamped), errors, outcomes)



def process_and_store(run: Run, path: str, batch: int, writer: str = "main") -> Run:
    """Upsert a run's articles into a collection. The run's articles are then what was stored, not computed again."""
    articles = materialise(run.articles, "articles")
    store.upsert(articles.filter(F.coalesce(F.col("url"), F.lit("")) != ""), path, batch, writer)
    return Run(articles, run.errors, run.outcomes)
