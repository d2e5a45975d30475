"""Requests and pages that both arrive over time: a URL may be asked for before its page comes, or after.

Only keys are held in state, (url, time) of requests and (url, page_id, time) of pages; the sources of pages that were asked
for are read from the table of pages by number. A request without a page for as long as it waits is an error.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions import urls
from newsloom.operators import reporting
from newsloom.operators.language import LanguageModel
from newsloom.session import materialise
from newsloom.sources.pages import with_source
from newsloom.streaming.ingest import Enrich, articles_from_pages, store_batch


def _canonical(url: str) -> Column:
    return F.when(urls.is_valid_url(F.col(url)), urls.normalize_url(F.col(url)))


def answers(requests: DataFrame, pages: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(``asked``, ``url``, ``page_id``) of each request and each page fetched within ``wait`` of it, before or after.

    ``requests`` has (url, asked_at), ``pages`` (page_id, url, fetched_at); rows that come more than ``late`` behind the
    latest time seen may be lost. ``asked`` is the URL as it was given and ``url`` its canonical form, null if invalid.
    ``page_id`` is null, once, for a request without a page; that is known when the watermark has passed the wait. A URL
    asked for again within ``late`` is one request; invalid URLs and those without a page come out alike.
    """
    asked = (
        requests.select(F.col("url").alias("asked"), _canonical("url").alias("url"), "asked_at")
        .withColumn("key", F.coalesce("url", "asked"))
        .withWatermark("asked_at", late)
        .dropDuplicatesWithinWatermark(["key"])
        .drop("key")
    )
    fetched = (
        pages.select("page_id", _canonical("url").alias("page_url"), "fetched_at")
        .filter(F.col("page_url").isNotNull())
        .withWatermark("fetched_at", late)
    )
    near = F.expr(f"fetched_at between asked_at - interval {wait} and asked_at + interval {wait}")
    return asked.join(fetched, (F.col("url") == F.col("page_url")) & near, "left").select("asked", "url", "page_id")


def errors_of(unanswered: DataFrame) -> DataFrame:
    """Error rows of answers without a page: invalid URLs, and URLs that no page came for."""
    invalid = unanswered.filter(F.col("url").isNull()).select(F.col("asked").alias("url"))
    missing = unanswered.filter(F.col("url").isNotNull()).select("url")
    return reporting.invalid_url_errors(invalid, F.lit(False)).unionByName(reporting.missing_page_errors(missing))


def answer(
    requests: DataFrame,
    pages: DataFrame,
    sources: DataFrame,
    target: str,
    errors: str,
    checkpoint: str,
    as_of: dt.datetime,
    wait: str = "1 hour",
    late: str = "10 minutes",
    max_age_days: int = 180,
    enrich: Enrich | None = None,
    language_model: LanguageModel | None = None,
) -> StreamingQuery:
    """Upsert the articles that were asked for into ``target`` and write what has no page to ``errors``, then stop.

    ``sources`` is the table of pages, (page_id, html). Of several pages of a URL the highest number wins, also across
    batches. A replayed batch overwrites its own directories in both places.
    """
    writer = "requests-" + hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        told = materialise(batch, "answers")  # narrow rows, read by both branches
        found = told.filter(F.col("page_id").isNotNull()).groupBy("url").agg(F.max("page_id").alias("page_id"))
        articles = articles_from_pages(with_source(found, sources), as_of, max_age_days)
        store_batch(articles, target, batch_id, as_of, writer, enrich, language_model)
        unanswered = errors_of(told.filter(F.col("page_id").isNull()))
        unanswered.write.mode("overwrite").parquet(f"{errors}/writer={writer}/batch={batch_id}")

    return (
        answers(requests, pages, wait, late)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_errors(spark: SparkSession, errors: str) -> DataFrame:
    """The error rows of all batches."""
    return spark.read.parquet(errors).drop("writer", "batch")
