"""Pages arriving over time, turned into articles, enriched and upserted as they come."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions import urls
from newsloom.operators.extraction import extract, filter_recent, resolve_logo
from newsloom.operators.language import DEFAULT_LANGUAGE, LanguageModel
from newsloom.plans.articles import with_language
from newsloom.schema import as_articles
from newsloom.session import materialise
from newsloom.sources.store import latest, upsert, with_key

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def read_pages(spark: SparkSession, path: str, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def articles_from_pages(pages: DataFrame, as_of: dt.datetime, max_age_days: int = 180) -> DataFrame:
    """Stateless stages; the same columns on a stream and on a table. ``seq`` is the page number, as write order."""
    canonical = pages.withColumn("url", urls.normalize_url(F.col("url"))).filter(F.col("url").isNotNull())
    extracted = extract(canonical).filter(F.col("content").isNotNull())
    return resolve_logo(filter_recent(extracted, as_of, max_age_days)).withColumn("seq", F.col("page_id"))


#: What reading a page sets; summary, keywords and verdict stay as they are unless the stream enriches.
READ_FIELDS = [
    "title", "content", "image_urls", "logo_url", "publication_date", "scraped_at", "language", "url", "source_domain",
]

Enrich = Callable[[DataFrame], DataFrame]


def store_batch(
    articles: DataFrame,
    target: str,
    batch: int,
    as_of: dt.datetime,
    writer: str = "stream",
    enrich: Enrich | None = None,
    language_model: LanguageModel | None = None,
) -> None:
    """Upsert one batch. A batch that is replayed overwrites its own directory, so retries change nothing.

    ``language_model`` tells the language of pages that declare none; without it that is the default's.
    ``enrich`` adds summary, keywords or verdict to the last version of each article in the batch.
    """
    if language_model is not None:
        # A page may come again in the same batch: its number names the row, its address doesn't.
        articles = with_language(materialise(articles, "stream-batch"), language_model, key="seq")
    keyed = with_key(articles, as_of).withColumn("language", F.coalesce("language", F.lit(DEFAULT_LANGUAGE)))
    if enrich is not None:
        last = latest(keyed.withColumn("_row", F.xxhash64("content")), ["seq", "url", "_row"]).drop("_row")
        stored = as_articles(enrich(last), "seq")
    else:
        stored = as_articles(keyed, "seq").withColumn("present", F.array(*[F.lit(c) for c in READ_FIELDS]))
    upsert(stored, target, batch, writer)


def ingest(
    pages: DataFrame,
    target: str,
    checkpoint: str,
    as_of: dt.datetime,
    max_age_days: int = 180,
    enrich: Enrich | None = None,
    language_model: LanguageModel | None = None,
) -> StreamingQuery:
    """Run over everything available, then stop. The last arrival of an article wins, so no watermark is needed.

    A stream counts its batches by its checkpoint, so the checkpoint's name is also the writer's.
    """
    writer = "stream-" + hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, target, batch_id, as_of, writer, enrich, language_model)

    return (
        articles_from_pages(pages, as_of, max_age_days)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
