"""The article collection: an append-only Parquet log of writes, read as one row per ``_id``.

A batch of writes is one directory, ``batch=<n>/writer=<name>``, that no other writer touches. Writing a batch costs
the size of the batch, not of the collection, and writing it again replaces just that directory and keeps its place in
the order of commits, which makes retries harmless. A write may set some of an article's fields only: ``present`` names
them, and null means all. Reading keeps the last write per ``_id`` and field, and reads the wanted columns only.
``compact`` folds a log into a new one when it grows long.
"""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from newsloom.functions.dates import cutoff, parse_date, timestamp_literal
from newsloom.functions.urls import article_id
from newsloom.schema import ARTICLE

LOG_SCHEMA = T.StructType(
    [
        *ARTICLE.fields,
        T.StructField("present", T.ArrayType(T.StringType())),
        T.StructField("seq", T.LongType()),
        T.StructField("commit", T.LongType()),
        T.StructField("batch", T.LongType()),
        T.StructField("writer", T.StringType()),
    ]
)
FIELDS = [f.name for f in ARTICLE.fields if f.name != "_id"]


def latest(writes: DataFrame, order: list[str], key: str = "_id") -> DataFrame:
    """Last write per key, whole rows.

    The maximum is taken per task before the shuffle, so a key that owns a large share of all writes sends one row
    per task. ``order`` must be unique within a key.
    """
    values = [c for c in writes.columns if c != key]
    winner = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return writes.groupBy(key).agg(winner).select(key, *[F.col(f"_last.{c}").alias(c) for c in values])


def merge_fields(writes: DataFrame, order: list[str], present: str = "present", key: str = "_id") -> DataFrame:
    """Last write per key and field, for partial records.

    ``present`` is the array of the fields a write sets. An explicit null overwrites; a field that is not set keeps
    its value.
    """
    values = [c for c in writes.columns if c not in (key, present, *order)]
    ordering = F.struct(*order)
    merged = [
        F.max_by(F.col(c), F.when(F.array_contains(F.col(present), c), ordering)).alias(c) for c in values
    ]
    return writes.groupBy(key).agg(*merged)


def with_key(articles: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Articles ready to be stored: keyed by URL, stamped if they carry no time; rows without URL are refused."""
    stamp = timestamp_literal(as_of)
    stamped = F.coalesce(F.col("scraped_at"), stamp) if "scraped_at" in articles.columns else stamp
    return (
        articles.filter(F.coalesce(F.col("url"), F.lit("")) != "")
        .withColumn("_id", article_id(F.col("url")))
        .withColumn("scraped_at", stamped)
    )


def upsert(articles: DataFrame, path: str, batch: int, writer: str = "main") -> None:
    """Write one batch of keyed articles to the collection.

    ``seq`` orders writes inside the batch, if present; equal ones are ordered by their URL and a hash of the row.
    ``present`` names the fields a write sets, if the column is there; a null sets all.
    """
    writes = articles if "seq" in articles.columns else articles.withColumn("seq", F.lit(0).cast("long"))
    every = F.array(*[F.lit(c) for c in FIELDS])
    present = F.coalesce(F.col("present"), every) if "present" in articles.columns else every
    ordered = writes.withColumns({"present": present, "_row": F.xxhash64(*[c for c in FIELDS if c in writes.columns])})
    order = F.struct("seq", "url", "_row")
    sets = {c: F.array_contains("present", c) for c in FIELDS}
    merged = ordered.groupBy("_id").agg(
        *[F.max_by(F.col(c), F.when(sets[c], order)).alias(c) for c in FIELDS],
        *[F.max(sets[c]).alias(f"_{c}_set") for c in FIELDS],
        F.max("seq").alias("seq"),
    )
    names = F.array_compact(F.array(*[F.when(F.col(f"_{c}_set"), F.lit(c)) for c in FIELDS]))
    target = f"{path}/batch={batch}/writer={writer}"
    (
        merged.select("_id", *FIELDS, names.alias("present"), "seq", F.lit(_commit(articles.sparkSession, target)).alias("commit"))
        .sortWithinPartitions("_id")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#_id", "true")
        .parquet(target)
    )


def _commit(spark: SparkSession, target: str) -> int:
    """The place of a batch in the order of commits: what it had when it was first written, or else the time."""
    try:
        first = spark.read.parquet(target).select("commit").first()
    except AnalysisException as missing:
        if not any(reason in str(missing) for reason in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        first = None
    return first[0] if first else time.time_ns() // 1000


def read_log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG_SCHEMA).option("basePath", path).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return spark.createDataFrame([], LOG_SCHEMA)
        raise


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """The collection: one row per ``_id``, of each field the last write that sets it.

    Each field is an aggregate of its own, so that those nobody asks for are neither read nor moved.
    """
    order = F.struct("commit", "batch", "writer", "seq")
    fields = [F.max_by(F.col(c), F.when(F.array_contains("present", c), order)).alias(c) for c in FIELDS]
    return read_log(spark, path).groupBy("_id").agg(*fields)


def compact(spark: SparkSession, path: str, target: str, batch: int = 0) -> None:
    """Fold the log at ``path`` into a new log at ``target`` that holds one write per ``_id``."""
    upsert(read_collection(spark, path), target, batch)


def get_article(collection: DataFrame, wanted: str) -> DataFrame:
    """The article with an ``_id``; the filter reaches the Parquet scan through the aggregate on the same key."""
    return collection.filter(F.col("_id") == wanted)


def get_article_by_url(collection: DataFrame, url: str) -> DataFrame:
    """The article stored for exactly this URL text, which is not canonicalised first."""
    return collection.filter(F.col("_id") == F.md5(F.lit(url)))


def recent_articles(collection: DataFrame, as_of: dt.datetime, days: int = 180, limit: int = 100) -> DataFrame:
    """Newest articles by the text order of the stored date, which is exact for ISO dates only."""
    floor = cutoff(as_of, days).isoformat()
    return (
        collection.filter(F.col("publication_date") >= floor)
        .orderBy(F.col("publication_date").desc(), F.col("_id"))
        .limit(limit)
    )


def recent_articles_by_time(
    collection: DataFrame, as_of: dt.datetime, days: int = 180, limit: int = 100
) -> DataFrame:
    """Newest articles by the parsed date, right for every accepted format."""
    published = collection.withColumn("published_ts", parse_date(F.col("publication_date")))
    return (
        published.filter(F.col("published_ts") >= timestamp_literal(cutoff(as_of, days)))
        .orderBy(F.col("published_ts").desc(), F.col("_id"))
        .limit(limit)
    )
