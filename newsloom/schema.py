"""Fixed schemas of the article tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())

#: The stored article, one row per ``_id``.
ARTICLE = T.StructType(
    [
        T.StructField("_id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("keywords", _STRINGS),
        T.StructField("image_urls", _STRINGS),
        T.StructField("logo_url", T.StringType()),
        T.StructField("publication_date", T.StringType()),
        T.StructField("scraped_at", T.TimestampType()),
        T.StructField("language", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("source_domain", T.StringType()),
        T.StructField("is_fake_news", T.BooleanType()),
        T.StructField("confidence_score", T.DoubleType()),
    ]
)

#: What a failed input becomes. ``stage`` says where it failed.
ERROR = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("traceback", T.StringType()),
        T.StructField("stage", T.StringType()),
    ]
)

#: One row per (term, article, field) of the text index.
POSTING = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("_id", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("tf", T.LongType()),
    ]
)


def as_articles(df: DataFrame, *extra: str) -> DataFrame:
    """Project any article-like frame to the fixed article columns (and ``extra``), filling what is missing."""
    columns = []
    for field in ARTICLE.fields:
        if field.name not in df.columns:
            value = F.lit(None)
        else:
            value = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            value = F.coalesce(value, F.array().cast("array<string>"))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns, *extra)


def response_articles(df: DataFrame) -> DataFrame:
    """The article columns a caller of the service receives: everything but the storage key."""
    return as_articles(df).drop("_id")


def slim_articles(df: DataFrame) -> DataFrame:
    """The five-column form of an article."""
    return df.select("title", "content", "publication_date", "url", "language")
