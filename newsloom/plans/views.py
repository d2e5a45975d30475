"""Article-shaped views over the given tables.

The pages carry no dates, images or icons, so ``dated_pages`` writes some into the source of every page by a rule on
its number. ``articles_view`` is the simple article table the store and search queries read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import html, urls
from newsloom.functions.text import clean_text
from newsloom.sources.pages import read_table

AS_OF = dt.datetime(2024, 6, 30)


def page_day() -> Column:
    days_back = (F.col("page_id") % 400).cast("int")
    return F.date_format(F.date_sub(F.lit("2024-06-30").cast("date"), days_back), "yyyy-MM-dd")


def dated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    page_id, day = F.col("page_id").cast("string"), page_day()
    date_kind, logo_kind = F.col("page_id") % 5, F.col("page_id") % 4
    empty = F.lit("")
    date_tag = (
        F.when(date_kind == 0, F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T10:20:30Z">')))
        .when(date_kind == 1, F.concat(F.lit('<meta name="publication_date" content="'), day, F.lit('">')))
        .when(date_kind == 2, F.concat(F.lit('<meta name="date" content="'), day, F.lit(' 08:15">')))
        .otherwise(empty)
    )
    logo_tag = (
        F.when(logo_kind == 0, F.concat(F.lit('<link rel="icon" href="/favicon-'), page_id, F.lit('.png">')))
        .when(
            logo_kind == 1,
            F.concat(F.lit('<link rel="apple-touch-icon" href="https://cdn.example.com/'), page_id, F.lit('.png">')),
        )
        .when(logo_kind == 2, F.concat(F.lit('<meta property="og:image" content="/og/'), page_id, F.lit('.jpg">')))
        .otherwise(empty)
    )
    time_tag = F.when(date_kind == 3, F.concat(F.lit('<time datetime="'), day, F.lit('T07:00"></time>'))).otherwise(empty)
    image_tags = F.concat(
        F.lit('<img src="/img/'), page_id, F.lit('.png?utm_source=x" width="640" height="480"><img src="thumb.png" width="'),
        (F.col("page_id") % 200).cast("string"), F.lit('" height="150"><img alt="none">'),
    )
    head = F.replace("html", F.lit("</head>"), F.concat(date_tag, logo_tag, F.lit("</head>")))
    return pages.select(
        "page_id",
        "url",
        F.replace(head, F.lit("</article>"), F.concat(time_tag, image_tags, F.lit("</article>"))).alias("html"),
    )


def articles_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.col("html")
    return read_table(spark, sf_dir, "pages").select(
        urls.article_id(F.col("url")).alias("_id"),
        "page_id",
        "url",
        html.title(source).alias("title"),
        clean_text(html.text_nodes(html.clean_html(source))).alias("content"),
        html.declared_language(source).alias("language"),
        urls.source_domain(F.col("url")).alias("source_domain"),
        page_day().alias("publication_date"),
    )
