"""What a reader of the results sees: previews, groups by domain, errors and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import preview
from newsloom.functions.urls import display_domain

SALTS = 16

# What an error message starts with, by the stage that failed.
ERROR_PREFIX = {
    "scrape": "Error: ",
    "result": "Unexpected result: ",
    "enrich": "Error during enrichment: ",
    "store": "Error storing in MongoDB: ",
}


def previews(articles: DataFrame) -> DataFrame:
    """Card view of each article."""
    return articles.select(
        "_id",
        "title",
        preview(F.col("content")).alias("content_preview"),
        F.coalesce(F.nullif(F.col("publication_date"), F.lit("")), F.lit("Unknown")).alias("publication_date"),
        F.upper("language").alias("language"),
    )


def domain_groups(articles: DataFrame) -> DataFrame:
    """(domain, n_articles)."""
    return articles.groupBy(display_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n_articles"))


def domain_members(articles: DataFrame, columns: list[str]) -> DataFrame:
    """Every article with its domain and the size of its group.

    Members stay rows: one site may own a large share of all articles, so its group is never gathered. The counts are
    joined back over a salted key, which spreads such a site over many tasks.
    """
    keyed = articles.select(display_domain(F.col("url")).alias("domain"), *columns).withColumn(
        "_salt", F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")
    )
    counts = domain_groups(articles).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.join(counts, ["domain", "_salt"]).select("domain", *columns, "n_articles")


def error_rows(df: DataFrame, url: Column, detail: Column, stage: str = "scrape") -> DataFrame:
    """Rows of the error table; the message of the failure travels, a stack trace does not."""
    return df.select(
        url.alias("url"),
        F.concat(F.lit(ERROR_PREFIX[stage]), detail).alias("error"),
        F.lit(None).cast("string").alias("traceback"),
        F.lit(stage).alias("stage"),
    )


def invalid_url_errors(requested: DataFrame, is_valid: Column) -> DataFrame:
    detail = F.concat(F.lit("Invalid URL: "), F.coalesce(F.col("url"), F.lit("None")))
    return error_rows(requested.filter(~is_valid), F.col("url"), detail)


def missing_page_errors(missing: DataFrame) -> DataFrame:
    """Errors of URLs without a page, one for each row."""
    return error_rows(missing, F.col("url"), F.concat(F.lit("No page for URL: "), F.col("url")))


def run_stats(outcomes: DataFrame) -> DataFrame:
    """One row of counts over a table with one ``outcome`` per input: article, error, dropped or stale.

    ``left_out`` rows are links that were not followed: they are counted apart and are no inputs.
    """
    count = lambda name: F.count(F.when(F.col("outcome") == name, 1))
    return outcomes.agg(
        count("article").alias("n_articles"),
        count("error").alias("n_errors"),
        (count("article") + count("error")).alias("n_reported"),
        count("dropped").alias("n_dropped_silently"),
        count("stale").alias("n_not_recent"),
        count("left_out").alias("n_left_out"),
        (F.count(F.lit(1)) - count("left_out")).alias("n_inputs"),
    )
