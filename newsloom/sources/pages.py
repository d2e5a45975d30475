"""Pages instead of a crawler: requested URLs are looked up in a table of fetched pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import html, urls
from newsloom.functions.binding import let

# Path segments under which sites publish articles.
ARTICLE_SECTIONS = ["story", "article", "articles", "feature", "features", "news", "post", "posts", "blog"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def urls_from_text(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per URL of a newline-separated text column."""
    return df.select(F.explode(urls.url_lines(F.col(text))).alias("url"))


def urls_from_list(spark: SparkSession, requested: list[str]) -> DataFrame:
    """A URL table from a list given by the caller, who must name at least one."""
    if not requested:
        raise ValueError("the list of URLs to read is empty")
    return spark.createDataFrame([(u,) for u in requested], "url string")


def page_keys(pages: DataFrame) -> DataFrame:
    """(url, page_id) of every page with a valid URL; the source stays where it is."""
    return pages.filter(urls.is_valid_url(F.col("url"))).select(urls.normalize_url(F.col("url")).alias("url"), "page_id")


def requested_keys(requested: DataFrame) -> DataFrame:
    """Canonical form of each requested URL, once."""
    valid = requested.filter(urls.is_valid_url(F.col("url")))
    return valid.select(urls.normalize_url(F.col("url")).alias("url")).distinct()


def lookup_ids(requested: DataFrame, pages: DataFrame) -> DataFrame:
    """Requested canonical URLs with the number of their page, the highest where several were fetched, or null.

    Only keys move: the requested ones reduce the pages' keys, and the maximum is taken on the map side, so that a URL
    fetched a million times sends one row per task.
    """
    found = page_keys(pages).join(requested, "url", "left_semi").groupBy("url").agg(F.max("page_id").alias("page_id"))
    return requested.join(found, "url", "left")


def with_source(found: DataFrame, pages: DataFrame) -> DataFrame:
    """The source of the pages whose numbers were found; a ``page_id`` names one fetched page."""
    return found.filter(F.col("page_id").isNotNull()).join(pages.select("page_id", "html"), "page_id")


def lookup(requested: DataFrame, pages: DataFrame) -> DataFrame:
    """Requested canonical URLs with their page; ``html`` is null where there is none."""
    return lookup_ids(requested, pages).join(pages.select("page_id", "html"), "page_id", "left").select("url", "page_id", "html")


def looks_like_article(url: Column) -> Column:
    """True for links that look like an article: a date or a publishing section in the path, or a long slug."""
    path = F.lower(F.regexp_extract(url, r"^[a-z]+://[^/]*(/.*)?$", 1))
    sections = "|".join(ARTICLE_SECTIONS)
    return (
        path.rlike(r"/\d{4}[/-]\d{1,2}([/-]\d{1,2})?(/|$|-)")
        | path.rlike(rf"/({sections})/[^/]+")
        | path.rlike(r"/[^/]*([^/_-]+[_-]){4,}[^/]+/?$")
    )


def page_links(source: Column, url: Column) -> Column:
    """Distinct absolute links of a page in page order."""
    return urls.resolve_urls(html.links(source), url)


def fan_out(
    pages: DataFrame,
    keep: Callable[[Column], Column] | None = None,
    limit: int | None = 10,
) -> DataFrame:
    """Targets behind each page: the first ``limit`` links of a listing (all for None), or the page itself.

    ``n_left_out`` counts the links of the page beyond the limit.

    A page is a listing if more than one link passes ``keep``. The links of a page are an array in its row, so this is
    a narrow step: nothing is shuffled and no window is needed.
    """
    found = page_links(F.col("html"), F.col("url"))
    if keep is not None:
        found = F.filter(found, keep)
    targets = let(
        found,
        lambda links: F.struct(
            (F.size(links) > 1).alias("is_listing"),
            F.when(F.size(links) > 1, links if limit is None else F.slice(links, 1, limit))
            .otherwise(F.array(urls.normalize_url(F.col("url"))))
            .alias("targets"),
            F.greatest(F.size(links) - limit, F.lit(0)).alias("left_out") if limit else F.lit(0).alias("left_out"),
        ),
        "struct<is_listing:boolean,targets:array<string>,left_out:int>",
    )
    return pages.withColumn("_fan", targets).select(
        *[c for c in pages.columns if c not in ("html", "url")],
        F.col("url").alias("listing_url"),
        F.col("_fan.is_listing").alias("is_listing"),
        F.col("_fan.left_out").alias("n_left_out"),
        F.posexplode("_fan.targets").alias("pos", "url"),
    )
