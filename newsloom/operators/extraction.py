"""From page source to article: a cascade of strategies, the first that finds content wins."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import html, urls
from newsloom.functions.dates import is_recent
from newsloom.functions.text import strip


@dataclass(frozen=True)
class Strategy:
    """One way to read a page. Each function maps the page source to a column; ``None`` means it never finds one."""

    name: str
    content: Callable[[Column], Column]
    images: Callable[[Column], Column]
    date: Callable[[Column], Column] | None = None
    logo: Callable[[Column], Column] | None = None
    declares_language: bool = False


def density_text(source: Column) -> Column:
    return html.decode_entities(F.array_join(html.text_blocks(source), "\n\n"))


def stripped_text(source: Column) -> Column:
    return strip(html.text_nodes(html.main_block(html.clean_html(source))))


def selected_text(source: Column) -> Column:
    return html.rendered_text(html.main_block(source))


def main_images(source: Column) -> Column:
    return html.images(html.main_block(source))


#: Tried in this order.
STRATEGIES = [
    Strategy("paragraph_density", density_text, html.images, date=html.publication_date, declares_language=True),
    Strategy("tag_strip", stripped_text, main_images),
    Strategy("selector", selected_text, html.large_images, date=html.publication_date, logo=html.logo),
]


def extract(pages: DataFrame, strategies: list[Strategy] = STRATEGIES) -> DataFrame:
    """Article fields of each page. ``content`` is null where every strategy came up empty.

    A later strategy is only evaluated for the pages on which the earlier ones failed. All of it is a projection.
    """
    source = F.col("html")

    def candidate(strategy: Strategy) -> Column:
        made = F.array(F.struct(F.lit(strategy.name).alias("strategy"), strategy.content(source).alias("content")))
        return F.try_element_at(F.filter(made, lambda c: c["content"] != ""), F.lit(1))

    def by_strategy(found: Column, pick: Callable[[Strategy], Callable[[Column], Column] | None]) -> Column:
        """What ``pick`` chooses for the winning strategy; strategies that share a function share a branch."""
        branches: dict[Callable[[Column], Column], list[str]] = {}
        for strategy in strategies:
            if pick(strategy):
                branches.setdefault(pick(strategy), []).append(strategy.name)
        chosen = F.lit(None)
        for function, names in branches.items():
            chosen = F.when(found.isin(names), function(source)).otherwise(chosen)
        return chosen

    # Generated, not projected: later filters on content or date must not be pushed down as second copies of these
    # expressions, which would read every page twice.
    chosen = F.coalesce(*[candidate(s) for s in strategies]).cast("struct<strategy:string,content:string>")
    found = F.inline_outer(F.array(chosen))
    dated = F.col("strategy").isin([s.name for s in strategies if s.date])
    in_page = by_strategy(F.col("strategy"), lambda s: s.date).cast("string")
    date = F.explode_outer(F.array(F.coalesce(in_page, F.when(dated, urls.date_in_path(F.col("url"))))))
    declares = [s.name for s in strategies if s.declares_language]
    declared = F.nullif(html.declared_language(source), F.lit(""))
    return (
        pages.select("*", found)
        .select("*", date.alias("publication_date"))
        .select(
            *[c for c in pages.columns if c != "html"],
            "strategy",
            "content",
            html.title(source).alias("title"),
            F.when(F.col("strategy").isin(declares), declared).alias("language"),
            "publication_date",
            urls.resolve_urls(by_strategy(F.col("strategy"), lambda s: s.images), F.col("url")).alias("image_urls"),
            by_strategy(F.col("strategy"), lambda s: s.logo).alias("logo_url"),
            urls.source_domain(F.col("url")).alias("source_domain"),
        )
    )


def site_root(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)


def fill_logos(articles: DataFrame, known_assets: DataFrame, pages: DataFrame) -> DataFrame:
    """Give articles without a logo the favicon of their site if it is known to exist, else the root page's logo.

    ``known_assets(url)`` says which asset URLs exist. Articles crowd on a few large sites, so the sites are reduced
    to one row each before anything is looked up, and the lookup is joined back over salted site keys.
    """
    salts = 16
    keyed = articles.withColumn("_site", site_root(F.col("url")))
    sites = keyed.filter(F.col("logo_url").isNull()).select("_site").distinct()
    favicon = F.concat(F.col("_site"), F.lit("/favicon.ico"))
    assets = known_assets.select(F.col("url").alias("_asset")).distinct()
    roots = (
        pages.select(
            F.regexp_replace(urls.normalize_url(F.col("url")), "/$", "").alias("_root"),
            html.logo(F.col("html")).alias("_logo"),
            "page_id",
        )
        .filter(F.col("_logo").isNotNull() & (F.col("_root") == site_root(F.col("_root"))))
        .groupBy("_root")
        .agg(F.max_by("_logo", "page_id").alias("_logo"))
    )
    site_logos = (
        sites.join(assets, favicon == F.col("_asset"), "left")
        .join(roots, F.col("_site") == F.col("_root"), "left")
        .select("_site", F.coalesce(F.when(F.col("_asset").isNotNull(), favicon), F.col("_logo")).alias("_site_logo"))
        .filter(F.col("_site_logo").isNotNull())
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    return (
        keyed.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int"))
        .join(site_logos, ["_site", "_salt"], "left")
        .withColumn("logo_url", F.coalesce(F.col("logo_url"), F.col("_site_logo")))
        .drop("_site", "_salt", "_site_logo")
    )


def resolve_logo(articles: DataFrame) -> DataFrame:
    """Absolute logo URLs; a relative one is resolved against its article like an image."""
    return articles.withColumn("logo_url", urls.resolve_url(F.col("logo_url"), F.col("url")))


def filter_recent(articles: DataFrame, as_of: dt.datetime, max_age_days: int = 180) -> DataFrame:
    """Articles published in the window that ends at ``as_of``; a window of no days or fewer keeps everything."""
    if max_age_days <= 0:
        return articles
    return articles.filter(is_recent(F.col("publication_date"), as_of, max_age_days))
