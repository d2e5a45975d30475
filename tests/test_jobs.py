from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from newsloom.functions.urls import article_id
from newsloom.operators import extraction, language, reporting
from newsloom.plans import articles as jobs
from newsloom.plans.views import AS_OF, dated_pages
from newsloom.schema import ARTICLE, response_articles
from newsloom.sources import pages as page_source
from newsloom.sources import store
from newsloom.streaming import ingest

PARA = "This paragraph about solar panels is long enough to be the text of an article."


def page(i, url, body, day="2024-06-01"):
    head = f'<head><title>Page {i}</title><meta name="date" content="{day}"></head>' if day else "<head></head>"
    return (i, url, f'<html lang="en">{head}<body>{body}</body></html>')


PAGES = [
    page(1, "http://a.com/one?utm_source=x", f"<p>{PARA}</p>"),
    page(2, "http://a.com/list", "".join(f'<a href="/news/story-{i}">s</a>' for i in range(12)) + f"<p>{PARA}</p>"),
    *[page(10 + i, f"http://a.com/news/story-{i}", f"<p>{PARA} Number {i}.</p>") for i in range(9)],
    page(30, "http://b.com/old", f"<p>{PARA}</p>", "2023-06-01"),
    page(31, "http://b.com/undated", f"<p>{PARA}</p>", None),
    (32, "http://b.com/empty", "<script>var x;</script>"),
    page(33, "http://a.com/one", f"<p>{PARA} Newer copy.</p>"),
]
REQUESTED = [
    "http://a.com/one#top", "http://a.com/one", "http://a.com/list", "http://b.com/old", "http://b.com/undated",
    "http://b.com/empty", "http://nowhere.com/", "not a url", "http://nowhere.com/?ref=1",
]


@pytest.fixture(scope="module")
def run(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return jobs.process_urls(page_source.urls_from_list(spark, REQUESTED), pages, AS_OF)


def test_articles_are_told_their_language_once(run):
    """Summary and keywords read the recent articles from the shared folder; the detector does not run for each of them."""
    assert run.articles.inputFiles() and all("/told-" in f for f in run.articles.inputFiles())


def test_articles(run):
    rows = {r["url"]: r for r in run.articles.collect()}
    assert set(rows) == {"http://a.com/one"} | {f"http://a.com/news/story-{i}" for i in range(9)}
    one = rows["http://a.com/one"]
    assert run.articles.schema.names == ARTICLE.names
    assert one["content"].endswith("Newer copy.") and one["title"] == "Page 33" and one["source_domain"] == "a.com"
    assert one["scraped_at"] == AS_OF and one["language"] == "en" and one["publication_date"] == "2024-06-01"
    assert one["summary"] and one["keywords"] and len(one["keywords"]) <= 10 and one["_id"]
    assert "_id" not in response_articles(run.articles).columns


def test_errors(run):
    got = {(r["url"], r["error"], r["stage"]) for r in run.errors.collect()}
    no_page = "Error: No page for URL: "
    assert got == {
        ("not a url", "Error: Invalid URL: not a url", "scrape"),
        ("http://nowhere.com/", no_page + "http://nowhere.com/", "scrape"),
        ("http://a.com/news/story-9", no_page + "http://a.com/news/story-9", "scrape"),
    }


def test_every_input_has_one_outcome(run):
    stats = reporting.run_stats(run.outcomes).first().asDict()
    assert stats == {
        "n_articles": 10, "n_errors": 3, "n_reported": 13, "n_dropped_silently": 1, "n_not_recent": 2, "n_inputs": 16,
    }


def test_age_limit_of_zero_keeps_everything(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    kept = jobs.process_urls(page_source.urls_from_list(spark, REQUESTED), pages, AS_OF, max_age_days=0, method="rake")
    assert kept.articles.count() == 12
    assert reporting.run_stats(kept.outcomes).first()["n_not_recent"] == 0


def test_empty_request_is_refused(spark):
    with pytest.raises(ValueError):
        page_source.urls_from_list(spark, [])


def test_listing_takes_ten_links_and_a_single_link_is_no_listing(spark):
    many = "".join(f'<a href="/p{i}">x</a><a href="/p{i}#again">x</a>' for i in range(12))
    pages = spark.createDataFrame(
        [(1, "http://a.com/", many), (2, "http://b.com/?ref=1", '<a href="/only">x</a>')], "page_id long, url string, html string"
    )
    rows = page_source.fan_out(pages).orderBy("page_id", "pos").collect()
    assert [r["url"] for r in rows] == [f"http://a.com/p{i}" for i in range(10)] + ["http://b.com/"]
    assert [r["is_listing"] for r in rows] == [True] * 10 + [False]


def test_links_beyond_the_limit_are_counted_and_a_run_is_stored(spark, tmp_path):
    anchors = "".join(f'<a href="/news/story-{i}">story {i}</a>' for i in range(14))
    story = "<html lang='en'><head><title>T%d</title><meta name='date' content='2024-06-01'></head><body><article><p>Long enough text of story %d here.</p></article></body></html>"
    rows = [(0, "http://l.com/", f"<html><body>{anchors}</body></html>")]
    rows += [(i + 1, f"http://l.com/news/story-{i}", story % (i, i)) for i in range(14)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    run = jobs.process_urls(page_source.urls_from_list(spark, ["http://l.com/", "http://l.com/missing"]), pages, AS_OF, method="rake")
    stats = reporting.run_stats(run.outcomes).first().asDict()
    assert stats == {
        "n_articles": 10, "n_errors": 1, "n_reported": 11, "n_dropped_silently": 0, "n_not_recent": 0, "n_left_out": 4, "n_inputs": 11,
    }
    target = str(tmp_path / "stored")
    done = jobs.process_and_store(run, target, 0)
    stored = store.read_collection(spark, target)
    want = sorted((r["_id"], r["title"], r["content"]) for r in done.articles.collect())
    assert sorted((r["_id"], r["title"], r["content"]) for r in stored.collect()) == want and len(want) == 10
    jobs.process_and_store(run, target, 0)  # again: the same
    assert store.read_collection(spark, target).count() == 10


def test_language_falls_back_to_the_detector(spark):
    model = language.train(
        spark.createDataFrame([("der die das und nicht", "de"), ("the and not with", "en")], "text string, lang string")
    )
    df = spark.createDataFrame(
        [("u1", "die und das", None), ("u2", "die und das", "fr")], "url string, content string, language string"
    )
    got = {r["url"]: r["language"] for r in jobs.with_language(df, model).collect()}
    assert got == {"u1": "de", "u2": "fr"}
    assert {r["language"] for r in jobs.with_language(df, None).collect()} == {None, "fr"}


def test_logo_fallback_order(spark):
    articles = spark.createDataFrame(
        [(1, "http://a.com/x", None), (2, "http://b.com/x", None), (3, "http://c.com/x", None), (4, "http://a.com/y", "own")],
        "page_id long, url string, logo_url string",
    )
    known = spark.createDataFrame([("http://a.com/favicon.ico",), ("http://d.com/favicon.ico",)], "url string")
    roots = spark.createDataFrame(
        [(1, "http://a.com/", '<link rel="icon" href="/a">'), (2, "http://b.com", '<link rel="icon" href="/b">')],
        "page_id long, url string, html string",
    )
    got = {r["page_id"]: r["logo_url"] for r in extraction.fill_logos(articles, known, roots).collect()}
    assert got == {1: "http://a.com/favicon.ico", 2: "/b", 3: None, 4: "own"}


def test_domain_members_count_a_crowded_domain(spark):
    df = spark.range(100).select(
        F.concat(F.when(F.col("id") < 60, "http://www.hot.com/").otherwise("http://cold.org/"), "id").alias("url")
    )
    rows = reporting.domain_members(df, ["url"]).collect()
    assert len(rows) == 100
    assert {(r["domain"], r["n_articles"]) for r in rows} == {("hot.com", 60), ("cold.org", 40)}


def batch_result(pages):
    keyed = store.with_key(ingest.articles_from_pages(pages, AS_OF, 180), AS_OF)
    last = store.latest(keyed.select("_id", "url", "content", "title", "seq"), ["seq", "url"])
    return sorted(map(tuple, last.select("_id", "content", "title").collect()))


def test_stream_over_many_files_equals_the_batch_run(spark, sf_dir, tmp_path):
    pages = dated_pages(spark, sf_dir)
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for i, part in enumerate([F.col("page_id") < 20, F.col("page_id").between(20, 39), F.col("page_id") >= 40]):
        pages.filter(part).coalesce(1).write.parquet(f"{source}/{i}")
    stream = ingest.read_pages(spark, f"{source}/*", files_per_trigger=1)
    ingest.ingest(stream, target, progress, AS_OF).awaitTermination()
    stored = store.read_collection(spark, target)
    assert sorted(map(tuple, stored.select("_id", "content", "title").collect())) == batch_result(pages)
    before = stored.orderBy("_id").collect()
    ingest.ingest(ingest.read_pages(spark, f"{source}/*"), target, progress, AS_OF).awaitTermination()
    assert store.read_collection(spark, target).orderBy("_id").collect() == before


def test_stream_tells_the_language_of_silent_pages(spark, tmp_path):
    model = language.train(spark.createDataFrame([("die und das auf der", "de"), ("the and of with", "en")] * 3, "text string, lang string"))
    page = "<html%s><head><title>t</title><meta name='date' content='2024-06-01'></head><body><article><p>%s</p></article></body></html>"
    rows = [(1, "http://a.com/x", page % ("", "the and of with")), (2, "http://a.com/x", page % ("", "die und das auf der")), (3, "http://b.com/y", page % (" lang='fr'", "the and of"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")
    ingest.ingest(ingest.read_pages(spark, str(tmp_path / "in")), target, str(tmp_path / "progress"), AS_OF, language_model=model).awaitTermination()
    got = {r["url"]: r["language"] for r in store.read_collection(spark, target).collect()}
    assert got == {"http://a.com/x": "de", "http://b.com/y": "fr"}


def test_replayed_batch_changes_nothing(spark, sf_dir, tmp_path):
    target = str(tmp_path / "out")
    found = ingest.articles_from_pages(dated_pages(spark, sf_dir), AS_OF)
    ingest.store_batch(found, target, 0, AS_OF)
    once = store.read_collection(spark, target).orderBy("_id").collect()
    ingest.store_batch(found, target, 0, AS_OF)
    assert store.read_collection(spark, target).orderBy("_id").collect() == once


def test_stream_leaves_enrichment_alone(spark, sf_dir, tmp_path):
    target = str(tmp_path / "out")
    found = ingest.articles_from_pages(dated_pages(spark, sf_dir), AS_OF)
    enriched = lambda df: df.withColumns({"summary": F.lit("short"), "keywords": F.array(F.lit("k"))})
    ingest.store_batch(found, target, 0, AS_OF, "first", enriched)
    ingest.store_batch(found, target, 0, AS_OF, "second")
    rows = store.read_collection(spark, target).collect()
    assert rows and all((r["summary"], r["keywords"]) == ("short", ["k"]) and r["content"] for r in rows)


def test_lookup_moves_keys_only(spark, sf_dir):
    rows = [(1, "http://a.com/x", "old"), (2, "http://a.com/x?utm_source=f", "new"), (3, "http://b.com/", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    wanted = spark.createDataFrame([("http://a.com/x",), ("http://none.com/",)], "url string")
    stored = page_source.read_table(spark, sf_dir, "pages")
    plan = page_source.lookup_ids(wanted, stored)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and "SortAggregate" not in plan
    got = {r["url"]: r["html"] for r in page_source.lookup(wanted, pages).collect()}
    assert got == {"http://a.com/x": "new", "http://none.com/": None}


def test_missing_urls_are_reported_once(spark):
    many = "".join(f'<a href="/p{i}">x</a>' for i in range(3))
    pages = spark.createDataFrame([(1, "http://a.com/", many)], "page_id long, url string, html string")
    requested = spark.createDataFrame([("http://a.com/",), ("http://a.com/p1",), ("bad",)], "url string")
    errors = jobs.scrape(requested, pages, keep_link=None).errors
    assert sorted(r["url"] for r in errors.collect()) == ["bad", "http://a.com/p0", "http://a.com/p1", "http://a.com/p2"]


def test_all_links_without_a_limit(spark):
    many = "".join(f'<a href="/p{i}">x</a>' for i in range(13))
    pages = spark.createDataFrame([(1, "http://a.com/", many)], "page_id long, url string, html string")
    assert page_source.fan_out(pages, limit=None).count() == 13
    assert {r["n_left_out"] for r in page_source.fan_out(pages).collect()} == {3}


def test_cutoff_uses_the_given_moment(spark):
    df = spark.createDataFrame([("2024-06-30",), ("2024-06-29",)], "publication_date string")
    kept = extraction.filter_recent(df, dt.datetime(2024, 6, 30, 12), 1)
    assert [r[0] for r in kept.collect()] == ["2024-06-30"]


def test_ids_are_md5_of_the_url(spark):
    df = spark.createDataFrame([("http://a",)], "url string").select(article_id(F.col("url")).alias("i"))
    assert df.first()["i"] == hashlib.md5(b"http://a").hexdigest()


def test_error_messages_name_their_stage(spark):
    df = spark.createDataFrame([("u",)], "url string")
    got = {
        stage: reporting.error_rows(df, F.col("url"), F.lit("why"), stage).first()["error"] for stage in reporting.ERROR_PREFIX
    }
    assert got == {stage: prefix + "why" for stage, prefix in reporting.ERROR_PREFIX.items()}
