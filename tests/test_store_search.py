from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.operators import reporting, search
from newsloom.schema import as_articles
from newsloom.sources import store

AS_OF = dt.datetime(2024, 6, 30)


def articles(spark, *rows):
    """Rows of (seq, url, title, content)."""
    df = spark.createDataFrame(list(rows), "seq long, url string, title string, content string")
    return as_articles(store.with_key(df, AS_OF).withColumn("language", F.lit("en")), "seq")


def test_upsert_keeps_the_last_write(spark, tmp_path):
    path = str(tmp_path / "store")
    first = articles(spark, (1, "http://a", "old", "x"), (2, "http://a", "new", "y"), (3, None, "no url", "z"), (4, "http://b", "b", "b"))
    store.upsert(first, path, 0)
    store.upsert(articles(spark, (1, "http://a", "newest", None)), path, 1)
    got = {r["url"]: (r["title"], r["content"]) for r in store.read_collection(spark, path).collect()}
    assert got == {"http://a": ("newest", None), "http://b": ("b", "b")}


def test_upsert_twice_is_upsert_once(spark, tmp_path):
    path = str(tmp_path / "store")
    batch = articles(spark, (1, "http://a", "t", "x"), (2, "http://b", "u", "y"))
    store.upsert(batch, path, 0)
    once = store.read_collection(spark, path).orderBy("_id").collect()
    store.upsert(batch, path, 0)
    store.upsert(batch, path, 1)
    assert store.read_collection(spark, path).orderBy("_id").collect() == once


def test_compact_changes_nothing(spark, tmp_path):
    path, target = str(tmp_path / "log"), str(tmp_path / "compact")
    for batch, title in enumerate(["a", "b", "c"]):
        store.upsert(articles(spark, (1, "http://x", title, "c"), (2, f"http://{title}", title, "c")), path, batch)
    store.compact(spark, path, target)
    read = lambda p: sorted(map(tuple, store.read_collection(spark, p).select("_id", "title", "url").collect()))
    assert read(path) == read(target) and len(read(target)) == 4
    assert store.read_log(spark, target).count() == 4


def test_writers_do_not_overwrite_each_other(spark, tmp_path):
    path = str(tmp_path / "store")
    store.upsert(articles(spark, (1, "http://a", "a", "x")), path, 0, "one")
    store.upsert(articles(spark, (1, "http://b", "b", "y")), path, 0, "two")
    assert sorted(r["url"] for r in store.read_collection(spark, path).collect()) == ["http://a", "http://b"]


def test_partial_write_keeps_the_other_fields(spark, tmp_path):
    path = str(tmp_path / "store")
    full = articles(spark, (1, "http://a", "old", "text")).withColumn("summary", F.lit("short"))
    store.upsert(full, path, 0)
    partial = articles(spark, (1, "http://a", "new", None)).withColumn("present", F.array(F.lit("title")))
    store.upsert(partial, path, 0, "other")
    got = store.read_collection(spark, path).first()
    assert (got["title"], got["content"], got["summary"]) == ("new", "text", "short")


def test_replay_keeps_its_place(spark, tmp_path):
    path = str(tmp_path / "store")
    for _ in range(2):
        store.upsert(articles(spark, (1, "http://a", "first", "x")), path, 0, "one")
        if not _:
            store.upsert(articles(spark, (1, "http://a", "second", "y")), path, 0, "two")
    assert store.read_collection(spark, path).first()["title"] == "second"


def test_ties_are_broken_by_the_row(spark, tmp_path):
    titles = set()
    for i, rows in enumerate([[("t", "x"), ("u", "y")], [("u", "y"), ("t", "x")]]):
        path = str(tmp_path / f"store{i}")
        store.upsert(articles(spark, *[(1, "http://a", t, c) for t, c in rows]), path, 0)
        titles.add(store.read_collection(spark, path).first()["title"])
    assert len(titles) == 1


def test_reads_only_wanted_columns(spark, tmp_path):
    path = str(tmp_path / "store")
    store.upsert(articles(spark, (1, "http://a", "t", "x")), path, 0)
    narrow = store.read_collection(spark, path).select("_id", "publication_date")
    scan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "publication_date" in scan and "content" not in scan.split("ReadSchema")[1]


def test_empty_collection(spark, tmp_path):
    assert store.read_collection(spark, str(tmp_path / "none")).count() == 0


def test_point_reads_push_the_key_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "store")
    store.upsert(articles(spark, (1, "http://a", "t", "x"), (2, "http://b", "u", "y")), path, 0)
    found = store.get_article_by_url(store.read_collection(spark, path), "http://a")
    assert [r["title"] for r in found.collect()] == ["t"]
    assert "EqualTo(_id," in found._jdf.queryExecution().executedPlan().toString()


def test_fields_merge_by_presence(spark):
    writes = spark.createDataFrame(
        [("k", 1, "a", "b", ["x", "y"]), ("k", 2, None, "ignored", ["x"]), ("k", 3, "ignored", "c", ["y"])],
        "_id string, seq long, x string, y string, present array<string>",
    )
    assert store.merge_fields(writes, ["seq"]).collect() == [("k", None, "c")]


def test_scraped_at_is_kept_if_given(spark):
    df = spark.createDataFrame(
        [("http://a", dt.datetime(2020, 1, 1)), ("http://b", None)], "url string, scraped_at timestamp"
    )
    got = {r["url"]: r["scraped_at"] for r in store.with_key(df, AS_OF).collect()}
    assert got == {"http://a": dt.datetime(2020, 1, 1), "http://b": AS_OF}


def test_recent_by_text_order_and_by_time(spark):
    df = spark.createDataFrame(
        [("1", "2024-06-01"), ("2", "November 5, 2024"), ("3", None), ("4", "2023-01-01")], "_id string, publication_date string"
    )
    by_text = store.recent_articles(df, AS_OF, 180).collect()
    assert [r["_id"] for r in by_text] == ["2", "1"]
    assert [r["_id"] for r in store.recent_articles(df, AS_OF, 180, limit=1).collect()] == ["2"]
    assert [r["_id"] for r in store.recent_articles_by_time(df, AS_OF, 180).collect()] == ["2", "1"]


DOCS = [
    ("1", "Water on Mars", "NASA found water. The été was dry."),
    ("2", "Dragons", "Living dragons breathe fire on Mars"),
    ("3", "Pre-market", "Stocks rise before the market opens"),
    ("4", "Test", "marsupial water"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "_id string, title string, content string")


@pytest.mark.parametrize(
    "q,want",
    [
        ("mars", ["1", "2"]),
        ("MARS dragons", ["1", "2"]),
        ("ete", ["1"]),
        ("water -mars", ["4"]),
        ('water "found water"', ["1"]),
        ('"on mars"', ["1", "2"]),
        ('mars -"breathe fire"', ["1"]),
        ("pre-market", ["3"]),
        ("the of", []),
        ("-mars", []),
        ("nothing", []),
    ],
)
def test_search_by_scan_and_by_index(spark, docs, q, want):
    scanned = [r["_id"] for r in search.matches(docs, q).orderBy("_id").collect()]
    indexed = search.matches_indexed(docs, search.build_postings(docs), q)
    assert scanned == want
    assert [r["_id"] for r in indexed.orderBy("_id").collect()] == want


def test_search_in_list_fields(spark):
    df = spark.createDataFrame([("1", ["test", "spark"])], "_id string, keywords array<string>")
    assert search.matches(df, "spark").count() == 1


def test_written_index_gives_the_same(spark, docs, tmp_path):
    path = str(tmp_path / "postings")
    search.write_postings(docs, path)
    found = search.matches_indexed(docs, spark.read.parquet(path), "mars water")
    assert sorted(r["_id"] for r in found.collect()) == ["1", "2", "4"]


@pytest.mark.parametrize(
    "total,limit,skip,page,pages", [(42, 10, 0, 1, 5), (42, 10, 10, 2, 5), (40, 10, 0, 1, 4), (0, 10, 0, 1, 0), (5, 0, 0, 1, 1)]
)
def test_page_maths(spark, total, limit, skip, page, pages):
    assert search.meta(spark.range(total), limit, skip).collect() == [(total, page, pages)]


def test_pages_add_up_to_the_whole_result(spark, docs):
    whole = [r["_id"] for r in search.matches(docs, "water mars market").orderBy("_id").collect()]
    parts = []
    for skip in range(0, 6, 2):
        found, _ = search.search(docs, "water mars market", limit=2, skip=skip)
        parts += [r["_id"] for r in found.collect()]
    assert parts == whole and len(whole) == 4


def test_search_guards(docs):
    assert search.search(None, "x") == (None, {"total": 0, "page": 1, "total_pages": 1})
    with pytest.raises(ValueError):
        search.search(docs, "")
    with pytest.raises(ValueError):
        search.search(docs, "x", skip=-1)
    assert search.search(docs, "mars", limit=0)[0].count() == 0


def test_preview_at_the_limit(spark):
    df = spark.createDataFrame(
        [("a", "t", "x" * 300, None, "en"), ("b", "t", "x" * 301, "", "de")],
        "_id string, title string, content string, publication_date string, language string",
    )
    a, b = reporting.previews(df).orderBy("_id").collect()
    assert a["content_preview"] == "x" * 300 and b["content_preview"] == "x" * 300 + "..."
    assert (a["publication_date"], b["publication_date"], b["language"]) == ("Unknown", "Unknown", "DE")
