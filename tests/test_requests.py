"""Requests and pages that arrive in any order, against the batch run over the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from newsloom.plans import articles as jobs
from newsloom.plans.views import AS_OF
from newsloom.sources import store
from newsloom.streaming import requests

T0 = dt.datetime(2024, 7, 1, 12, 0)
HTML = (
    '<html lang="en"><head><title>Page %s</title><meta name="date" content="2024-06-01"></head>'
    "<body><p>This paragraph about solar panels is long enough to be the text of article %s.</p></body></html>"
)


def minute(n):
    return T0 + dt.timedelta(minutes=n)


ASKED = [
    [("http://a.com/early", 0), ("http://a.com/never", 1), ("not a url", 1), ("http://a.com/twice#top", 2), ("http://a.com/twice", 3)],
    [("http://a.com/late?utm_source=x", 30), ("http://a.com/too-late", 31)],
    [("http://end.com/", 900)],  # moves the watermark
]
FETCHED = [
    [(1, "http://a.com/twice", 0), (2, "http://a.com/late", 5)],
    [(3, "http://a.com/early", 40), (4, "http://a.com/twice", 41), (5, "http://a.com/unasked", 42)],
    [(6, "http://a.com/too-late", 200), (7, "http://end.com/", 900)],
]


def streams(spark, tmp_path):
    """Each list is a file; the files come one by one, in the order of their times."""
    sides = []
    for name, files, schema in (
        ("asked", [[(u, minute(m)) for u, m in rows] for rows in ASKED], "url string, asked_at timestamp"),
        ("fetched", [[(i, u, minute(m)) for i, u, m in rows] for rows in FETCHED], "page_id long, url string, fetched_at timestamp"),
    ):
        for rows in files:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        sides.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    return sides


def test_requests_before_and_after_their_pages_equal_the_batch_run(spark, tmp_path):
    asked, fetched = streams(spark, tmp_path)
    pages = spark.createDataFrame([(i, u, HTML % (i, i)) for rows in FETCHED for i, u, _ in rows], "page_id long, url string, html string")
    target, errors, progress = (str(tmp_path / n) for n in ("out", "errors", "progress"))
    run = lambda: requests.answer(asked, fetched, pages, target, errors, progress, AS_OF).awaitTermination()
    run()
    got = store.read_collection(spark, target).select("url", "title").collect()
    told = requests.read_errors(spark, errors).select("url", "error", "stage").collect()
    # The batch run knows no time: it is given the pages that came within the wait.
    once = [u for u in dict.fromkeys(u for rows in ASKED for u, _ in rows)]
    in_time = pages.filter("page_id != 6")
    batch = jobs.scrape(spark.createDataFrame([(u,) for u in once], "url string"), in_time, keep_link=lambda _: F.lit(False))
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.extracted.select("url", "title").collect()))
    assert sorted(map(tuple, told)) == sorted(map(tuple, batch.errors.select("url", "error", "stage").collect()))
    assert {r.url: r.title for r in got} == {
        "http://a.com/early": "Page 3", "http://a.com/twice": "Page 4", "http://a.com/late": "Page 2", "http://end.com/": "Page 7",
    }
    assert sorted(r.url for r in told) == ["http://a.com/never", "http://a.com/too-late", "not a url"]
    run()  # nothing new came
    assert sorted(map(tuple, store.read_collection(spark, target).select("url", "title").collect())) == sorted(map(tuple, got))
    assert requests.read_errors(spark, errors).count() == len(told)
