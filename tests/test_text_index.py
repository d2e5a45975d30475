from __future__ import annotations

import pytest
from helpers import evaluate
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import search, text_index

DOCS = [
    ("1", "Markets on Mars", "NASA found water. On the red, red planet.", "en"),
    ("2", "Škoda drives", "The markets' story of the year", "en"),
    ("3", "Der Markt", "die Autos der Frauen on the", "de"),
    ("4", None, "market of stories, the end on", None),
    ("5", "journaux", "les chevaux et les bateaux", "fr"),
    ("6", "", "", "es"),
]
SCHEMA = "_id string, title string, content string, language string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    text_index.write_index(spark.createDataFrame(DOCS, SCHEMA), path, 0)
    return text_index.read_index(spark, path)


@pytest.mark.parametrize(
    "q,want",
    [
        ("market", ["1", "2", "4"]),
        ("markets", ["1", "2", "4"]),
        ("skoda", ["2"]),
        ("ŠKODA nasa", ["1", "2"]),
        ("story", ["2", "4"]),
        ("market -nasa", ["2", "4"]),
        ('"on the"', []),  # stop words only: no word to look for, as in the scan
        ('mars "on the"', ["1"]),
        ('market "of the"', ["2"]),
        ('market "of story"', ["4"]),
        ('market -"of the"', ["1", "4"]),
        ('market "red red planet"', ["1"]),
        ('market "red red red"', []),
        ('market "mars nasa"', []),  # not across fields
        ("journal cheval bateau", ["5"]),
        ("frau", ["3"]),
        ("nothing", []),
    ],
)
def test_words_and_phrases_from_the_index(index, q, want):
    assert sorted(r["_id"] for r in text_index.search_index(index, q).collect()) == want


def test_last_batch_of_an_article_counts_and_replays_change_nothing(spark, tmp_path):
    path = str(tmp_path)
    docs = lambda rows: spark.createDataFrame(rows, SCHEMA)
    find = lambda q: sorted(r["_id"] for r in text_index.search_index(text_index.read_index(spark, path), q).collect())
    text_index.write_index(docs(DOCS), path, 0)
    for _ in range(2):
        text_index.write_index(docs([("1", "Dragons", "no water", "en"), ("7", "Fire", "market fire", "en"), ("4", None, None, "en")]), path, 1)
        assert find("market") == ["2", "7"] and find("dragon water") == ["1"]
        assert find('fire "market fire"') == ["7"] and find("nasa") == []


def test_positions_count_the_words_of_a_field(spark):
    rows = text_index.build_positions(spark.createDataFrame(DOCS, SCHEMA)).filter("_id = '1'").collect()
    got = {(r["field"], r["term"]): (r["tf"], r["positions"]) for r in rows}
    assert got["content", "red"] == (2, [5, 6]) and got["title", "market"] == (1, [0]) and got["content", "the"] == (1, [4])


def test_terms_are_pushed_down_to_the_scan(index):
    plan = text_index.search_index(index, "market")._jdf.queryExecution().toString()
    assert "In(term" in plan or "EqualTo(term,market)" in plan
    assert "content" not in plan


def test_letters_fold_in_any_latin_script(spark):
    cases = ["Škoda", "ŁÓDŹ", "Ænima", "Çeşme", "ø Ø đ", "Việt Nam", "naïve", "日本 ёж"]
    assert evaluate(spark, cases, text.fold) == ["skoda", "lodz", "ænima", "cesme", "o o d", "viet nam", "naive", "日本 ёж"]
    assert len(text.ACCENTED) == len(text.PLAIN)


@pytest.mark.parametrize("at_once", [1, 3, 10, 1000])
def test_deep_pages_add_up(spark, at_once):
    ids = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("_id"), "id")
    crowded = spark.range(40).select(F.concat(F.lit("77"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("_id"), "id")
    found = ids.unionByName(crowded).unionByName(spark.createDataFrame([("7", 1), ("zz", 2), ("", 3)], "_id string, id long"))
    whole = [r["_id"] for r in found.orderBy("_id").collect()]
    for skip, limit in [(0, 5), (7, 9), (230, 40), (255, 33), (536, 50), (543, 10), (10_000, 5), (0, 0), (200, -1), (0, 10_000)]:
        got = [r["_id"] for r in search.page(found, limit, skip, at_once=at_once).collect()]
        assert got == whole[skip : skip + max(limit, 0)], (skip, limit)
    pages, last = [], None
    while batch := [r["_id"] for r in search.page(found, 100, after_id=last).collect()]:
        pages += batch
        last = batch[-1]
    assert pages == whole
