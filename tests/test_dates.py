from __future__ import annotations

import datetime as dt

import pytest
from helpers import evaluate

from newsloom.functions import dates

CASES = {
    "2024-11-05T10:30:15": dt.datetime(2024, 11, 5, 10, 30, 15),
    "2024-11-05T10:30:00.12": dt.datetime(2024, 11, 5, 10, 30, 0, 120000),
    "2024-11-05T10:30:15Z": dt.datetime(2024, 11, 5, 10, 30, 15),
    "2024-11-05t10:30:15z": dt.datetime(2024, 11, 5, 10, 30, 15),
    "2024-11-05T10:30:15.123456Z": dt.datetime(2024, 11, 5, 10, 30, 15, 123456),
    "2024-11-05T10:30": dt.datetime(2024, 11, 5, 10, 30),
    "2024-11-05 10:30:15": dt.datetime(2024, 11, 5, 10, 30, 15),
    "2024-11-05 10:30": dt.datetime(2024, 11, 5, 10, 30),
    "2024-11-05": dt.datetime(2024, 11, 5),
    "2024-1-5": dt.datetime(2024, 1, 5),
    "05/11/2024": dt.datetime(2024, 11, 5),
    "11/13/2024": dt.datetime(2024, 11, 13),
    "05-11-2024": dt.datetime(2024, 11, 5),
    "11-13-2024": dt.datetime(2024, 11, 13),
    "november 5, 2024": dt.datetime(2024, 11, 5),
    "November  5, 2024": dt.datetime(2024, 11, 5),
    "5 November 2024": dt.datetime(2024, 11, 5),
    "2024/11/05": dt.datetime(2024, 11, 5),
    "2024-11-05T10:30:00+02:00": dt.datetime(2024, 11, 5),
    "2024-11-05T10:30:00.1234567": dt.datetime(2024, 11, 5),
    "posted 2024-01-05 ok": dt.datetime(2024, 1, 5),
    "x2024-01-123": dt.datetime(2024, 1, 12),
    "Nov 5, 2024": None,
    "2024-02-30": None,
    "2024-13-40": None,
    "0000-01-01": None,
    "20241105": None,
    "32/01/2024": None,
    "": None,
    "2024-11-05T25:00:00": dt.datetime(2024, 11, 5),
}


def test_parse_date(spark):
    got = evaluate(spark, list(CASES), dates.parse_date)
    assert dict(zip(CASES, got)) == CASES


def test_null_date(spark):
    assert evaluate(spark, [None], dates.parse_date) == [None]


def test_recency_is_inclusive_and_drops_unreadable_dates(spark):
    as_of = dt.datetime(2024, 6, 30)
    values = ["2024-06-30", "2024-01-02", "2024-01-01", "2023-12-13", None, "soon"]
    got = evaluate(spark, values, lambda c: dates.is_recent(c, as_of, 180))
    assert got == [True, True, False, False, False, False]


@pytest.mark.parametrize("text", ["2024-11-05 10:30:15", "2024-11-05 10:30:15.12", "2024-11-05 00:00:00"])
def test_iso_render(spark, text):
    got = evaluate(spark, [text], lambda c: dates.iso_render(c.cast("timestamp")))
    assert got == [dt.datetime.fromisoformat(text).isoformat()]
