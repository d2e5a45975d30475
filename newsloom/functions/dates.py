"""Publication dates: parsing in many formats, recency and ISO rendering."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.binding import let

_YMD = r"\d{4}-\d{1,2}-\d{1,2}"
_HM = r"\d{1,2}:\d{1,2}"

# The accepted formats in the order they are tried (day-first before month-first). Each has the shape
# that a string must have before Spark's parser is asked, so that a column of mixed formats raises no parser errors.
DATE_FORMATS = [
    (f"^{_YMD}T{_HM}:\\d{{1,2}}$", "yyyy-M-d'T'H:m:s"),
    (f"^{_YMD}T{_HM}:\\d{{1,2}}\\.\\d{{1,6}}$", "yyyy-M-d'T'H:m:s.SSSSSS"),
    (f"^{_YMD}T{_HM}:\\d{{1,2}}[Zz]$", "yyyy-M-d'T'H:m:s'Z'"),
    (f"^{_YMD}T{_HM}:\\d{{1,2}}\\.\\d{{1,6}}[Zz]$", "yyyy-M-d'T'H:m:s.SSSSSS'Z'"),
    (f"^{_YMD}T{_HM}$", "yyyy-M-d'T'H:m"),
    (f"^{_YMD} {_HM}:\\d{{1,2}}$", "yyyy-M-d H:m:s"),
    (f"^{_YMD} {_HM}$", "yyyy-M-d H:m"),
    (f"^{_YMD}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
]

_ANY_DATE = r"(\d{4})-(\d{1,2})-(\d{1,2})"


def parse_date(text: Column) -> Column:
    """Timestamp of a date string: the first matching format, else the first ``Y-M-D`` inside it, else null.

    Zone offsets belong to no format; such a string falls through to its date at midnight.
    """

    def first_match(tidy: Column) -> Column:
        attempts = [F.when(tidy.rlike(shape), F.try_to_timestamp(tidy, F.lit(fmt))) for shape, fmt in DATE_FORMATS]
        number = lambda i: F.regexp_extract(tidy, _ANY_DATE, i).try_cast("int")
        inside = F.try_make_timestamp(number(1), number(2), number(3), F.lit(0), F.lit(0), F.lit(0))
        return F.coalesce(*attempts, inside)

    # Runs of white space count as one space; letters such as T and Z are read in either case.
    tidy = F.upper(F.regexp_replace(text, r"(?U)\s+", " "))
    return let(let(tidy, first_match, "timestamp"), lambda parsed: F.when(F.year(parsed) >= 1, parsed), "timestamp")


def cutoff(as_of: dt.datetime, days: int) -> dt.datetime:
    return as_of - dt.timedelta(days=days)


def is_recent(publication_date: Column, as_of: dt.datetime, max_age_days: int = 180) -> Column:
    """True if published on or after the cutoff; a missing or unreadable date is never recent."""
    return F.coalesce(parse_date(publication_date) >= timestamp_literal(cutoff(as_of, max_age_days)), F.lit(False))


def timestamp_literal(moment: dt.datetime) -> Column:
    """A literal in the session zone (UTC), whatever the zone of the driver's machine."""
    return F.to_timestamp(F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")))


def iso_render(ts: Column) -> Column:
    """ISO 8601 text as Python's ``isoformat`` gives it: microseconds only when there are any."""
    micros = F.unix_micros(ts.cast("timestamp")) % 1_000_000
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros != 0, F.date_format(ts, ".SSSSSS")).otherwise(F.lit("")),
    )
