"""Bind an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column], result: str = "string") -> Column:
    """``body(value)`` with ``value`` computed once per row however often the body refers to it.

    Higher-order functions evaluate what their lambda mentions for every element; a lambda variable is already
    a value. So a costly expression is passed through a one-element array and met again as a variable.

    ``result`` names the type. The cast costs nothing at run time; it tells the analyser the type of a nested binding
    at once, where it would otherwise ask every level below again for each level above.
    """
    return F.transform(F.array(value), body)[0].cast(result)
