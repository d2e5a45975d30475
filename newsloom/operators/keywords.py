"""Keyword methods by name, and their combination."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.entities import entities
from newsloom.operators.rake import rake
from newsloom.operators.terms import top_per_key
from newsloom.operators.tfidf import tfidf
from newsloom.operators.yake import yake

Method = Callable[[DataFrame, str, str, int], DataFrame]


def combined(docs: DataFrame, key: str, text: str, n: int = 10, with_entities: bool = True) -> DataFrame:
    """Keywords of several methods as one set per text, shortest first: (key, rank, keyword)."""
    methods: list[Method] = [yake, rake, entities] if with_entities else [yake, rake]
    lists = [method(docs, key, text, n).select(key, "keyword") for method in methods]
    pool = reduce(DataFrame.unionByName, lists).distinct()
    return top_per_key(pool, key, [F.length("keyword"), F.col("keyword")], n).select(key, "rank", "keyword")


METHODS: dict[str, Method] = {"yake": yake, "rake": rake, "tfidf": tfidf, "ner": entities, "combined": combined}


def extract_keywords(docs: DataFrame, key: str, text: str, method: str = "combined", n: int = 10) -> DataFrame:
    """Keywords by the named method, best first: (key, rank, keyword). An unknown name means YAKE."""
    if method not in METHODS:
        warnings.warn(f"Unknown keyword method {method!r}, so keywords come from YAKE", stacklevel=2)
    return METHODS.get(method, yake)(docs, key, text, n).select(key, "rank", "keyword")
