"""Building blocks of the keyword operators: words, phrases and sentences exploded from texts.

All of them work on a frame of (key, text). ``spread`` shuffles the texts once by key; what is grouped by the key and
something else afterwards stays where it is, because hash partitioning on the key already clusters it. Moving a text
is cheaper than moving its words, and texts are spread evenly however the source files were split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.stopwords import stop_tokens
from newsloom.functions.text import WORD, words

STOP = stop_tokens()


#: Bytes of text in a partition, on average. What is cut from a partition's texts is many times their size.
PART_BYTES = 16 << 20


def spread(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Texts that have content, as (key, text), hash-partitioned by key.

    The number of partitions follows the bytes of all texts, so that a task's memory does not grow with the table; it is
    at least the session's shuffle width. It is given explicitly: adaptive execution would merge partitions by the size
    of the texts, which says little about the many rows that are cut from them.
    """
    texts = docs.select(F.col(key), F.col(text).alias("text")).filter(F.col("text") != "")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    return texts.repartition(width, F.col(key))


def is_stop(word: Column) -> Column:
    return word.isin(STOP)


def sentences(text: Column) -> Column:
    """Sentences that hold at least one word, with their closing marks, trimmed."""
    raw = F.regexp_extract_all(text, F.lit(r"([^.!?\n]+[.!?]*)"), F.lit(1))
    return F.filter(F.transform(raw, lambda s: F.trim(s)), lambda s: s.rlike(WORD))


def fragments(text: Column) -> Column:
    """Stretches of words without punctuation between them, each an array of words as written."""
    parts = F.transform(F.split(text, r"[^\p{L}\p{N} ]+"), lambda p: F.filter(F.split(p, " "), lambda w: w != ""))
    return F.filter(parts, lambda p: F.size(p) > 0)


def content_terms(text: Column) -> Column:
    """Lower-case words of two characters or more that are no stop words."""
    return F.filter(words(F.lower(text)), lambda w: (F.length(w) >= 2) & ~is_stop(w))


def bigrams(terms: Column) -> Column:
    """Neighbouring terms joined by a space."""
    pairs = F.zip_with(terms, F.slice(terms, 2, F.greatest(F.size(terms), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.slice(pairs, 1, F.greatest(F.size(terms) - 1, F.lit(0)))


def top_per_key(scored: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key, ranked from 1. Spark cuts each task's rows to ``n`` per key before any shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n)


def as_lists(ranked: DataFrame, key: str, name: str = "keywords") -> DataFrame:
    """Ranked keyword rows folded to one array per key. At most the ``n`` of ``top_per_key`` entries meet."""
    entry = F.struct("rank", "keyword")
    return ranked.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["keyword"]).alias(name)
    )
