"""RAKE keywords (Rose et al. 2010): phrases between stop words, scored by word degree over word frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.terms import is_stop, spread, top_per_key

#: Scores are summed as whole millionths, so the sum does not depend on the order of its parts.
SCALE = 1_000_000


def phrases(text: Column) -> Column:
    """Runs of words without a stop word or punctuation inside, lower case."""
    cut = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} ]+", " | "), " +")
    marked = F.array_join(F.transform(cut, lambda w: F.when(is_stop(w), F.lit("|")).otherwise(w)), " ")
    return F.filter(F.transform(F.split(marked, r"\|"), lambda p: F.trim(p)), lambda p: p != "")


def rake(docs: DataFrame, key: str, text: str, n: int = 10) -> DataFrame:
    """Best ``n`` distinct phrases per text: (key, rank, keyword, score)."""
    found = (
        spread(docs, key, text)
        .select(key, F.explode(phrases(F.col("text"))).alias("keyword"))
        .groupBy(key, "keyword")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    same_word = Window.partitionBy(key, "word")
    scored = (
        found.withColumn("parts", F.split("keyword", " "))
        .select(key, "keyword", "times", F.size("parts").alias("length"), F.explode("parts").alias("word"))
        .withColumn("freq", F.sum("times").over(same_word))
        .withColumn("degree", F.sum(F.col("times") * F.col("length")).over(same_word))
        .groupBy(key, "keyword")
        .agg(F.sum(F.round(F.col("degree") * SCALE / F.col("freq")).cast("long")).alias("points"))
    )
    ranked = top_per_key(scored, key, [F.col("points").desc(), F.col("keyword").desc()], n)
    return ranked.select(key, "rank", "keyword", (F.col("points") / SCALE).alias("score"))
