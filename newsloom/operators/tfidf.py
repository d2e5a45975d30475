"""TF-IDF keywords over a corpus of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.terms import bigrams, content_terms, spread, top_per_key


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of words and word pairs, stop words left out before pairing."""
    return (
        spread(docs, key, text)
        .select(key, content_terms(F.col("text")).alias("terms"))
        .select(key, F.explode(F.concat(F.col("terms"), bigrams(F.col("terms")))).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def vocabulary(
    counts: DataFrame, n_docs: Column, min_df: int = 2, max_df: float = 0.85, max_features: int = 200
) -> DataFrame:
    """The ``max_features`` most frequent terms whose document frequency is neither too low nor too high."""
    return (
        counts.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("corpus_tf"))
        .filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
        .orderBy(F.col("corpus_tf").desc(), "term")
        .limit(max_features)
    )


def tfidf(
    docs: DataFrame,
    key: str,
    text: str,
    n: int = 10,
    min_df: int = 2,
    max_df: float = 0.85,
    max_features: int = 200,
) -> DataFrame:
    """Best ``n`` terms per text by length-normalised TF-IDF with smoothed IDF: (key, rank, keyword, score).

    The vocabulary has at most ``max_features`` rows by definition, which is what makes its broadcast safe.
    """
    counts = term_counts(docs, key, text)
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    vocab = vocabulary(counts, n_docs, min_df, max_df, max_features).select(
        "term", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf")
    )
    weighted = counts.join(F.broadcast(vocab), "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    ranked = top_per_key(weighted.withColumn("norm", norm), key, [F.col("weight").desc(), F.col("term")], n)
    return ranked.select(key, "rank", F.col("term").alias("keyword"), (F.col("weight") / F.col("norm")).alias("score"))
