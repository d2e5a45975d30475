"""Extractive summaries (after SumBasic, Nenkova & Vanderwende 2005)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import words
from newsloom.operators.terms import content_terms, sentences, spread


def summarize(docs: DataFrame, key: str, text: str, max_words: int = 150, min_words: int = 40) -> DataFrame:
    """Summary of each text: (key, summary, n_sentences).

    A sentence is worth the mean frequency of its content words in the text. The best sentences are taken while they
    fit into ``max_words``; while fewer than ``min_words`` are taken, the next one is taken too and cut at the budget.
    They are put back into the order of the text.
    """
    cut = (
        spread(docs, key, text)
        .select(key, F.posexplode(sentences(F.col("text"))).alias("at", "sentence"))
        .withColumn("n_words", F.size(words(F.col("sentence"))))
    )
    same_word = Window.partitionBy(key, "term")
    worth = (
        cut.select(key, "at", F.explode(content_terms(F.col("sentence"))).alias("term"))
        .withColumn("freq", F.count(F.lit(1)).over(same_word))
        .groupBy(key, "at")
        .agg((F.sum("freq") / F.count(F.lit(1))).alias("worth"))
    )
    # The sentence and its worth meet through a union over the same partitioning, not through a second shuffle.
    none = F.lit(None)
    both = cut.withColumn("worth", none.cast("double")).unionByName(
        worth.select(key, "at", none.cast("string").alias("sentence"), none.cast("int").alias("n_words"), "worth")
    )
    scored = both.groupBy(key, "at").agg(
        F.max("sentence").alias("sentence"),
        F.max("n_words").alias("n_words"),
        F.coalesce(F.max("worth"), F.lit(0.0)).alias("worth"),
    )
    best_first = Window.partitionBy(key).orderBy(F.col("worth").desc(), "at")
    before = F.sum("n_words").over(best_first.rowsBetween(Window.unboundedPreceding, -1))
    taken = (
        scored.withColumn("before", F.coalesce(before, F.lit(0)))
        .filter((F.col("before") + F.col("n_words") <= max_words) | (F.col("before") < min_words))
        .withColumn(
            "shown",
            F.when(F.col("before") + F.col("n_words") <= max_words, F.col("sentence")).otherwise(
                F.array_join(F.slice(F.split("sentence", " +"), F.lit(1), (max_words - F.col("before")).cast("int")), " ")
            ),
        )
    )
    return taken.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda s: s["shown"]), " "
        ).alias("summary"),
        F.count(F.lit(1)).alias("n_sentences"),
    )
