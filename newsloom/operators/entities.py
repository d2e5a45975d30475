"""Named-entity candidates: runs of capitalised words inside sentences, checked against the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import SENTENCE_BREAK, words
from newsloom.operators.terms import STOP, fragments, is_stop, spread, top_per_key

SALTS = 16


def capitalised_runs(text: Column) -> Column:
    """Runs of words with a capital first letter; the first word of a sentence proves nothing and is skipped."""

    def runs(sentence: Column) -> Column:
        # Only the first fragment of a sentence starts with its first word.
        inner = F.transform(
            fragments(sentence), lambda part, i: F.when(i == 0, F.slice(part, 2, F.size(part))).otherwise(part)
        )
        marked = F.transform(
            inner,
            lambda part: F.array_join(
                F.transform(part, lambda w: F.when(w.rlike(r"^\p{Lu}"), w).otherwise(F.lit("|"))), " "
            ),
        )
        return F.split(F.array_join(marked, "|"), r"\|")

    all_runs = F.flatten(F.transform(F.split(text, SENTENCE_BREAK), runs))
    return F.filter(F.transform(all_runs, lambda run: F.trim(run)), lambda run: run != "")


def inner_words(text: Column) -> Column:
    """Every word of a text but the first of each sentence."""
    return F.flatten(
        F.transform(F.split(text, SENTENCE_BREAK), lambda s: F.slice(words(s), 2, F.greatest(F.length(s), F.lit(1))))
    )


def name_words(docs: DataFrame, text: str, min_share: float = 0.5) -> DataFrame:
    """Words that are capitalised in at least ``min_share`` of their uses inside sentences."""
    uses = docs.select(F.explode(inner_words(F.col(text))).alias("written"))
    return (
        uses.groupBy("written")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.lower("written").alias("word"))
        .agg(
            F.sum("n").alias("uses"),
            F.sum(F.when(F.col("written").rlike(r"^\p{Lu}"), F.col("n")).otherwise(0)).alias("capitalised"),
        )
        .filter((F.col("capitalised") >= min_share * F.col("uses")) & (F.col("capitalised") > 0))
        .filter(~F.col("word").isin(STOP))
        .select("word")
    )


def entities(docs: DataFrame, key: str, text: str, n: int = 10, min_share: float = 0.5) -> DataFrame:
    """Most frequent ``n`` entity strings per text: (key, rank, keyword, times).

    A run counts if all its words are names. A common name may occur in a third of all texts, so the lookup in the
    corpus-wide word table joins on the word and a salt.
    """
    candidates = (
        spread(docs, key, text)
        .select(key, F.explode(capitalised_runs(F.col("text"))).alias("keyword"))
        .groupBy(key, "keyword")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    names = name_words(docs, text, min_share).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    parts = candidates.select(
        key,
        "keyword",
        "times",
        F.size(F.split("keyword", " ")).alias("length"),
        F.explode(F.split(F.lower("keyword"), " ")).alias("word"),
        F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt"),
    ).filter(~is_stop(F.col("word")))
    kept = (
        parts.join(names, ["word", "salt"])
        .groupBy(key, "keyword", "times", "length")
        .agg(F.count(F.lit(1)).alias("matched"))
        .filter(F.col("matched") == F.col("length"))
    )
    ranked = top_per_key(kept, key, [F.col("times").desc(), F.col("keyword")], n)
    return ranked.select(key, "rank", "keyword", "times")
