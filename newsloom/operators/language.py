"""Language identification: naive Bayes over character n-grams (Cavnar & Trenkle 1994, Lui & Baldwin 2012)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import materialise

DEFAULT_LANGUAGE = "en"
#: Log probabilities are whole millionths: their sums are exact, so no tie depends on how the data was split.
SCALE = 1_000_000
#: ISO 639-1 has fewer codes than this. With ``per_language`` it bounds the size of the broadcast model.
MAX_LANGUAGES = 200
#: Parts in which a language's n-grams are ranked before the best of all parts are.
PARTS = 64


def letter_words(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def grams(text: Column) -> Column:
    """Character 1- to 3-grams of the words of a text; ``_`` marks a word's ends in the longer ones.

    Look-ahead finds overlapping matches, so each length is one pass of a compiled pattern. Between two words stand two
    marks, and no gram may hold both.
    """
    marked = F.concat(F.lit("_"), F.regexp_replace(F.lower(text), r"[^\p{L}]+", "__"), F.lit("_"))
    found = [r"([^_])", r"(?=((?!__)..))", r"(?=((?!.?__)...))"]
    return F.concat(*[F.regexp_extract_all(marked, F.lit(pattern), F.lit(1)) for pattern in found])


def _wide(rows: DataFrame, *keys: str) -> DataFrame:
    """Short rows that become many, over the session's shuffle width; adaptive execution would merge them by their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@dataclass(frozen=True)
class LanguageModel:
    """``table`` has one row per n-gram and one column of scaled log probabilities per language."""

    languages: list[str]
    table: DataFrame


def train(docs: DataFrame, text: str = "text", language: str = "lang", per_language: int = 1000, alpha: int = 1) -> LanguageModel:
    """Fit on labelled texts, keeping the ``per_language`` most frequent n-grams of each language.

    Words are counted first, so n-grams are cut once per distinct word and not once per use. (``explode_outer`` cuts them
    once; before a plain ``explode`` Spark cuts them a second time, to filter out rows without any.) The model has at most
    ``per_language`` rows per language whatever the size of the corpus.
    """
    labelled = docs.filter(F.col(language).isNotNull())
    languages = sorted(r[0] for r in labelled.select(language).distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"More than {MAX_LANGUAGES} language labels: the model would not stay small")
    counts = (
        labelled.select(F.col(language).alias("lang"), F.explode_outer(letter_words(F.col(text))).alias("word"))
        .filter(F.col("word").isNotNull())
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
        .transform(_wide, "lang", "word")
        .select("lang", "n", F.explode_outer(grams(F.col("word"))).alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    counts = materialise(counts, "gram-counts")
    wide = counts.groupBy("gram").pivot("lang", languages).agg(F.sum("n")).na.fill(0)
    # The most frequent grams per language, in two steps: the best of each of PARTS parts, then the best of those.
    order = [F.col("n").desc(), F.col("gram")]
    part = F.pmod(F.xxhash64("gram"), F.lit(PARTS))
    local = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    best = counts.withColumn("part", part).withColumn("rank", local).filter(F.col("rank") <= per_language).drop("part")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    chosen = best.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("gram").distinct()
    kept = wide.join(chosen, "gram")
    # One row of totals, at most one number per language.
    totals = kept.agg(*[F.sum(F.col(f"`{lang}`")).alias(lang) for lang in languages], F.count(F.lit(1)).alias("_size")).first()
    logs = [
        F.round(F.log((F.col(f"`{lang}`") + alpha) / (totals[lang] + alpha * totals["_size"])) * SCALE)
        .cast("long")
        .alias(lang)
        for lang in languages
    ]
    return LanguageModel(languages, materialise(kept.select("gram", *logs), "language-model"))


def word_scores(docs: DataFrame, text: str, model: LanguageModel) -> DataFrame:
    """(word, one scaled score per language) of the distinct words of all texts that hold a known n-gram."""
    distinct = _wide(docs.select(F.explode_outer(letter_words(F.col(text))).alias("word")).distinct(), "word")
    return (
        distinct.select("word", F.explode_outer(grams(F.col("word"))).alias("gram"))
        .join(F.broadcast(model.table), "gram")
        .groupBy("word")
        .agg(*[F.sum(F.col(f"`{lang}`")).alias(lang) for lang in model.languages])
    )


def detect(docs: DataFrame, key: str, text: str, model: LanguageModel) -> DataFrame:
    """Most likely language per text: (key, language). Texts without a known n-gram get the default.

    N-grams are cut and looked up once per distinct word of all texts. The words' scores are written, so that Spark
    knows their size and moves the texts' words only if the scores of all distinct words are too many to broadcast.
    """
    of_word = materialise(word_scores(docs, text, model), "word-scores")
    names = {lang: f"score_{i}" for i, lang in enumerate(model.languages)}
    of_word = of_word.select(F.col("word").alias("_word"), *[F.col(f"`{lang}`").alias(name) for lang, name in names.items()])
    scores = (
        docs.select(key, F.explode_outer(letter_words(F.col(text))).alias("_word"))
        .join(of_word, "_word", "left")
        .groupBy(key)
        .agg(*[F.sum(name).alias(name) for name in names.values()])
    )
    known = [F.when(F.col(name).isNotNull(), F.struct((-F.col(name)).alias("cost"), F.lit(lang).alias("lang"))) for lang, name in names.items()]
    best = F.try_element_at(F.array_sort(F.array_compact(F.array(*known))), F.lit(1))
    return scores.select(key, F.coalesce(best["lang"], F.lit(DEFAULT_LANGUAGE)).alias("language"))


def detect_held_out(docs: DataFrame, key: str, text: str, language: str = "lang", **fitting: int) -> DataFrame:
    """Most likely language of every text, told by a model that hasn't seen it: (key, language).

    Texts are dealt into two folds by a hash of their key, and each fold is told by the model of the other.
    """
    fold = F.substring(F.md5(F.col(key).cast("string")), 1, 1) < "8"
    halves = [docs.filter(fold), docs.filter(~fold | fold.isNull())]
    told = [detect(half, key, text, train(other, text, language, **fitting)) for half, other in (halves, halves[::-1])]
    return told[0].unionByName(told[1])
