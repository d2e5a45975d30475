"""A stored text index: stemmed terms with their positions, kept up batch by batch; searches read no article.

    postings/batch=N   (term, _id, field, tf, positions), sorted by term and article
    articles/batch=N   (_id), what the batch indexed

An article that is indexed again counts with its last batch. A batch that is written again replaces its own directories.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import fold, words
from newsloom.operators.search import FIELDS, read_query, searchable

POSTINGS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("_id", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("tf", T.LongType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
        T.StructField("batch", T.IntegerType()),
    ]
)

#: Endings by language, tried in order: pattern and what stays. Plural endings only, after Harman's weak stemmer for English.
STEMS: dict[str, list[tuple[str, str]]] = {
    "en": [("^(.{2,}[^ea])ies$", "$1y"), ("^(.{2,}[^aeo]e)s$", "$1"), ("^(.{2,}[^us])s$", "$1")],
    "fr": [("^(.{2,})aux$", "$1al"), ("^(.{3,}eau)x$", "$1"), ("^(.{2,}[^s])s$", "$1")],
    "es": [("^(.{2,})ces$", "$1z"), ("^(.{2,}[dlnrj])es$", "$1"), ("^(.{2,}[aeou])s$", "$1")],
    "de": [("^(.{3,}[^s])(?:en|er|em|es)$", "$1"), ("^(.{3,})(?:e|n|s)$", "$1")],
}


def stem(term: Column, language: Column) -> Column:
    """A folded term without the ending that its language's first fitting rule takes off; as it is in other languages."""
    out = term
    for code, rules in STEMS.items():
        here = term
        for pattern, kept in reversed(rules):
            here = F.when(term.rlike(pattern), F.regexp_replace(term, pattern, kept)).otherwise(here)
        out = F.when(language == code, here).otherwise(out)
    return out


def build_positions(articles: DataFrame, fields: list[str] = FIELDS, language: str = "language") -> DataFrame:
    """(term, _id, field, tf, positions) of every word of every article, stop words included, as phrases may hold them.

    Positions count the words of a field from 0. Terms are folded, then stemmed by the article's language: each term of an
    article once, not each use. Null fields have no words; other columns are not read.
    """
    spoken = F.col(language) if language in articles.columns else F.lit("en")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), fold(v).alias("text")) for n, v in searchable(articles, fields)]))
    uses = articles.select("_id", F.coalesce(spoken, F.lit("en")).alias("lang"), each.alias("f")).select(
        "_id", "lang", F.col("f.field").alias("field"), F.posexplode(words(F.col("f.text"))).alias("at", "word")
    )
    # Words of one field are counted first; different words may have one stem.
    by_word = uses.groupBy("_id", "lang", "field", "word").agg(F.collect_list("at").alias("at"))
    stemmed = by_word.select("_id", "field", stem(F.col("word"), F.col("lang")).alias("term"), "at")
    gathered = stemmed.groupBy("_id", "field", "term").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("positions"))
    return gathered.select("term", "_id", "field", F.size("positions").cast("long").alias("tf"), "positions")


def write_index(articles: DataFrame, path: str, batch: int, fields: list[str] = FIELDS) -> None:
    """Index the articles of a batch, each ``_id`` once. Costs the batch: earlier ones are not read.

    Files are ranged by term and article, so a search reads the row groups its terms can be in, and a term of every article
    is split over many files.
    """
    keys = ["term", "_id"]
    ranged = build_positions(articles, fields).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged.write.mode("overwrite").parquet(f"{path}/postings/batch={batch}")
    # Last: a batch counts from here on, and a reader before that sees the articles as they were.
    articles.select("_id").write.mode("overwrite").parquet(f"{path}/articles/batch={batch}")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, articles): all batches' postings, and (_id, batch) with the last batch that has each article."""
    postings = spark.read.schema(POSTINGS).option("basePath", f"{path}/postings").parquet(f"{path}/postings")
    indexed = spark.read.schema("_id string, batch int").option("basePath", f"{path}/articles").parquet(f"{path}/articles")
    return postings, indexed.groupBy("_id").agg(F.max("batch").alias("batch"))


def _stems(word: str) -> list[Column]:
    """A query word as each language would have stored it."""
    return [stem(F.lit(word), F.lit(code)) for code in [*STEMS, "none"]]


def _stored_forms(spark: SparkSession, found: list[str]) -> dict[str, list[str]]:
    """The terms under which each word may be stored."""
    if not found:
        return {}
    row = spark.range(1).select(*[F.array_distinct(F.array(*_stems(w))).alias(f"w{i}") for i, w in enumerate(found)]).first()
    return {w: list(row[f"w{i}"]) for i, w in enumerate(found)}


def _phrase(terms: list[list[str]]) -> Column:
    """Whether one field has the terms one after the other: their positions, each shifted back by its place, meet."""

    def starts(forms: list[str], place: int) -> Column:
        here = F.filter("here", lambda h: h["term"].isin(forms))
        return F.transform(F.flatten(F.transform(here, lambda h: h["positions"])), lambda p: p - place)

    shifted = [starts(forms, place) for place, forms in enumerate(terms)]
    common = shifted[0]
    for other in shifted[1:]:
        common = F.array_intersect(common, other)
    return F.size(common) > 0


def search_index(index: tuple[DataFrame, DataFrame], q: str) -> DataFrame:
    """Ids of the articles that match ``q``, from the index alone.

    Any of the words (stemmed, stop words left out), all phrases, nothing that is negated. A phrase is a run of words in
    one field, whatever stands between them; its words are stemmed like others.
    """
    postings, articles = index
    spark = postings.sparkSession
    query = read_query(q)
    phrases = [_words_of(p) for p in query.phrases]
    without = [_words_of(p) for p in query.without_phrases]
    every = sorted({*query.terms, *query.without_terms, *(w for p in phrases + without for w in p)})
    forms = _stored_forms(spark, every)
    wanted = sorted({f for w in query.terms for f in forms[w]})
    unwanted = sorted({f for w in query.without_terms for f in forms[w]})
    asked = sorted({f for w in every for f in forms[w]})
    # Terms are literals: they are pushed down to the scan. Only postings of an article's last batch count.
    hits = postings.filter(F.col("term").isin(asked)).join(articles, ["_id", "batch"], "left_semi")
    tests = [F.col("term").isin(wanted).alias("hit"), F.col("term").isin(unwanted).alias("bad")]
    if not phrases and not without:
        found = hits.select("_id", *tests).groupBy("_id").agg(F.max("hit").alias("hit"), F.max("bad").alias("bad"))
        return found.filter(F.col("hit") & ~F.col("bad")).select("_id")
    # An article's postings of the asked terms, field by field: as many as the query has terms.
    fields = hits.groupBy("_id", "field").agg(
        F.max(F.col("term").isin(wanted)).alias("hit"), F.max(F.col("term").isin(unwanted)).alias("bad"),
        F.collect_list(F.struct("term", "positions")).alias("here"),
    )
    has = [F.max(_phrase([forms[w] for w in p]) if p else F.lit(True)).alias(f"p{i}") for i, p in enumerate(phrases)]
    has_not = [F.max(_phrase([forms[w] for w in p]) if p else F.lit(False)).alias(f"n{i}") for i, p in enumerate(without)]
    found = fields.groupBy("_id").agg(F.max("hit").alias("hit"), F.max("bad").alias("bad"), *has, *has_not)
    passed = F.col("hit") & ~F.col("bad")
    for i in range(len(has)):
        passed = passed & F.col(f"p{i}")
    for i in range(len(has_not)):
        passed = passed & ~F.col(f"n{i}")
    return found.filter(passed).select("_id")


def _words_of(phrase: str) -> list[str]:
    return re.findall(r"[^\W_]+", phrase)

