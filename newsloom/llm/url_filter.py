"""URL verdicts: explicit rules first, then a logistic regression on hashed character n-grams of host and path.

Only DataFrame functions and Spark's own JVM learners are used: n-grams are cut and hashed by SQL functions, the model
is fitted by ``pyspark.ml`` on a small labelled table, and its weights are a literal array that scoring looks up.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of the hashed n-grams, and the n-grams' lengths.
BUCKETS, SIZES = 4096, (3, 4)
#: Labelled rows used for fitting, at most: the table is meant to be small.
MAX_LABELLED = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Parts of the labelled table that is used where the caller brings none: words of unwanted and of ordinary addresses.
UNWANTED = (
    "casino", "bets", "betting", "poker", "slots", "jackpot", "win", "free", "bonus", "ads", "track", "tracker",
    "click", "pixel", "banner", "popup", "pills", "viagra", "adult", "porn", "xxx", "loan", "payday", "spam",
)
ORDINARY = (
    "news", "garden", "history", "library", "museum", "school", "university", "science", "weather", "music", "recipes",
    "travel", "sports", "health", "city", "council", "forum", "photo", "books", "theatre", "river", "street", "market",
    "journal", "there", "other", "then", "these", "station", "nation", "table", "water", "order", "under", "press",
    "people", "house", "stone", "hand", "world", "land", "spring", "thing", "north", "south", "rest", "event", "present",
    "reading", "heat", "sheet", "mother", "weather", "gather", "earth", "health", "month", "three", "thanks", "answer",
    "winter", "summer", "letter", "action", "motion", "notion", "double", "noble", "cable", "friend", "kitchen",
    "question", "evening", "building", "engine", "island", "forest", "mountain", "harbour", "bridge", "village", "farm",
    "doctor", "teacher", "student", "author", "paper", "print", "theory", "method", "number", "letters", "language",
)


@dataclass(frozen=True)
class Rule:
    """A host and everything below it, and the beginning of the path."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: The rules of the production query.
RULES = (
    Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"), Rule("net/fr/", "block"),
)


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise("")


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host_: Column, path_: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict, or null. Of equal texts the first counts."""
    fitting = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host_ == rule.host) | F.endswith(host_, F.lit("." + rule.host))) & F.startswith(path_, F.lit(rule.path))
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        fitting = F.when(fits, value) if fitting is None else fitting.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if fitting is None else fitting


def buckets(host_: Column, path_: Column) -> Column:
    """The distinct buckets of all n-grams of host and path; the two are told apart by what surrounds them."""
    text = F.concat(F.lit("^"), host_, F.lit("$"), F.translate(path_, UPPER, LOWER), F.lit("$"))

    def of_size(t: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.char_length(t) - (n - 1), F.lit(1)))
        return F.transform(
            places, lambda i: F.pmod(F.xxhash64(F.substr(t, i, F.lit(n)), F.lit(n)), F.lit(BUCKETS)).cast("int")
        )

    def grams(t: Column) -> Column:
        return F.array_distinct(F.concat(*[of_size(t, n) for n in SIZES]))

    return F.transform(F.array(text), grams)[0]


def labelled_seed(spark: SparkSession) -> DataFrame:
    """A small labelled table (url, label; 1 is unwanted), made of every word in a few kinds of address."""
    hosts = ("{0}-{1}.example.org", "{0}.example.net", "www.{0}{1}.org", "m.{0}.example.net")
    paths = ("/en/1234", "/de/98", "/{0}/index.html", "/")
    rows = []
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for (a, b), h, p in itertools.product(zip(words, words[1:] + words[:1]), hosts, paths):
            rows.append((f"https://{h.format(a, b)}{p.format(a, b)}", label))
    return spark.createDataFrame(rows, "url string, label int")


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    intercept: float


def fit(labelled: DataFrame, url_column: str = "url", label_column: str = "label") -> Model:
    """Fit the regression on at most ``MAX_LABELLED`` labelled rows (in the order of a hash of the address).

    Rows without an address or a label are left out. Without rows of both labels nothing is judged unwanted.
    """
    rows = labelled.select(F.col(url_column).alias("u"), F.col(label_column).cast("double").alias("label")).where(
        "u is not null and label is not null"
    )
    chosen = rows.orderBy(F.xxhash64("u"), "u", "label").limit(MAX_LABELLED)
    found = chosen.select("label", F.explode(F.array(buckets(host(F.col("u")), path(F.col("u"))))).alias("b"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.array_contains(F.col("b"), i.cast("int")).cast("double"))
    sides = {r["label"] for r in chosen.select("label").distinct().limit(3).collect()}
    if len(sides) < 2:
        return Model((0.0,) * BUCKETS, -1.0)
    learner = LogisticRegression(maxIter=60, regParam=0.01, standardization=False)
    fitted = learner.fit(found.select("label", array_to_vector(dense).alias("features")))
    return Model(tuple(float(w) for w in fitted.coefficients.toArray()), float(fitted.intercept))


def unwanted(model: Model, host_: Column, path_: Column) -> Column:
    """The probability that an address is unwanted; one half or less for an empty address."""
    table = F.lit(list(model.weights))
    total = F.aggregate(buckets(host_, path_), F.lit(model.intercept), lambda s, b: s + F.get(table, b))
    empty = (host_ == "") & (path_ == "")
    return F.when(empty, F.lit(0.0)).otherwise(1 / (1 + F.exp(-total)))


def judge(
    pages: DataFrame,
    model: Model,
    rules: tuple[Rule, ...] = RULES,
    id_column: str = "page_id",
    url_column: str = "url",
    threshold: float = 0.5,
) -> DataFrame:
    """One row per row: id, host, path, the rule that decided (or null), the verdict and the model's probability.

    A null address, or one without ``://``, has an empty host and path; no rule fits it and it is allowed. Repeated rows
    give repeated rows; other columns don't matter.
    """
    parts = pages.select(F.col(id_column), host(F.col(url_column)).alias("_host"), path(F.col(url_column)).alias("_path"))
    judged = parts.select(
        id_column, "_host", "_path",
        F.explode(F.array(rule_of(F.col("_host"), F.col("_path"), rules))).alias("_rule"),
        unwanted(model, F.col("_host"), F.col("_path")).alias("unwanted"),
    )
    learned = F.when(F.col("unwanted") > threshold, "block").otherwise("allow")
    return judged.select(
        id_column, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), learned).alias("verdict"), "unwanted",
    )
