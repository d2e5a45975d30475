"""Language ID by Bayesian fusion of four kinds of evidence.

- the text: naive Bayes over hashed byte trigrams, trained on a bounded sample of labelled texts of each language; what
  no language explains is unknown;
- the language that the markup (or the table) declares, and the suffix of the address (a path segment or the country
  code of the host): how likely each is in each language is counted over all rows;
- the host: its prior is smoothed towards that of its suffix, which is smoothed towards that of all rows.

All counts are grouped aggregations of the languages that the texts alone suggest; a row's own vote is taken out of its
host's prior. The posterior is their product, normalised.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrays import batches_of, text_buffer
from newsloom.llm.shared import map_arrow, written

#: Labelled texts of a language used for training, about, and languages told apart, at most (the most frequent). A text that
#: declares a rarer one keeps it.
LABELLED_ROWS, MAX_LANGUAGES = 750, 400
#: Buckets of byte trigrams.
BUCKETS = 1 << 15
#: Overlapping trigrams are not independent: their log likelihood counts for this share.
TEMPER = 1 / 3
#: Votes that a suffix's, and all rows', language shares weigh in a host's prior.
HOST_WEIGHT, SUFFIX_WEIGHT = 5.0, 20.0
#: Posterior probability that a decision needs.
CONFIDENT = 0.5
#: Trigrams a text needs to be called unknown, and how many deviations below its language's median it must lie for that.
MIN_TRIGRAMS, DEVIATIONS = 100, 8.0
#: The outcome for texts that none of the model's languages explains.
UNKNOWN = "unknown"

_NONE = BUCKETS
#: Votes of texts without trigrams, and of unknown ones.
_SILENT, _STRANGE = -1, -2


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    table: np.ndarray  # (languages, BUCKETS + 1) of log probabilities; the last bucket is no trigram and weighs nothing
    bounds: tuple[float, ...] = ()  # the least mean log probability of a trigram in each language; without any, nothing is unknown


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram at each byte, none at a text's last two, and where each text begins."""
    raw, offsets = text_buffer(texts)
    low = raw.astype(np.uint32)
    low[(low >= 65) & (low <= 90)] += 32
    out = np.full(len(raw), _NONE, dtype=np.int32)
    if len(raw) > 2:
        code = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]
        with np.errstate(over="ignore"):
            out[:-2] = (code * np.uint32(0x9E3779B1)) >> np.uint32(17)
    for back in (1, 2):
        ends = offsets[1:] - back
        out[ends[ends >= offsets[:-1]]] = _NONE
    return out, offsets


def _code(value: Column) -> Column:
    """The primary part of a language code, in lower case; empty if there is none."""
    return F.regexp_extract(F.lower(F.trim(F.coalesce(value, F.lit("")))), "^([a-z]+)", 1)


def _log_table(counts: np.ndarray) -> np.ndarray:
    """Smoothed log probabilities of trigram counts, one row for each language."""
    table = np.zeros((len(counts), BUCKETS + 1), dtype=np.float32)
    smooth = counts + 0.5
    table[:, :BUCKETS] = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return table


def _sums(table: np.ndarray, grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The log likelihood of each text in each language, (texts, languages)."""
    out = np.zeros((len(offsets) - 1, len(table)))
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        for i in range(len(table)):
            out[full, i] = np.add.reduceat(table[i][grams].astype(np.float64), offsets[:-1][full])
    return out


def _lengths(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of trigrams of each text."""
    upto = np.concatenate([[0], np.cumsum(grams != _NONE)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def fit_text(labelled: DataFrame, text_column: str = "text", language_column: str = "lang", id_column: str = "doc_id") -> TextModel:
    """Train on about ``LABELLED_ROWS`` rows of every language that any row declares, chosen by a hash of id and text.

    Languages and their numbers come from all rows; a language with fewer rows is trained on all it has. Rows without a
    text or a language code teach nothing; without any the model is empty.

    Each half of the sample is scored by the other half's counts. A language's bound lies midway between what its texts
    score in their own language and what texts score in the best of the others, or ``DEVIATIONS`` deviations below the
    former, whichever is lower.
    """
    spark = labelled.sparkSession
    rows = labelled.select(
        _code(F.col(language_column)).alias("lang"), F.col(text_column).cast("string").alias("text"), F.col(id_column).alias("id")
    ).where("lang != '' and text is not null")
    known = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    names = sorted(r["lang"] for r in known)
    if not names:
        return TextModel((), np.zeros((0, BUCKETS + 1), dtype=np.float32))
    below = {r["lang"]: min(1 << 30, math.ceil((1 << 30) * LABELLED_ROWS / r["count"])) for r in known}
    place = {name: i for i, name in enumerate(names)}
    shares = spark.createDataFrame([(k, place[k], below[k]) for k in names], "lang string, place int, below long")
    digest = F.xxhash64("id", "text")
    sample = rows.join(F.broadcast(shares), "lang").where(F.pmod(digest, F.lit(1 << 30)) < F.col("below"))  # MAX_LANGUAGES rows
    sample = written(sample.select("place", F.pmod(F.shiftright(digest, 40), F.lit(2)).cast("int").alias("fold"), "text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, offsets = _trigrams(batch.column(2))
            group = np.asarray(batch.column(0)).astype(np.int64) * 2 + np.asarray(batch.column(1))
            keys = np.repeat(group, np.diff(offsets)) * BUCKETS + grams
            found, n = np.unique(keys[grams != _NONE], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    # Two counters for each language and bucket at most.
    summed = map_arrow(sample, count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(names) * 2 * BUCKETS)
    counts[summed.column("key").to_numpy()] = summed.column("n").to_numpy()
    counts = counts.reshape(len(names), 2, BUCKETS)
    halves = spark.sparkContext.broadcast([_log_table(counts[:, 0]), _log_table(counts[:, 1])])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in batches_of(batch.column(2), 1 << 19):
                part = batch.slice(a, b - a)
                grams, offsets = _trigrams(part.column(2))
                n, own, fold = _lengths(grams, offsets), np.asarray(part.column(0)), np.asarray(part.column(1))
                each = [_sums(table, grams, offsets) for table in halves.value]
                mean = np.where((fold == 0)[:, None], each[1], each[0]) / np.maximum(n, 1)[:, None]
                at = np.arange(len(n))
                mine = mean[at, own].copy()
                mean[at, own] = -np.inf
                columns = [pa.array(own, pa.int32()), pa.array(fold, pa.int32()), pa.array(n, pa.int64()), pa.array(mine), pa.array(mean.max(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, ["place", "fold", "n", "mine", "other"])

    # One narrow row for each text of the sample.
    scored = map_arrow(sample, cross, "place int, fold int, n long, mine double, other double").where(F.col("n") >= MIN_TRIGRAMS).toArrow()
    halves.unpersist()
    whole = _log_table(counts.sum(axis=1))
    return TextModel(tuple(names), whole, _bounds(counts.sum(axis=2), *[scored.column(c).to_numpy() for c in ("place", "fold", "mine", "other")]))


def _bounds(sizes: np.ndarray, place: np.ndarray, fold: np.ndarray, mine: np.ndarray, other: np.ndarray) -> tuple[float, ...]:
    """The bound of each language; of one whose texts all lie in one half, the lowest of the others'. None without any."""
    taught = sizes[place, 1 - fold] > 0  # the other half has texts of this language
    place, mine, other = place[taught], mine[taught], other[taught]
    if not len(place):
        return ()
    strange = np.median(other[np.isfinite(other)]) if np.isfinite(other).any() else np.inf
    out = np.full(len(sizes), np.nan)
    for i in set(place.tolist()):
        middle = np.median(mine[place == i])
        deviation = 1.4826 * np.median(np.abs(mine[place == i] - middle))
        out[i] = min((middle + 2 * strange) / 3, middle - DEVIATIONS * deviation)
    return tuple(np.where(np.isnan(out), np.nanmin(out), out).tolist())


def _place(value: Column, languages: tuple[str, ...]) -> Column:
    """The number of a language code's primary part, -1 if it is missing, and the number of languages if it is another."""
    code = _code(value)
    at = F.array_position(F.array(*[F.lit(x) for x in languages]), code).cast("int") if languages else F.lit(0)
    return F.when(code == "", -1).when(at == 0, len(languages)).otherwise(at - 1)


def suffix(address: Column) -> Column:
    """A two-letter path segment right after the host, or else the host's last label."""
    after = F.regexp_extract(F.lower(F.coalesce(address, F.lit(""))), r"://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1)
    last = F.regexp_extract(F.lower(F.coalesce(address, F.lit(""))), r"://[^/?#]*?\.?([a-z]+)(?::\d+)?(?:[/?#]|$)", 1)
    return F.when(after != "", after).otherwise(last)


def evidence(
    docs: DataFrame, model: TextModel, key: list[Column], text: Column, declared: Column, address: Column, host: Column
) -> DataFrame:
    """The key columns, the log likelihood of the text in each language (``ll``), its best language (``vote``, -1 without
    trigrams, -2 where no language explains the text), and the numbers of the declared language (``declared``) and the suffix (``suffix``); ``host`` as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(model.table)
    n, bounds = len(model.languages), np.array(model.bounds)
    base = docs.select(
        *key, _place(declared, model.languages).alias("declared"), _place(suffix(address), model.languages).alias("suffix"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(text.cast("string"), F.lit("")).alias("_text"),
    )
    names = [c for c in base.columns if c != "_text"]
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names))
            for a, b in batches_of(texts, 1 << 19):
                part = batch.slice(a, b - a)
                grams, offsets = _trigrams(part.column(len(names)))
                scores = _sums(shared.value, grams, offsets)
                length = _lengths(grams, offsets)
                vote = np.where(length > 0, scores.argmax(axis=1) if n else _SILENT, _SILENT)
                if n and len(bounds):
                    # Each trigram counts in the language that explains it best: a text in two languages is not strange.
                    mean = _sums(shared.value.max(axis=0)[None], grams, offsets)[:, 0] / np.maximum(length, 1)
                    vote[(length >= MIN_TRIGRAMS) & (mean < bounds.min())] = _STRANGE
                ll = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * n, pa.int32()), pa.array(scores.reshape(-1) * TEMPER))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(names))] + [ll, pa.array(vote, pa.int32())], [*names, "ll", "vote"]
                )

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + ["ll array<double>", "vote int"])
    return map_arrow(base.select(*names, "_text"), run, schema)


def _shares(counts: np.ndarray, towards: np.ndarray, weight: float) -> np.ndarray:
    return (counts + weight * towards) / (counts.sum(axis=-1, keepdims=True) + weight)


def fuse(found: DataFrame, model: TextModel, key: list[str]) -> DataFrame:
    """The key columns, ``language``, its ``confidence``, and ``text_language``; all rows of :func:`evidence`.

    A row whose text no language explains is ``unknown``, with confidence 0, whatever else speaks for it, and has no vote.
    A row without any evidence gets the most frequent language with that language's share. Without a model (no labelled
    text) languages are null and confidences 0.
    """
    n = len(model.languages)
    if not n:
        none = F.lit(None).cast("string")
        return found.select(*key, none.alias("language"), F.lit(0.0).alias("confidence"), none.alias("text_language"))
    voted = found.where("vote >= 0")
    small = voted.groupBy("declared", "suffix", "vote").count().collect()  # at most (languages + 2)^2 x languages rows
    by_declared, by_suffix = np.zeros((n + 2, n)), np.zeros((n + 2, n))
    for r in small:
        by_declared[r["declared"] + 1, r["vote"]] += r["count"]
        by_suffix[r["suffix"] + 1, r["vote"]] += r["count"]
    everywhere = _shares(by_suffix.sum(axis=0), np.full(n, 1 / n), 1.0)
    of_suffix = _shares(by_suffix, everywhere, SUFFIX_WEIGHT)

    def told_by(counts: np.ndarray) -> list[list[float]]:
        given = (counts + 0.5) / (counts + 0.5).sum(axis=0, keepdims=True)
        given[0] = 1.0  # nothing declared says nothing
        return np.log(given).tolist()

    per_host = (
        voted.where("host != ''")
        .groupBy("host")
        .agg(*[F.sum((F.col("vote") == i).cast("long")).alias(f"h{i}") for i in range(n)])
        .select("host", F.array(*[F.col(f"h{i}").cast("double") for i in range(n)]).alias("votes"))
    )
    zero = F.array(*[F.lit(0.0)] * n)
    joined = found.join(per_host, "host", "left").withColumn("votes", F.coalesce("votes", zero))
    joined = joined.withColumn("n_votes", F.aggregate("votes", F.lit(0.0), lambda s, v: s + v))
    towards, told_table = F.lit(of_suffix.tolist()), F.lit(told_by(by_declared))

    def score(ll: Column, i: Column) -> Column:
        own = F.when(F.col("vote") == i, 1.0).otherwise(0.0)
        votes = F.greatest(F.get("votes", i) - own, F.lit(0.0))
        total = F.greatest(F.col("n_votes") - F.when(F.col("vote") >= 0, 1.0).otherwise(0.0), F.lit(0.0))
        prior = (votes + HOST_WEIGHT * F.get(F.get(towards, F.col("suffix") + 1), i)) / (total + HOST_WEIGHT)
        told = F.get(F.get(told_table, F.col("declared") + 1), i)
        # The suffix speaks through the prior, towards which the host's votes are smoothed.
        return ll + F.log(prior) + told

    scored = joined.withColumn("s", F.transform("ll", score))
    top = scored.withColumn("m", F.array_max("s"))
    weight = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m")))
    names = F.array(*[F.lit(x) for x in model.languages])
    strange = F.col("vote") == _STRANGE
    return top.select(
        *key,
        F.when(strange, F.lit(UNKNOWN)).otherwise(F.get(names, F.array_position("s", F.col("m")).cast("int") - 1)).alias("language"),
        F.when(strange, F.lit(0.0)).otherwise(1 / weight).alias("confidence"),
        F.when(F.col("vote") >= 0, F.get(names, F.col("vote"))).alias("text_language"),
    )


def identify(
    docs: DataFrame, model: TextModel, key: list[Column], text: Column, declared: Column, address: Column, host: Column
) -> DataFrame:
    """One row for each row: key columns, ``language``, ``confidence`` and ``text_language``.

    Missing texts, declarations, addresses and hosts (null or empty) are no evidence. Repeated rows each vote. Of equally
    likely languages the first in alphabetical order wins. An empty table gives an empty result.
    """
    found = written(evidence(docs, model, key, text, declared, address, host), "evidence")
    names = [c for c in found.columns if c not in ("declared", "suffix", "host", "ll", "vote")]
    return fuse(found, model, names)


def keep_identified(docs: DataFrame, text_column: str = "text", language_column: str = "lang", host_column: str = "source", id_column: str = "doc_id") -> DataFrame:
    """The rows whose language is certain enough, with all their columns; their language column tells what was found.

    A row that declares a language outside the model stays as it is, and a code that says the same ("en-GB") is left alone.
    Documents carry no address, so its suffix is no evidence here. Rows of one id and one text share their verdict.
    """
    model = fit_text(docs, text_column, language_column, id_column)
    digest = F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    found = identify(
        docs, model, [F.col(id_column).alias("_id"), digest.alias("_digest"), F.col(language_column).alias("_declared")],
        F.col(text_column), F.col(language_column), F.lit(None).cast("string"), F.col(host_column),
    )
    # Most rows keep what they declare: only the others are looked up.
    told = _code(F.col("_declared"))
    foreign = _place(F.col("_declared"), model.languages) == len(model.languages)
    same = F.col("language").eqNullSafe(told) & (F.col("confidence") >= CONFIDENT)
    changed = written(
        found.where(~foreign & ~same)
        .select("_id", "_digest", F.col("_declared"), F.when(F.col("confidence") >= CONFIDENT, F.col("language")).alias("_found"))
        .dropDuplicates(["_id", "_digest", "_declared"]),
        "changed",
    )
    columns = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(id_column).alias("_i"), digest.alias("_d"), F.col(language_column).alias("_l"))
    looked = row.join(changed.withColumn("_hit", F.lit(True)), F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_digest")) & F.col("_l").eqNullSafe(F.col("_declared")), "left")
    kept = looked.where("_hit is null or _found is not null")
    out = [F.coalesce(F.col("_found"), F.col(f"_row.`{c}`")).alias(c) if c == language_column else F.col(f"_row.`{c}`").alias(c) for c in columns]
    return kept.select(*out)
