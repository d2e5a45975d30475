"""Spelling variants of a corpus's words: words one edit apart, found by pivotal grams (after Deng, Li & Feng 2014).

1. Words are counted: tasks add up their own words before anything is shuffled.
2. Bigrams are ordered by how rare they are among the distinct words. The three rarest of a word, and all that equal the
   third, are its prefix; two that don't overlap, the rarest together by dynamic programming, are its pivots.
3. One edit leaves one of two disjoint bigrams whole. So of two words one edit apart, that whose prefix ends earlier in the
   order has a pivot in the prefix of the other, at the same place or shifted by the difference of the lengths.
   Pivots are joined with prefixes on bigram, length and place, and each match is verified.
4. A word's form is its most frequent near word, if that is frequent enough; roots follow by doubling the steps.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import map_arrow, written

#: What counts as a word, after lower-casing A-Z.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Code points and occurrences of a word, at least; how much more frequent a form is.
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Every so many (document, word) pairs lose one letter, by their checksum.
TYPO_EVERY = 199
#: Words a task counts before it sends them on; characters of a long text that are cut into words at a time.
HELD_WORDS, PIECE = 300_000, 1 << 20
#: Counters of bigrams: one each for letters up to U+00FF; others share them, which costs speed and no result.
COUNTERS = 1 << 16


# --- words ------------------------------------------------------------------------------------------------------------


def runs(text: str) -> Iterator[list[str]]:
    """The words of a text, lower-cased; those of a long text in lists of about ``PIECE`` characters."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
    at = 0
    while len(low) - at > PIECE:
        end = at + PIECE
        while end < len(low) and RUN.match(low[end]) and RUN.match(low[end - 1]):
            end += 1
        yield RUN.findall(low[at:end])
        at = end
    yield RUN.findall(low[at:] if at else low)


def with_typo(word: str, prefix_crc: int, every: int = TYPO_EVERY) -> str:
    """The word, or what is left of it when its checksum after ``<doc_id>:`` is a multiple of ``every``."""
    h = zlib.crc32(word.encode(), prefix_crc)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", typos: bool = True) -> DataFrame:
    """(word, n): the words of at least ``MIN_LENGTH`` code points that occur ``MIN_COUNT`` times or more.

    ``typos`` takes a letter from some words by the rule of ``with_typo``. Texts are counted whole, long ones in pieces; a null
    text has no words, a null id reads as an empty one. Repeated rows count each time.
    """
    read = docs.select(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                prefix = zlib.crc32(f"{key}:".encode())
                for found in runs(text.as_py() or ""):
                    for word, n in Counter(found).items():
                        if len(word) >= MIN_LENGTH:
                            result = with_typo(word, prefix) if typos else word
                            if len(result) >= MIN_LENGTH:
                                total[result] += n
                if len(total) > HELD_WORDS:
                    yield out()
                    total.clear()
        if total:
            yield out()

    counted = map_arrow(read, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


# --- pivotal grams ----------------------------------------------------------------------------------------------------


def counter(gram: str) -> int:
    """The counter of a bigram."""
    return (ord(gram[0]) * 256 + ord(gram[1])) % COUNTERS


def bigram_counts(words: DataFrame) -> np.ndarray:
    """How often each counter's bigrams occur in the distinct words; ``COUNTERS`` numbers, however many words there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                for i in range(len(word) - 1):
                    total[counter(word[i : i + 2])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(COUNTERS, dtype=np.int64)
    for row in map_arrow(words.select("word"), run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row["gram"]] = row["n"]
    return out


Occurrence = tuple[int, str, int]  # rank of the bigram, the bigram, its place in the word


def rank(gram: str, counts: np.ndarray) -> int:
    """The place of a bigram in the order of all: rare ones first, then by counter. Bigrams of one counter rank alike."""
    return int(counts[counter(gram)]) * COUNTERS + counter(gram)


def prefix_of(word: str, counts: np.ndarray) -> list[Occurrence]:
    """The three rarest bigrams of a word in ascending order, with all further ones that rank like the third."""
    grams = sorted((rank(word[i : i + 2], counts), word[i : i + 2], i) for i in range(len(word) - 1))
    last = grams[min(2, len(grams) - 1)][0]
    return [g for g in grams if g[0] <= last]


def pivots_of(prefix: list[Occurrence], wanted: int = 2) -> list[Occurrence]:
    """``wanted`` bigrams of a prefix that don't overlap and are the rarest together; all of them if it has no so many.

    Dynamic programming over the places: ``best[k][i]`` is the least sum of k disjoint bigrams among the first i.
    """
    grams = sorted(prefix, key=lambda g: g[2])
    none = (float("inf"), ())
    best = [[(0, ())] * (len(grams) + 1)] + [[none] * (len(grams) + 1) for _ in range(wanted)]
    for i, (order, _, place) in enumerate(grams, 1):
        before = i - 1
        while before and grams[before - 1][2] > place - 2:
            before -= 1
        for k in range(1, wanted + 1):
            cost, chosen = best[k - 1][before]
            best[k][i] = min(best[k][i - 1], (cost + order // COUNTERS, (*chosen, i - 1)))
    cost, chosen = best[wanted][-1]
    return [grams[i] for i in chosen] if cost < float("inf") else prefix


def letters(word: str) -> int:
    """A bit for each letter of the word (letters share 63 bits). One edit changes two bits at most."""
    out = 0
    for letter in word:
        out |= 1 << ord(letter) % 63
    return out


#: ``last`` is the rank where the word's prefix ends.
_ROWS = pa.schema(
    [("gram", pa.string()), ("length", pa.int32()), ("place", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("last", pa.int64()), ("letters", pa.int64())]
)


def _indexed(words: DataFrame, counts: object, pivots: bool) -> DataFrame:
    """Bigrams of words: those of the prefix with the word's length and their places, or pivots where a near word may have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix = prefix_of(word, counts.value)
                own = (word, n, prefix[-1][0], letters(word))
                for _, gram, place in pivots_of(prefix) if pivots else prefix:
                    rows.append((gram, len(word), place, *own))
                    if pivots:  # an edit before the bigram shifts it by the difference of the lengths
                        rows.extend((gram, len(word) + d, place + s, *own) for d in (-1, 1) for s in (0, d) if place + s >= 0)
            columns = zip(*rows) if rows else [[]] * len(_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)

    return map_arrow(words.select("word", "n"), run, "gram string, length int, place int, word string, n long, last long, letters long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every two of the distinct words that differ by one inserted, deleted or replaced code point, once.

    Words have four code points or more, as shorter ones may have no two disjoint bigrams; shorter ones are refused.
    """
    if not words.where(F.char_length("word") < 4).isEmpty():
        raise ValueError("words of fewer than four code points have no two disjoint bigrams")
    counts = words.sparkSession.sparkContext.broadcast(bigram_counts(words))
    probes, index = _indexed(words, counts, True).alias("p"), _indexed(words, counts, False).alias("i")
    # Cheap conditions first: they leave few pairs to verify.
    met = probes.join(
        index,
        (F.col("p.gram") == F.col("i.gram"))
        & (F.col("p.length") == F.col("i.length"))
        & (F.col("p.place") == F.col("i.place"))
        & (F.col("p.last") <= F.col("i.last"))
        & (F.bit_count(F.col("p.letters").bitwiseXOR(F.col("i.letters"))) <= 2)
        & (F.levenshtein("p.word", "i.word", 1) == 1),
    )
    swap = F.col("p.word") > F.col("i.word")
    side = lambda one, other, c: F.when(swap, F.col(f"{one}.{c}")).otherwise(F.col(f"{other}.{c}"))
    return met.select(
        side("i", "p", "word").alias("a"), side("i", "p", "n").alias("n_a"), side("p", "i", "word").alias("b"), side("p", "i", "n").alias("n_b")
    ).distinct()


# --- forms ------------------------------------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, by doubling the steps. Forms are ever more frequent, so no chain is circular."""
    reach = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = reach.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = written(further, "roots")
        if further.where("moved").isEmpty():
            return further.select("word", "root")
        reach = further.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct words in (word, n), one row each.

    ``form`` is the most frequent near word (of equal ones the first in code-point order) if that has ``RATIO`` times the word's
    occurrences; ``root`` is where following the forms ends, and the word itself without one. Other columns are not read.
    An empty table gives an empty result.
    """
    words = written(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    both = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
                F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
            )
        ).alias("p")
    ).select("p.*")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    found = words.join(near, "word", "left")
    enough = -F.col("best.less") >= RATIO * F.col("n")
    judged = written(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).cast("long").alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(judged.where("form is not null"))
    rooted = judged.join(roots, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
