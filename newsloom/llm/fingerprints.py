"""Document fingerprints of closed syncmers.

A text is a sequence of words (cut after ``CHUNK`` characters, so that a text without spaces has some too). A run of K
words is a closed syncmer when the least of the hashes of its runs of S words stands at its first or last place. Whether
a run is chosen depends on nothing but its own words, so an edit moves no anchor elsewhere. The fingerprint is the
anchors in the order of the text, eight hex digits each; likeness is the share that both texts have at about the same place.

Only DataFrame functions are used. Everything about one text is computed within its row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.shared import written

#: Words of a run, words of its inner runs, and the most characters of a word.
K, S, CHUNK = 6, 2, 16
#: Stretches a text is cut into when two are compared, and the least anchors of one.
STRETCHES, LEAST_STRETCH = 16, 16
#: Documents that are sorted together to find each one's successor, about.
RANGE_ROWS = 4_000
#: At most so many ranges are told apart; the bounds go to every task.
MAX_RANGES = 40_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{CHUNK}}}"), F.lit(0))


def anchors(text: Column) -> Column:
    """The anchors of a text in order, each the hash of its run; a text of fewer than K words is one run.

    Empty for a text without words. The same holds if no run qualifies: then the words as a whole are the anchor.
    """

    def of_words(w: Column) -> Column:
        inner = F.transform(w, lambda word, i: F.xxhash64(word, F.get(w, i + 1)))

        def of_inner(h: Column) -> Column:
            last = F.size(h) - K  # the last run begins here

            def closed(x: Column, i: Column) -> Column:
                # Runs begin at 0..last; inner runs i..i+K-S belong to the run at i.
                least = F.least(*[F.get(h, i + d) for d in range(K - S + 1)])
                return (i <= last) & ((x == least) | (F.get(h, i + K - S) == least))

            at = F.filter(
                F.transform(h, lambda x, i: F.when(closed(x, i), i)),
                lambda i: i.isNotNull(),
            )
            runs = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + d) for d in range(0, K - S + 1, S)]))
            whole = F.array(F.xxhash64(F.concat_ws(" ", w)))
            return F.when(F.size(runs) > 0, runs).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))

        return _let(inner, of_inner)

    return _let(words(text), of_words)


def anchors_of(text: Column) -> Column:
    """The anchors of a text as a fingerprint holds them, their low 32 bits; null counts as empty."""
    return F.transform(anchors(F.coalesce(text, F.lit(""))), lambda a: a.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def as_text(found: Column) -> Column:
    """Eight hex digits for each anchor."""
    return F.lower(F.array_join(F.transform(found, lambda a: F.lpad(F.hex(a), 8, "0")), ""))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty, whose fingerprint is empty."""
    return as_text(anchors_of(text))


def likeness(a: Column, b: Column) -> Column:
    """``agreement`` of the anchors of two fingerprints: 1 for equal ones."""
    digits = F.lit("[0-9a-f]{8}")
    return agreement(F.regexp_extract_all(a, digits, F.lit(0)), F.regexp_extract_all(b, digits, F.lit(0)))


def agreement(a: Column, b: Column) -> Column:
    """The share of two texts' anchors, as arrays in the order of the texts, that the other has at about the same place.

    A place is a stretch of a ``STRETCHES``-th of the longer text, ``LEAST_STRETCH`` anchors at least, counted from the
    start; an anchor matches in the same stretch or a neighbouring one. So text that moved far, or is repeated in one of
    the texts only, doesn't match; repeats within one stretch count once. Two texts without anchors are alike.
    """

    def of(both: Column) -> Column:
        width = F.greatest(F.lit(LEAST_STRETCH), F.ceil(F.greatest(F.size(both[0]), F.size(both[1])) / STRETCHES)).cast("int")

        def at(w: Column) -> Column:
            def stretch(x: Column, i: Column) -> Column:
                return F.slice(x, i * w + 1, w)

            def around(x: Column, i: Column) -> Column:
                return F.slice(x, F.greatest(i - 1, F.lit(0)) * w + 1, F.when(i > 0, 3 * w).otherwise(2 * w))

            def counted(i: Column) -> Column:
                first, second = stretch(both[0], i), stretch(both[1], i)
                common = F.size(F.array_intersect(first, around(both[1], i))) + F.size(F.array_intersect(second, around(both[0], i)))
                return F.struct(common.alias("common"), (F.size(F.array_distinct(first)) + F.size(F.array_distinct(second))).alias("total"))

            def share(parts: Column) -> Column:
                def added(name: str) -> Column:
                    return F.aggregate(parts, F.lit(0), lambda so_far, part: so_far + part[name])

                return F.when(added("total") == 0, F.lit(1.0)).otherwise(added("common") / added("total"))

            return _let(F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), counted), share)

        return _let(width, at)

    return _let(F.array(a, b), of)


def _bounds_below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below a value, by a search in blocks and then in one block."""
    if not bounds:
        return F.lit(0)
    size = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    tops = F.lit([b[-1] for b in blocks[:-1]]).cast("array<bigint>")
    block = F.size(F.filter(tops, lambda b: b < value)) if len(blocks) > 1 else F.lit(0)
    within = F.get(F.lit(blocks).cast("array<array<bigint>>"), block)
    return block * size + F.size(F.filter(within, lambda b: b < value))


def with_successor(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's id, text and anchors, and those of the next row in ascending id order; after the last the first.

    Returns ``_id``, ``_own`` and ``_next`` (structs of text and print). Rows of one id follow each other in the order of
    their texts, rows without an id come first. The only row of a table is its own successor. Ids are cut into ranges by
    quantiles and sorted within these; only a range's last row looks for the first row of the next range.
    """
    rows = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("_order"),
        F.col(id_column).alias("_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"),
    )
    n = rows.count()
    cuts = max(1, min(MAX_RANGES, n // RANGE_ROWS + 1))
    shares = [i / cuts for i in range(1, cuts)]
    bounds = sorted(set(rows.agg(F.percentile_approx("_order", shares, 20 * cuts)).first()[0])) if shares else []
    ranged = rows.withColumn("_range", _bounds_below(F.col("_order"), bounds))
    starts = ranged.groupBy("_range").agg(F.min("_order").alias("_order")).orderBy("_range").collect()  # one row a range
    if not starts:
        return rows.select("_id", *[F.struct(F.col("_text").alias("text"), anchors_of(F.col("_text")).alias("print")).alias(c) for c in ("_own", "_next")])
    spark = docs.sparkSession
    first_ids = F.broadcast(spark.createDataFrame([(r["_order"],) for r in starts], "_order long"))  # MAX_RANGES at most
    places = [r["_range"] for r in starts]
    before = spark.createDataFrame(list(zip(places, places[-1:] + places[:-1])), "_range int, _before int")
    heads = (
        ranged.join(first_ids, "_order", "left_semi")
        .groupBy("_range")
        .agg(F.min(F.struct("_order", "_text"))["_text"].alias("_text"))
        .join(F.broadcast(before), "_range")
    )
    heads = heads.select(
        F.col("_before").alias("_range"), F.struct(F.col("_text").alias("text"), anchors_of(F.col("_text")).alias("print")).alias("_head")
    )
    heads = written(heads, "heads")
    # Anchors are computed where the texts have been sent, so that these are all that moves.
    own = F.explode(F.array(F.struct(F.col("_text").alias("text"), anchors_of(F.col("_text")).alias("print"))))
    there = ranged.repartition("_range").select("_range", "_order", "_id", own.alias("_own"))
    window = Window.partitionBy("_range").orderBy("_order", "_own.text")
    led = there.withColumn("_next", F.lead("_own").over(window))
    return led.join(heads, "_range", "left").select("_id", "_own", F.coalesce("_next", "_head").alias("_next"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many characters, or all, of the one that follows."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(following, F.lit(1), half))


def compare_with_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    A null text counts as empty. Repeated rows give repeated rows. An empty table gives an empty result.
    """
    pairs = with_successor(docs, id_column, text_column)
    changed = pairs.select(
        "_id", "_own", F.col("_next.print").alias("_following"),
        F.explode(F.array(edited(F.col("_own.text"), F.col("_next.text")))).alias("_edited"),
    )
    prints = changed.select(
        "_id", "_following",
        F.char_length("_own.text").cast("long").alias("n_chars"),
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        F.col("_own.print").alias("_print"),
        F.explode(F.array(anchors_of(F.col("_edited")))).alias("_changed"),
    )
    return prints.select(
        F.col("_id").alias(id_column), "n_chars", "edited_sha256",
        as_text(F.col("_print")).alias("fingerprint"),
        as_text(F.col("_changed")).alias("edited_fingerprint"),
        agreement(F.col("_print"), F.col("_changed")).alias("near_edited"),
        agreement(F.col("_print"), F.col("_following")).alias("near_next"),
    )
