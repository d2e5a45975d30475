"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations only read the bits.

The ledger holds for each document what was measured and one bit per failed rule. A policy is a named, versioned set of
rules; a document fails it when its bits meet the policy's mask. Policies can be changed, compared and ablated later
without reading a text again.

Only DataFrame functions are used. Everything is measured within a row: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import free_name

#: White space between words: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits: name and condition of failure over the measurements. Never reorder; append.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("shouting", "2 * n_upper > word_chars and n_upper > 50"),
    ("exclamations", "2 * n_exclaimed > n_words and n_words > 0"),
]
#: Columns of the ledger and of verdicts besides the id.
LEDGER = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaimed", "failed", "kept", "policy",
]
BITS = {name: 1 << at for at, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named and versioned choice of rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(BITS))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda's argument is not copied into its uses."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. ``words`` must be a name bound by a lambda.

    Windows are compared by 64-bit hash. Most texts stop at the first comparison; only texts with a repeated window
    sort their windows to find which words these cover.
    """
    n = F.size(words)

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of(pairs: Column) -> Column:
            # getItem() beyond the ends gives null, which equals nothing
            twice = F.filter(
                pairs,
                lambda p, j: (F.get(pairs, j - 1)["h"] == p["h"]) | (F.get(pairs, j + 1)["h"] == p["h"]),
            )
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2)))))

        return _let(ordered, of)

    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    some = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))
    return F.when(n < 3, 0).otherwise(some)


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The measurements of every row: words, characters, symbols, repeated lines and windows.

    A null text has no words; long texts are measured whole. Repeated rows give repeated rows, an empty table none. Only
    the id and the text are read; an id called like a column of the result or of the ledger gets an underscore behind its name.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    bare = F.trim(text, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line, F.lit(SPACES)) != "")
    counted = _let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    distinct = _let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    once = F.struct(counted.alias("w"), distinct.alias("l"))
    # A generator keeps the optimiser from copying the expressions into every use.
    return docs.select(
        F.col(id_column).alias("_id"),
        F.explode(F.array(once)).alias("_m"),
        (F.char_length(text) - _count(text, SPACES)).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÉÈÊËÎÏÑÓÔÖÙÛÜÍÚÁ").cast("long").alias("n_upper"),
        _count(text, "!").cast("long").alias("n_exclaimed"),
    ).select(
        F.col("_id").alias(free_name(id_column, LEDGER)), "_m.w.n_words", "word_chars", "n_symbols", "_m.l.n_dup_lines",
        "_m.w.n_repeat_words", "_m.l.n_lines",
        "n_upper", "n_exclaimed",
    )


def failure_bits() -> Column:
    """One bit for each failed rule, over the columns of :func:`measure`."""
    bits = F.lit(0).cast("long")
    for name, failed in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(BITS[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measurements and failure bits of every row; the base of policies and ablations."""
    return measure(docs, id_column, text_column).withColumn("failed", failure_bits())


def passes(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the verdict of a policy: ``kept``, and the policy's name and version."""
    return entries.withColumns({"kept": passes(policy), "policy": F.lit(f"{policy.name}@{policy.version}")})


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy does: rows it fails, and rows that only it fails (kept if it were dropped).

    The ledger is first reduced to one count per pattern of bits, at most 2 to the number of rules.
    """
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(
        F.count("*").alias("n")
    )
    named = F.array(
        *[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in policy.rules]
    )
    return (
        patterns.select("bits", "n", F.explode(named).alias("r"))
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        )
    )


def keep_good(docs: DataFrame, policy: Policy = STANDARD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that pass a policy, with all their columns, whatever these are called."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    carried = docs.select(row.alias("_row"), F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    measured = measure(carried.select(F.struct("_row", "_id").alias("_key"), "_text"), "_key", "_text")
    judged = measured.withColumn("failed", failure_bits()).where(passes(policy))
    return judged.select("_key._row.*")
