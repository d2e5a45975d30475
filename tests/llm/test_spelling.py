"""Spelling variants against brute force over all pairs of words, and word counts against a plain loop."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import spelling


def one_edit(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    """word -> (form, root, n, n_near, form_n) of {word: n}."""
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def found(spark, words, extra=""):
    df = spark.createDataFrame([(w, n, *([1] if extra else [])) for w, n in words.items()], "word string, n long" + extra)
    rows = spelling.variants(df).collect()
    assert len(rows) == len(words)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("letters,length", [("ab", (4, 9)), ("abcdefgh", (6, 9)), ("aàáâãäåæçèé÷ÿ", (6, 7)), ("abあいう🙂\U0001f600", (4, 7))])
def test_forms_equal_those_of_all_pairs(spark, letters, length):
    rng = random.Random(letters)
    words = {}
    for _ in range(120):
        word = "".join(rng.choices(letters, k=rng.randint(*length)))
        words[word] = rng.choice([5, 6, 30, 200, 1500, 90_000])
        for _ in range(3):  # one or two edits away
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(max(len(word), 1))
                word = word[:i] + rng.choice(["", rng.choice(letters), rng.choice(letters) + word[i : i + 1]]) + word[i + 1 :]
            if len(word) >= 4:
                words.setdefault(word, rng.choice([5, 6, 30, 200, 1500]))
    assert found(spark, words) == brute(words)


def test_repeated_bigrams_and_chains(spark):
    words = {"a" * n: 10 ** (n - 3) for n in range(4, 12)} | {"abab" * n + x: n * 7 for n in (1, 2, 3) for x in ("", "a", "b", "ab")}
    got = found(spark, words, ", gram int")
    assert got == brute(words)
    assert got["aaaa"][1] == "a" * 11  # seven forms on


def test_equal_counts_are_decided_by_code_points(spark):
    words = {"wordab": 5, "wordac": 50, "wordaà": 50, "wordaz": 50, "lonely": 9}
    assert found(spark, words)["wordab"][0] == "wordac"
    assert found(spark, words)["lonely"] == (None, "lonely", 9, 0, None)


def test_no_words_and_short_words(spark):
    assert found(spark, {}) == {}
    with pytest.raises(ValueError):
        found(spark, {"abc": 5})


def test_pivots_are_disjoint_and_rarest_together():
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choices("abcd", k=rng.randint(4, 10)))
        counts = np.zeros(spelling.COUNTERS, dtype=np.int64)
        for a in "abcd":
            for b in "abcd":
                counts[spelling.counter(a + b)] = rng.randint(1, 9)
        prefix = spelling.prefix_of(word, counts)
        assert len(prefix) >= 3
        pivots = spelling.pivots_of(prefix)
        cost = lambda g: int(counts[spelling.counter(g[1])])
        pairs = [(a, b) for a in prefix for b in prefix if b[2] - a[2] >= 2]
        assert len(pivots) == 2 and pivots[1][2] - pivots[0][2] >= 2
        assert sum(map(cost, pivots)) == min(cost(a) + cost(b) for a, b in pairs)


def counted(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= 6:
                total[word] += 1
    return {w: n for w, n in total.items() if n >= 5}


def test_words_are_counted_whole_with_their_typos(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    rng = random.Random(8)
    pool = ["Example", "ÉCOLE", "èçàÿß÷", "straße", "Wörter,", "short", "a1b2c3d4letters", "tail" * 2, "QUITE-Long", "İstanbul", "naïveté"]
    rows = [(i, rng.choice([" ", "\n", "."]).join(rng.choices(pool, k=60))) for i in range(400)]
    rows += [(None, "nobody " * 9), (5, None), (6, ""), (7, "Repeated words"), *[(7, "Repeated words")] * 5]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string")
    got = {r["word"]: r["n"] for r in spelling.count_words(docs).collect()}
    want = counted(rows)
    assert got == want and any(w not in "".join(pool).lower() for w in want)
    assert spelling.count_words(docs.limit(0)).collect() == []


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Some longer words ÉCOLE " * 500 + "x" * 300 + " end"
    whole = Counter(w for found in spelling.runs(text) for w in found)
    monkeypatch.setattr(spelling, "PIECE", 64)
    assert Counter(w for found in spelling.runs(text) for w in found) == whole
    assert whole["x" * 300] == 1
