"""The prefix trie against a dictionary of all prefixes."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from newsloom.llm import prefix_trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """The contract's rows from (conv_id, turn, role, text), by plain loops."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - int(math.fmod(c, 20))  # as SQL has it, towards zero
        convs[c] = tuple(own.get(first, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = set()
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    total = {}
    for path in sorted(members, key=len, reverse=True):
        n = len(WORDS.findall(path[-1][1])) if path else 0
        leaves = sum(total[k][0] for k in children[path]) or 1
        total[path] = leaves, (len(members[path]) - 1) * n + sum(total[k][1] for k in children[path])
    for path, ids in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
        parent = min(members[path[:-1]]) if path else None
        out.add((min(ids), len(path), parent, len(ids), len(children[path]), *total[path], sha))
    assert len(out) == len(members)
    return out


def built(spark, rows, extra=0):
    schema = "conv_id long, turn int, role string, text string" + ", seq int, id string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df)))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == names and {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def conversation(c, turns):
    return [(c, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(turns)]


@pytest.mark.parametrize("seed,most,choices", [(1, 3, 2), (2, 9, 2), (3, 17, 3), (4, 33, 2)])
def test_random_tries(spark, seed, most, choices):
    rng = random.Random(seed)
    pool = ["one", "two words", "", " three \n short words "][:choices]
    rows = []
    for c in rng.sample(range(-30, 400), 60):
        turns = rng.choices(pool, weights=[6, 2, 1, 1][:choices], k=rng.randint(1, most))
        rows += conversation(c, turns)
    rng.shuffle(rows)
    assert built(spark, rows) == brute(rows)


def test_nulls_ties_turnless_long_texts_and_copies(spark):
    rows = conversation(21, ["only"]) + conversation(22, ["a", "b"]) + conversation(20, [])  # 20 is absent
    rows += [(40, None, None, None), (40, 1, "user", None), (40, 0, None, "x"), (None, 0, "user", "nobody")]
    rows += [(60, 3, "user", "same")] * 3 + [(60, 3, "assistant", "same"), (61, 9, "user", "w " * 50_000)]
    for c in range(100, 160):  # copies
        rows += conversation(c, ["hello there", "general words here", "bye"])
    rows += conversation(2**40, ["hello there"]) + conversation(-1, ["hello there", "x"])
    assert built(spark, rows) == brute(rows)


def test_one_deep_conversation(spark):
    turns = [f"t{i} w" for i in range(150)]
    rows = conversation(7, turns) + conversation(8, turns[:149] + ["other"]) + conversation(9, turns[:70])
    assert built(spark, rows) == brute(rows)


def test_only_turnless_conversations_and_none(spark):
    lonely = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2)
    rows = conversation(lonely, ["a"])
    assert built(spark, rows) == brute(rows)  # its only turn is replaced by none
    assert built(spark, []) == set()
