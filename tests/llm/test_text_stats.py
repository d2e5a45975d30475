"""Quality rules, the language model and near-duplicates against brute force."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import arrays, kneser_ney, neardup, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CASES = [
    "", " \t\n", "one", "one two three", "a b c a b c", "x x x x x x", "\nA b\n\nA b\n c\n", "é è\x85 ü　x  y\x0bz",
    "#### $$ one%two", "a b c d a b c", None, "w " * 3000, "Hello!! WORLD!! AGAIN!!",
]


def rows_of(spark, texts, **extra):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def base_measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


def test_measures(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(rows_of(spark, CASES))
    texts = docs.collect()
    got = quality.ledger(docs).collect()
    assert len(got) == len(texts)
    mine = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert mine == Counter((r.doc_id, *base_measures(r.text)) for r in texts)
    for r in got:
        assert bool(r.failed & quality.BASE.mask) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_policies_and_ablations(spark, sf_dir):
    entries = quality.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    bits = [r.failed for r in entries.collect()]
    found = {r.rule: (r.n_failed, r.n_failed_alone) for r in quality.ablations(entries, quality.STANDARD).collect()}
    for name, bit in quality.BITS.items():
        assert found[name] == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits))
    kept = quality.apply_policy(entries, quality.BASE)
    assert kept.where("kept").count() == sum(not b & quality.BASE.mask for b in bits)
    assert kept.first().policy == "base@1"


def test_good_texts_are_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.apply_policy(quality.ledger(docs), quality.STANDARD).join(labels, "doc_id")
    good, bad = judged.where("quality = 1"), judged.where("quality = 0")
    # What the base rules fail is given; of the rest no good text may go.
    assert good.where("not kept and (failed & 3) = 0").count() == 0
    assert bad.where("kept").count() <= 0.1 * bad.count()


def test_keep_good_keeps_columns(spark):
    rows = [(1, "a b " * 5, "x", 1), (2, " ".join(f"w{i}" for i in range(80)), "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m string, failed int")
    out = quality.keep_good(docs)
    assert out.columns == docs.columns
    assert [tuple(r) for r in out.collect()] == [rows[1]]
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_words_and_shingles():
    texts = pa.array(["Ab cd\tef", None, "", "  x ", "q" * 50 + " z", "ab CD eF"])
    w = arrays.words(texts)
    assert w.counts.tolist() == [3, 0, 0, 1, 2, 3]
    assert w.hashes[:3].tolist() == w.hashes[-3:].tolist() and len(set(w.hashes.tolist())) == 6
    assert arrays.shingles(w, 2).counts.tolist() == [2, 0, 0, 1, 1, 2]
    assert arrays.shingles(w, 5).counts.tolist() == [1, 0, 0, 1, 1, 1]
    sliced = arrays.words(texts.slice(4, 2))
    assert sliced.hashes.tolist() == w.hashes[4:].tolist()


def test_long_words_cross_slices(monkeypatch):
    text = "".join("x" * 7 + str(i) + " " for i in range(500)) + "y" * 5000
    whole = arrays.words(pa.array([text])).hashes.tolist()
    monkeypatch.setattr(arrays, "SLICE", 64)
    assert arrays.words(pa.array([text])).hashes.tolist() == whole


# --- language model ---------------------------------------------------------------------------------------------------


class Brute:
    """Interpolated modified Kneser-Ney over pairs, with dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            tokens = self.cut(t)
            self.words.update(tokens)
            self.pairs.update(zip(["<s>", *tokens], tokens))
        self.n = sum(self.words.values())
        ones = Counter(self.pairs.values())
        self.upper = kneser_ney.discounts(*[ones[i] for i in range(1, 5)])
        self.follows, self.after = Counter(), defaultdict(list)
        for (a, b), c in self.pairs.items():
            self.follows[b] += 1
            self.after[a].append(c)
        lower = Counter(self.follows.values())
        self.lower = kneser_ney.discounts(*[lower[i] for i in range(1, 5)])
        self.kinds = max(len(self.pairs), 1)
        self.rest = sum(self.off(c, self.lower) for c in self.follows.values()) / self.kinds if self.pairs else 1.0
        self.left = {a: sum(self.off(x, self.upper) for x in cs) for a, cs in self.after.items()}
        self.total = {a: sum(cs) for a, cs in self.after.items()}

    @staticmethod
    def cut(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return [*WORD.findall(low), "</s>"]

    @staticmethod
    def off(c, d):
        return 0.0 if not c else d[min(c, 3) - 1]

    def p(self, before, word):
        f = self.follows[word]
        low = (f - self.off(f, self.lower)) / self.kinds + self.rest / (len(self.words) + 1)
        if before not in self.total:
            return low
        c = self.pairs[before, word]
        return (c - self.off(c, self.upper) + self.left[before] * low) / self.total[before]

    def score(self, text):
        tokens = self.cut(text)
        return sum(math.log10(self.p(a, b)) for a, b in zip(["<s>", *tokens], tokens))

    def base(self, text):
        v = len(self.words)
        return sum(math.log10((self.words[t] + 0.1) / (self.n + 0.1 * (v + 1))) for t in self.cut(text))


def test_language_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(rows_of(spark, CASES).selectExpr("doc_id + 1000000", "text"))
    from pyspark.sql import functions as F

    marked = docs.withColumn("held_out", kneser_ney.held_out(F.col("doc_id")))
    model = kneser_ney.fit(marked.where("not held_out"))
    rows = {r.doc_id: r for r in kneser_ney.score(marked, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 10 == 0}
    assert {d for d, r in rows.items() if r.held_out} == held
    brute = Brute([t for d, t in texts.items() if d not in held])
    assert model.distinct == len(brute.words) and model.tokens == brute.n
    for d, t in texts.items():
        r = rows[d]
        assert r.n_tokens == len(brute.cut(t)) and r.n_known == sum(brute.words[w] > 0 for w in brute.cut(t))
        assert r.base_score == pytest.approx(brute.base(t), rel=1e-9)
        assert r.score == pytest.approx(brute.score(t), rel=1e-9)
    # A distribution: all words and the unknown one add up to 1, also after a word never seen.
    for before in ("<s>", "the", "never-seen-before"):
        assert sum(brute.p(before, w) for w in [*brute.words, "\0"]) == pytest.approx(1)
    seen = [d for d in held if texts[d]]
    assert sum(rows[d].score for d in seen) > sum(rows[d].base_score for d in seen)


def test_language_model_without_rows(spark):
    docs = rows_of(spark, ["a b", None])
    model = kneser_ney.fit(docs.limit(0))
    got = kneser_ney.score(docs, model).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.score) for r in got] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert kneser_ney.score(docs.limit(0), model).count() == 0


# --- near-duplicates --------------------------------------------------------------------------------------------------


def brute_classes(texts):
    """Classes by comparing all pairs."""
    n = len(texts)
    bags, df = {}, Counter()
    for d, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = WORD.findall(w)
        bags[d] = Counter(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        df.update(bags[d].keys())
    least = neardup.SHARE * n
    weight = {
        s: 1 - (1 - neardup.LEAST) * min(1, math.log(c / least) / math.log(1 / neardup.SHARE)) if c > least else 1.0
        for s, c in df.items()
    }
    label = {d: d for d in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    holders = defaultdict(list)
    for d, bag in bags.items():
        for s in bag:
            holders[s].append(d)
    tried, near = set(), []
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) in tried:
                    continue
                tried.add((a, b))
                common = sum(min(c, bags[b][s]) * weight[s] for s, c in bags[a].items() if s in bags[b])
                total = sum(c * weight[s] for s, c in bags[a].items()) + sum(c * weight[s] for s, c in bags[b].items())
                if common / (total - common) >= 0.8:
                    near.append((a, b))
    empty = defaultdict(list)
    for d, t in texts.items():
        if not bags[d]:
            empty[t or ""].append(d)
    near += [(ds[0], x) for ds in empty.values() for x in ds[1:]]
    for a, b in near:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {d: root(d) for d in texts}


def test_near_duplicates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(rows_of(spark, CASES + CASES[:4]).selectExpr("doc_id + 1000000", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    expected = brute_classes(texts)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == expected
    kept = [r.doc_id for r in neardup.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(expected.values()))


def test_chains_and_large_groups(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(5000)]
    base = [vocabulary[i] for i in rng.integers(0, 5000, 300)]
    texts = []
    for i in range(150):  # near copies of one text
        t = list(base)
        t[int(rng.integers(0, 300))] = f"changed{i}"
        texts.append(" ".join(t))
    chain = [vocabulary[i] for i in rng.integers(0, 5000, 300)]
    for i in range(12):  # each like the next, the ends unlike
        chain = chain[12:] + [f"new{i}x{j}" for j in range(12)]
        texts.append(" ".join(chain))
    texts += ["alone in the world of words", "quite another text of a few words"]
    docs = rows_of(spark, texts).repartition(8)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == brute_classes(dict(enumerate(texts)))


def test_pairs_around_a_common_passage(spark):
    """Hundreds of pairs in one band, whose passage is most of each text: no pivot stands for the other pairs."""
    rng = np.random.default_rng(8)
    passage = [f"passage{i}" for i in range(74)]
    texts = []
    for family in range(400):
        own = [f"own{family}x{i}" for i in range(30)]
        other = list(own)
        other[int(rng.integers(5, 25))] = other[-2] = f"changed{family}"
        texts += [" ".join(passage + own), " ".join(passage + other)]
    texts += [" ".join(passage + [f"single{i}x{j}" for j in range(30)]) for i in range(20)]
    texts += [texts[0] + f" more{i}" for i in range(200)]  # one large class among them
    docs = rows_of(spark, texts).repartition(8)
    expected = brute_classes(dict(enumerate(texts)))
    assert len(set(expected.values())) == 420
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == expected


def test_one_very_common_line(spark):
    """A line that is nine tenths or less of hundreds of short texts of all weights: some are alike through it, most aren't."""
    rng = np.random.default_rng(11)
    line = " ".join(f"common{i}" for i in range(60))
    texts = []
    for family in range(250):
        own = [f"own{family}x{i}" for i in range(int(rng.integers(2, 26)))]
        texts.append(line + "\n" + " ".join(own))
        if family % 3 == 0:
            texts.append(line + "\n" + " ".join([*own[:-1], f"last{family}"]))
        if family % 5 == 0:
            texts.append(" ".join(own) + " before\n" + line)
    docs = rows_of(spark, texts).repartition(8)
    expected = brute_classes(dict(enumerate(texts)))
    assert 100 < len(set(expected.values())) < len(texts)
    keys, counts = neardup._counted(docs.select("text"), 1, neardup._COUNTER)
    common = np.zeros(1 << 20, dtype=np.uint32)
    common[keys >> neardup._COUNTER_SHIFT] = counts
    even = {"keys": np.zeros(0, np.uint64), "weights": np.zeros(0, np.float32)}
    share = spark.sparkContext.broadcast
    pairs = neardup._by_rare_shingles(neardup._rare(docs.selectExpr("doc_id id", "doc_id class", "text"), share(even), share(common)))
    assert pairs.count() < len(texts) * len(texts) // 14  # a seventh of those that share the line
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == expected


def test_near_duplicates_of_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, "same text here for all of us", "k"), (1, "same text here for all of us", "k"), (2, "same text here for all of us", "m"), (None, "same text here for all of us", "n"), (3, None, None), (4, "", None)],
        "doc_id long, text string, class_id string",
    )
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, None), (3, 3), (4, 3)], key=str)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.class_id) for r in kept.collect()) == [("1", "k"), ("3", None), ("None", "n")]
    assert neardup.classes(docs.limit(0)).count() == 0 and neardup.keep_one(docs.limit(0)).count() == 0


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(1, 1 << 62, n).astype(np.uint64) for n in (600, 100, 200))
    hashes = np.concatenate([common, a, common, b])
    weights = np.ones(len(hashes), np.float32)
    weights[:300] = weights[700:1000] = 0.8
    drawn = neardup.samples(hashes, weights, np.array([0, 700]), 250)
    expected = (300 * 0.8 + 300) / (300 * 0.8 + 300 + 300)
    assert abs((drawn[:, 0] == drawn[:, 1]).mean() - expected) < 0.09


def test_a_worker_holds_little_of_a_batch():
    """Six workers share an executor with the JVM; what each holds follows the slice, which is small."""
    import tracemalloc

    import pyarrow as pa

    from newsloom.llm import arrays, neardup

    texts = pa.array([" ".join(f"w{i * 50 + j}" for j in range(500)) for i in range(1000)])
    tracemalloc.start()
    for a, b in arrays.batches_of(texts):
        arrays.shingles(arrays.words(texts.slice(a, b - a)), neardup.SIZE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    assert 8 * neardup.BUFFER <= 4 << 20
