from __future__ import annotations

import math
import re
import statistics
from collections import Counter

import pytest
from helpers import evaluate
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import classifier, keywords, language, rake, terms, tfidf, yake
from newsloom.operators.summary import summarize
from newsloom.operators.terms import STOP, as_lists
from newsloom.sources.pages import read_table

TEXTS = {
    1: "Deep learning models learn. Deep learning needs data, and data needs care. Models of deep learning care.",
    2: "The Quartz library stores rows.\nWhen the library grows, Quartz splits rows across disks; disks fail.",
    3: "Solar panels power homes. Solar panel costs fall! NASA tests solar panels on Mars? Mars is cold.",
    4: "of the and",
    5: "",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


def ranked(df, column="keyword"):
    out: dict[int, list] = {}
    for row in df.orderBy("doc_id", "rank").collect():
        out.setdefault(row["doc_id"], []).append(row[column])
    return out


def usable(word):
    return word is not None and word not in STOP and len(word) >= 3 and re.search(r"[^\W\d_]", word) is not None


def yake_by_hand(body):
    """Plain-Python scores of one text, straight from the published formulas."""
    sentences = [s for s in re.split(r"[.!?\n]+", body) if re.search(r"[^\W_]", s)]
    seen, pairs = [], Counter()
    for number, sentence in enumerate(sentences):
        for part_no, part in enumerate(p.split() for p in re.split(r"[^\w ]+", sentence) if p.split()):
            for at, token in enumerate(part):
                before = part[at - 1].lower() if at else None
                after = part[at + 1].lower() if at + 1 < len(part) else None
                seen.append((token, number, part_no == at == 0, before, after))
                if usable(token.lower()) and usable(after):
                    pairs[(token.lower(), after)] += 1
    tf = Counter(t.lower() for t, *_ in seen)
    counts = [n for w, n in tf.items() if usable(w)]
    if not counts:
        return {}
    scores = {}
    for word in filter(usable, tf):
        mine = [s for s in seen if s[0].lower() == word]
        acronyms = sum(1 for s in mine if re.fullmatch(r"[A-Z]{2,}", s[0]))
        capitals = sum(1 for s in mine if s[0][0].isupper() and not s[2])
        places = sorted({s[1] for s in mine})
        sides = 0.0
        for i in (3, 4):
            others = [s[i] for s in mine if s[i] is not None]
            sides += len(set(others)) / len(others) if others else 0.0
        rel = 1 + sides * tf[word] / max(tf.values())
        freq = tf[word] / (statistics.mean(counts) + statistics.pstdev(counts))
        case = max(acronyms, capitals) / (1 + math.log(tf[word]))
        pos = math.log(math.log(3 + statistics.median(places)))
        scores[word] = pos * rel / (case + freq / rel + len(places) / len(sentences) / rel)
    out = {w: s / (tf[w] * (1 + s)) for w, s in scores.items()}
    for (a, b), n in pairs.items():
        out[f"{a} {b}"] = scores[a] * scores[b] / (n * (1 + scores[a] + scores[b]))
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def deduplicated(scores, n):
    kept: list[str] = []
    for word in sorted(scores, key=lambda w: (round(scores[w], 8), w)):
        if len(kept) < 20 and all(1 - edit_distance(word, k) / max(len(word), len(k)) <= 0.9 for k in kept):
            kept.append(word)
    return kept[:n]


def test_yake_scores_by_brute_force(docs):
    got: dict[int, dict[str, float]] = {}
    for row in yake.candidates(docs, "doc_id", "text").collect():
        got.setdefault(row["doc_id"], {})[row["keyword"]] = row["score"]
    for doc_id, body in TEXTS.items():
        assert got.get(doc_id, {}) == pytest.approx(yake_by_hand(body)), doc_id


def test_yake_keywords_by_brute_force(docs):
    got = ranked(yake.yake(docs, "doc_id", "text", 10))
    want = {i: deduplicated(yake_by_hand(body), 10) for i, body in TEXTS.items()}
    assert got == {i: k for i, k in want.items() if k}


def test_near_duplicates_do_not_use_up_the_pool(spark):
    """However many near-copies stand in front, later keywords still fill the pool."""
    same = [(0.001 * i, f"internationalization{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)]
    rest = [(1.0 + i, f"{chr(97 + i)}{chr(97 + i) * 3}") for i in range(15)]
    df = spark.createDataFrame([(sorted(same + rest),)], "c array<struct<score:double,keyword:string>>")
    kept = [k["keyword"] for k in df.select(yake.distinct_enough(F.col("c")).alias("k")).first()["k"]]
    assert kept == [same[0][1]] + [w for _, w in rest]


def test_rake_by_brute_force(docs):
    got = {(r["doc_id"], r["keyword"]): r["score"] for r in rake.rake(docs, "doc_id", "text", 100).collect()}
    want = {}
    for doc_id, body in TEXTS.items():
        found = []
        for part in re.split(r"[^\w ]+", body.lower()):
            run: list[str] = []
            for word in [*part.split(), "the"]:
                if word in STOP:
                    if run:
                        found.append(tuple(run))
                    run = []
                else:
                    run.append(word)
        freq, degree = Counter(), Counter()
        for phrase in found:
            for word in phrase:
                freq[word] += 1
                degree[word] += len(phrase)
        for phrase in set(found):
            want[(doc_id, " ".join(phrase))] = sum(degree[w] / freq[w] for w in phrase)
    assert got == pytest.approx(want, abs=1e-5)


def test_tfidf_drops_rare_and_common_terms(spark):
    rows = [(1, "apple pie apple"), (2, "apple tart"), (3, "apple pie"), (4, "cherry tart lemon")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ranked(tfidf.tfidf(df, "doc_id", "text", max_df=0.6))
    assert got == {1: ["apple pie", "pie"], 2: ["tart"], 3: ["apple pie", "pie"], 4: ["tart"]}
    idf = math.log(5 / 3) + 1
    top = tfidf.tfidf(df, "doc_id", "text", max_df=0.75).filter("doc_id = 2 AND keyword = 'tart'").first()
    apple = math.log(5 / 4) + 1
    assert top["score"] == pytest.approx(idf / math.hypot(idf, apple))


def test_entities_need_mostly_capital_use(spark):
    rows = [
        (1, "We met Ada Lovelace in Paris, France. The Engine was new."),
        (2, "In Paris the engine ran. An engine is a machine. Then Ada Lovelace left Paris."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ranked(keywords.METHODS["ner"](df, "doc_id", "text", 10))
    assert got == {1: ["Ada Lovelace", "France", "Paris"], 2: ["Paris", "Ada Lovelace"]}


def test_combined_is_the_union_by_length(docs):
    parts = [ranked(keywords.METHODS[m](docs, "doc_id", "text", 10)) for m in ("yake", "rake", "ner")]
    got = ranked(keywords.combined(docs, "doc_id", "text", 10))
    for doc_id in (1, 2, 3):
        union = {k for p in parts for k in p.get(doc_id, [])}
        assert got[doc_id] == sorted(union, key=lambda k: (len(k), k))[:10]


def test_method_by_name(docs):
    assert ranked(keywords.extract_keywords(docs, "doc_id", "text", "rake", 3)) == ranked(rake.rake(docs, "doc_id", "text", 3))
    with pytest.warns(UserWarning, match="Unknown keyword"):
        got = keywords.extract_keywords(docs, "doc_id", "text", "magic", 3)
    assert ranked(got) == ranked(yake.yake(docs, "doc_id", "text", 3))


def test_keyword_lists_keep_rank(docs):
    lists = as_lists(rake.rake(docs, "doc_id", "text", 3), "doc_id").collect()
    assert {r["doc_id"]: r["keywords"] for r in lists} == ranked(rake.rake(docs, "doc_id", "text", 3))


def test_per_text_operators_move_texts_once(docs):
    """One exchange of the texts, none of the words cut from them."""
    for df in (rake.rake(docs, "doc_id", "text"), yake.yake(docs, "doc_id", "text"), summarize(docs, "doc_id", "text")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges = set(re.findall(r"Exchange hashpartitioning\(([^)]*)\), (\w+)", plan))
        assert {kind for _, kind in exchanges} == {"REPARTITION_BY_NUM"}, plan


def test_summary_budget_and_order(spark):
    body = "Cats sleep all day. Unrelated words appear once here. Cats and cats like cats. The end of it."
    long = "word " * 200
    df = spark.createDataFrame([(1, body), (2, long), (3, "  ")], "doc_id long, text string")
    few = {r["doc_id"]: r["summary"] for r in summarize(df, "doc_id", "text", max_words=9, min_words=1).collect()}
    assert few[1] == "Cats sleep all day. Cats and cats like cats."
    full = {r["doc_id"]: r["summary"] for r in summarize(df, "doc_id", "text").collect()}
    assert full[1] == body and full[2] == " ".join(["word"] * 150) and 3 not in full


def test_clean_text(spark):
    cases = ["a\n\n\nb", "a   b", " \n a  \t", "", "a \n \n b"]
    want = [re.sub(" +", " ", re.sub("\n+", "\n", c)).strip() for c in cases]
    assert evaluate(spark, cases, text.clean_text) == want


def test_grams_are_those_of_the_words(spark):
    got = evaluate(spark, ["Ab c, É"], language.grams)[0]
    want = []
    for word in ("ab", "c", "é"):
        marked = f"_{word}_"
        want += list(word) + [marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
    assert sorted(got) == sorted(want)


def test_language_accuracy_on_held_out_texts(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = language.train(docs.filter(~held_out))
    found = language.detect(docs.filter(held_out), "doc_id", "text", model).join(docs, "doc_id")
    rows = found.filter(F.col("n_chars") > 100).groupBy("lang").agg(F.avg((F.col("language") == F.col("lang")).cast("int")))
    accuracy = dict(map(tuple, rows.collect()))
    assert set(accuracy) == {"en", "fr", "de", "es"} and min(accuracy.values()) > 0.9, accuracy


def test_every_text_is_told_by_a_model_that_has_not_seen_it(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("die und das", "de"), ("the and of", "en"), ("les des une", "fr")] * 12)]
    rows += [(100, "rôle unique", "xx"), (None, "die das", None), (101, None, "de"), (102, "die die", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.detect_held_out(docs, "doc_id", "text").collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r["language"] for r in got}
    assert all(found[i] == lang for i, _, lang in rows[:36])
    assert found[100] != "xx"  # its language is in its own half only
    assert found[None] == "de" and found[101] == "en" and found[102] == "de"


def test_language_of_nothing_is_the_default(spark):
    train = spark.createDataFrame([("der die das", "de"), ("le la les", "fr")], "text string, lang string")
    model = language.train(train)
    df = spark.createDataFrame([(1, ""), (2, None), (3, "12 34"), (4, "die"), (5, "les")], "doc_id long, text string")
    got = {r["doc_id"]: r["language"] for r in language.detect(df, "doc_id", "text", model).collect()}
    assert got == {1: "en", 2: "en", 3: "en", 4: "de", 5: "fr"}


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.7,), (0.7000001,), (None,)], "p double")
    got = df.select(classifier.verdict(F.col("p")).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in got] == [(False, 0.7), (True, 0.7000001), (False, 0.0)]


def test_classifier_ranks_held_out_texts(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    sf = "/root/testdata/sf0.01"
    labelled = read_table(spark, sf, "documents").join(
        read_table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id"
    )
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = classifier.train(labelled.filter(~held_out).select("doc_id", "text", "label"))
    scored = classifier.score(labelled.filter(held_out), "doc_id", "text", model).join(labelled, "doc_id")
    raw = scored.select(array_to_vector(F.array(1 - F.col("confidence_score"), "confidence_score")).alias("rawPrediction"), "label")
    assert BinaryClassificationEvaluator().evaluate(raw) > 0.6


def test_external_models_plug_in(spark):
    def load_scores():
        import numpy as np

        return lambda texts: np.array([len(t) / 10 for t in texts])

    def load_summaries():
        import numpy as np

        return lambda texts: np.array([t[:3] for t in texts], dtype=object)

    df = spark.createDataFrame([(1, "12345678"), (2, "123")], "doc_id long, text string")
    got = classifier.score_with(df, "doc_id", "text", load_scores).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, True, 0.8), (2, False, 0.3)]
    got = classifier.summarize_with(df, "doc_id", "text", load_summaries).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "123"), (2, "123")]


def test_model_inputs(spark):
    cases = [("T", "c" * 600), (None, "c")]
    assert evaluate(spark, cases, text.classifier_model_input) == ["T " + "c" * 510, "c"]
    assert evaluate(spark, ["x" * 600], text.summary_model_input) == ["summarize: " + "x" * 501]
    assert evaluate(spark, ["x"], lambda c: text.summary_model_input(c, "bart-base")) == ["x"]


def test_yake_cuts_each_text_once(docs):
    """Words are counted where their text lies: the texts move once and are read once."""
    for df in (yake.yake(docs, "doc_id", "text"), yake.best_candidates(docs, "doc_id", "text")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1, plan


def test_yake_with_repeated_keys_and_odd_texts(spark):
    """Texts of one key count as one; marks of the text's own, long runs and texts without words change nothing."""
    odd = ["| a|b . . \t\n one-two  three", "...", "İstanbul ΟΔΟΣ ÉTÉ ÉTÉ été | été.", "x" * 5000 + " " + "tail " * 3000]
    rows = [(i, t) for i, t in enumerate(odd)] + [(9, TEXTS[1]), (9, TEXTS[1]), (None, TEXTS[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got: dict = {}
    for row in yake.candidates(df, "doc_id", "text").collect():
        got.setdefault(row["doc_id"], {})[row["keyword"]] = (row["tf"], row["score"])
    assert {k: v[1] for k, v in got[None].items()} == pytest.approx(yake_by_hand(TEXTS[2]))
    assert {w for w in got[0] if " " in w} == {"two three"}
    assert 1 not in got
    assert got[2]["été"][0] == 4 and {w for w in got[2] if " " in w} == {"i̇stanbul οδος", "οδος été", "été été"}
    assert got[3]["tail"][0] == 3000 and got[3]["tail tail"][0] == 2999
    assert got[9]["deep learning"][0] == 2 * 3


def test_partitions_follow_the_bytes_of_the_texts(docs, monkeypatch):
    """A larger table has more partitions, not larger ones; a small one has the session's."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    assert terms.spread(docs, "doc_id", "text").rdd.getNumPartitions() == width
    monkeypatch.setattr(terms, "PART_BYTES", 10)
    size = sum(len(t.encode()) for t in TEXTS.values())
    assert terms.spread(docs, "doc_id", "text").rdd.getNumPartitions() == -(-size // 10)
    empty = docs.filter("false")
    assert terms.spread(empty, "doc_id", "text").rdd.getNumPartitions() == width


def test_ngrams_are_looked_up_by_distinct_word(spark):
    """Texts meet the scores of their words; n-grams are not cut from every use of a word."""
    rows = [(1, "the house the house", "en"), (2, "das Haus das Haus", "de"), (3, "The 12 _ house!", None), (4, "Haus", None), (5, "…", None), (6, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = language.detect(df, "doc_id", "text", language.train(df))
    assert "(?=" not in told._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["language"] for r in told.collect()} == {1: "en", 2: "de", 3: "en", 4: "de", 5: "en", 6: "en"}
