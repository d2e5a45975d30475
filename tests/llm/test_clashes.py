"""Columns whose names clash with those that an operator adds, empty tables, and one very long text."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from newsloom.llm import chat, fingerprints, kneser_ney, main_text, packing, quality, viterbi
from newsloom.llm.shared import free_name

LONG = "word and another, " * 30_000


def test_free_names():
    assert free_name("a", ["b"]) == "a" and free_name("B", ["b"]) == "B_"
    assert free_name("b", ["b", "b_"]) == "b__" and free_name("b", ["b"], ["b", "b_"]) == "b__"


@pytest.mark.parametrize("name", ["m", "_m", "failed", "n_words"])
def test_ledger(spark, name):
    docs = spark.createDataFrame([(7, "a b c", 1), (8, None, 2)], f"`{name}` long, text string, kept int")
    got = quality.apply_policy(quality.ledger(docs, name), quality.STANDARD)
    key = name if name in ("m", "_m") else f"{name}_"
    assert sorted((r[key], r["n_words"], r["kept"]) for r in got.collect()) == [(7, 3, False), (8, 0, False)]
    assert quality.ledger(docs.limit(0), name).count() == 0


@pytest.mark.parametrize("name", ["start", "offset"])
def test_packing(spark, name):
    docs = spark.createDataFrame([(7, "same"), (8, "")], f"`{name}` long, text string")
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), name).collect()
    assert sorted((r[f"{name}_"], r["length"], r["start"]) for r in got) == [(7, 2, 0), (8, 1, 0)]


def test_main_text(spark):
    pages = spark.createDataFrame([(7, "<html><body><p>Some words of a page.</p></body></html>"), (8, None)], "main_text long, html string")
    got = main_text.extract(pages, main_text.Weights(), "main_text").collect()
    assert sorted((r["main_text_"], r["main_text"]) for r in got) == [(7, "Some words of a page."), (8, "")]


def test_language_model(spark):
    docs = spark.createDataFrame([(1, "a b a b", 5, 6), (2, None, 7, 8)], "doc_id long, text string, n_tokens int, n_tokens_ int")
    model = kneser_ney.fit(docs.select("doc_id", "text"))
    got = kneser_ney.score(docs, model).orderBy("doc_id").collect()
    assert [(r["n_tokens__"], r["n_tokens_"], r["n_tokens"]) for r in got] == [(5, 6, 5), (7, 8, 1)]


def test_viterbi(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a b", 7)], "doc_id long, text string, ids int")
    encoded = viterbi.encode(docs, path)
    assert encoded.columns == ["doc_id", "ids_", "ids"]
    back = viterbi.decode(encoded.withColumn("text", F.lit("old")), path).first()
    assert (back["ids_"], back["text_"], back["text"]) == (7, "old", "a b")


def test_reply_trees(spark):
    rows = [("t", 1, None, "top", "x"), ("t", 2, 1, "reply", "y")]
    df = spark.createDataFrame(rows, "tree string, path long, parent long, position string, path_ string")
    got = chat.chosen_paths(df, node="path").orderBy("position").collect()
    assert [(r["path__"], r["path"], r["position"], r["position_"], r["path_"]) for r in got] == [(1, 1, 1, "top", "x"), (2, 1, 2, "reply", "y")]
    assert chat.chosen_paths(df.limit(0), node="path").count() == 0


def test_one_very_long_text(spark):
    docs = spark.createDataFrame([(1, LONG), (2, "short")], "doc_id long, text string")
    n = len(LONG.split())
    assert quality.measure(docs).where("doc_id = 1").first()["n_words"] == n
    made = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).where("doc_id = 1").agg(F.sum("length"), F.max("doc_tokens")).first()
    assert made[0] == made[1] > n
    print_ = fingerprints.compare_with_edits(docs).where("doc_id = 1").first()
    # The edit halves the text: of two anchors a stretch, 16 and 8 stretches and one anchor at the cut, 9 and 8 stretches match.
    assert print_["n_chars"] == len(LONG) and print_["near_next"] == 0.0
    assert print_["near_edited"] == pytest.approx(2 * (9 + 8) / (2 * (16 + 8) + 1))
