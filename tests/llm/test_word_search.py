"""The search over many words at once: ids of the library, whatever the texts; rows by columns; a number of steps that words don't add to."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
import pytest

from newsloom.llm import viterbi
from newsloom.llm.word_search import WordSearch

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def texts_of(n: int) -> list[str | None]:
    rng = random.Random(11)
    parts = ["the", "ation", "üau", "éaivioi", "ß", "\n", "日本", "😀", "…", "aaaa", "\t", "%%%", "▁", " ", "  ", "x" * 90, "1984", "THLY", " ", "ñ", "\U0010ffff"]
    made = ["".join(rng.choice(parts + [" "] * 8) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*made, None, "", " ", "  ", "▁", "▁ ▁", " a", "a ", "a  b", "a" * 300, "\n", "é" * 70, "word " * 50]


def test_ids_and_texts_of_columns(model):
    texts = texts_of(800)
    ids = viterbi.Pieces(PIECES).encode_column(pa.array(texts))
    ids.validate(full=True)
    assert ids.to_pylist() == [None if t is None else model.encode(t) for t in texts]
    back = viterbi.Pieces(PIECES).decode_column(ids)
    back.validate(full=True)
    assert back.to_pylist() == [None if t is None else t.replace("▁", " ") for t in texts]


def test_slices_and_empty_columns():
    mine = viterbi.Pieces(PIECES)
    texts = texts_of(60)[::-1]
    ids = [None if t is None else mine.encode(t) for t in texts]
    assert None in texts[5:]
    for at, n in [(0, 3), (5, 40), (11, 3), (12, 1), (13, 0), (40, 33)]:
        assert mine.encode_column(pa.array(texts).slice(at, n)).to_pylist() == ids[at : at + n]
        back = mine.decode_column(pa.array(ids, pa.list_(pa.int32())).slice(at, n))
        back.validate(full=True)
        assert back.to_pylist() == [None if x is None else mine.decode(x) for x in ids[at : at + n]]
    assert mine.encode_column(pa.array([None, ""])).to_pylist() == [None, []]
    assert mine.decode_column(pa.array([None, []], pa.list_(pa.int32()))).to_pylist() == [None, ""]


def test_decoding_ids_that_no_text_gives():
    mine = viterbi.Pieces(PIECES)
    rng = random.Random(12)
    special = [*mine.control, mine.unknown, *mine.byte_ids]
    rows = [[rng.choice(special) if rng.random() < share else rng.randrange(len(mine.texts)) for _ in range(rng.randint(0, 9))] for share in (0, 0.1, 0.9) for _ in range(300)]
    assert mine.decode_column(pa.array(rows, pa.list_(pa.int32()))).to_pylist() == [mine.decode(r) for r in rows]


def test_full_caches_change_nothing(monkeypatch):
    texts = texts_of(300)
    want = viterbi.Pieces(PIECES).encode_column(pa.array(texts)).to_pylist()
    monkeypatch.setattr(viterbi, "CACHE", 20)
    monkeypatch.setattr("newsloom.llm.word_search.PAIR_BITS", 3)
    monkeypatch.setattr("newsloom.llm.word_search.CELLS", 50)
    mine = viterbi.Pieces(PIECES)
    got = [x for at in range(0, len(texts), 10) for x in mine.encode_column(pa.array(texts[at : at + 10], pa.string())).to_pylist()]
    assert got == want


def test_a_word_is_not_a_part_of_another():
    mine = viterbi.Pieces(PIECES)
    first = mine.encode("😀abc")
    assert mine.decode(first) == "😀abc"
    assert mine.decode(mine.encode("\x00abc")) == "\x00abc"


def test_steps_do_not_grow_with_the_words(monkeypatch):
    """New words cost array elements, not steps of their own."""
    steps = []
    apart = WordSearch.apart
    monkeypatch.setattr(WordSearch, "apart", lambda *a: steps.append(1) or apart(*a))
    monkeypatch.setattr(viterbi.Pieces, "_word", lambda *a: pytest.fail("a word was searched alone"))
    rng = random.Random(13)
    counts = []
    for n in (200, 8000):
        steps.clear()
        words = ["".join(rng.choice("aeiournstlé\n%語😀Ж") for _ in range(10)) for _ in range(n)]
        viterbi.Pieces(PIECES).encode_column(pa.array([" ".join(words)]))
        counts.append(len(steps))
    assert counts[1] < 3 * counts[0]


def test_columns_without_word_cuts():
    mine = viterbi.Pieces(PIECES)
    texts = [None, "", "the streaming search", "日本語 é", "a  b "]
    want = mine.encode_column(pa.array(texts)).to_pylist()
    mine.by_word = False
    assert mine.encode_column(pa.array(texts)).to_pylist() == want
