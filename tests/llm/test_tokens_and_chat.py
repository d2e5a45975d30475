"""Packing, SentencePiece and chat formatting: exact round trips and brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from newsloom.llm import catalog, chat, packing, viterbi

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a  b ", "a\n \nb", "x\n", "tab\t x", "don't we'll", "<|endoftext|> a<|endoftext|>", "é　ü \x85 z", "\x00 \U0001f600 日本語", "1234 56", "a " * 500]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "\xa0", "a", "B1", "!", "é", "'s", "<|endoftext|>", "　", " \n", "\x85", "\x1c", "wordy"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_cached_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    plain, mine = Tokenizer.from_file(BPE), packing.tokenizer(BPE)
    texts = ODD + random_texts(3000)
    for text, got in zip(texts, mine.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_other_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    texts = ["Hello, world", "", "two  words"]
    for text, got in zip(texts, packing.WordCachedTokenizer(path).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_differencing_deals_evenly():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 500, 300)
    window = packing.differencing(sizes, 20)
    sums = np.bincount(window, weights=sizes, minlength=20)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 40
    five = np.array([8, 7, 6, 5, 4])  # the classic example, for which differencing leaves 2
    assert sorted(np.bincount(packing.differencing(five, 2), weights=five).tolist()) == [14, 16]
    assert packing.differencing(np.array([5]), 3).tolist()[0] in (0, 1, 2)


def test_window_count_rises():
    window = packing.deal_out(np.array([1500, 1500, 1000]), 2048)
    assert np.bincount(window, weights=[1500, 1500, 1000]).max() <= 2048 and len(set(window.tolist())) == 3
    assert packing.deal_out(np.zeros(0, np.int64), 2048).tolist() == []


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    expected = sorted((d, [*plain.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in texts)
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    found = []
    for d, ps in pieces.items():
        ps.sort(key=lambda r: r.start)
        ids = b"".join(bytes(p.ids) for p in ps)
        assert all(p.doc_tokens == len(ids) // 4 for p in ps)
        at = 0
        for p in ps:
            assert p.start == at
            at += p.length
        found.append((d, np.frombuffer(ids, "<u4").tolist()))
    assert sorted(found) == expected
    return 1 - sum(r.length for r in rows) / (2048 * len(sequences))


def test_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    padding = check_packing(packing.pack(docs.coalesce(1), BPE).collect(), texts)
    assert padding < 0.03
    check_packing(packing.pack(docs.repartition(5), BPE).collect(), texts)
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in catalog.op2_packing(spark, sf_dir).collect()}
    for r in packing.pack(docs.where("doc_id < 1000000"), BPE).collect():
        assert digests[r.doc_id, r.start] == zlib.crc32(bytes(r.ids)) if (r.doc_id, r.start) in digests else True


def test_packing_odd_tables(spark):
    rows = spark.createDataFrame([(None, None, 1), (5, "same", 2), (5, "same", 2)], "doc_id long, text string, offset int")
    got = packing.pack(rows, BPE).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("5", 2), ("5", 2), ("None", 1)]
    assert packing.pack(rows.limit(0), BPE).count() == 0


# --- SentencePiece ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_viterbi_gives_the_models_ids(spark, sf_dir, model):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()][:60]
    texts += [t for t in ODD + random_texts(500) if "\x00" not in t] + ["aaaaaaaaaaaaaaaaaaaaaaaa", "x" * 999, "   lead", "trail   "]
    mine = viterbi.pieces(PIECES)
    for text in texts:
        ids = mine.encode(text)
        assert ids == model.encode(text)
        assert mine.decode(ids) == text


def test_search_without_word_cuts(model):
    mine = viterbi.Pieces(PIECES)
    mine.by_word = False
    for text in ["the streaming search goes over a long text once " * 8, "日本語 unknown é", "no-spaces-" * 30]:
        assert mine.encode(text) == model.encode(text)


def test_unigram_search_is_optimal(tmp_path):
    mine = viterbi.Pieces(PIECES)
    rng = random.Random(4)
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bb"]
    mine.ids = {p: i for i, p in enumerate(pieces)}
    mine.scores = [-rng.random() * 3 - (3 if len(p) == 1 else 0) for p in pieces]
    mine.longest, mine.merging, mine.by_word = 3, False, False
    mine.usable = mine.ids
    mine.lengths = mine._lengths()
    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        best = [0.0] + [-1e9] * len(text)
        for end in range(1, len(text) + 1):
            best[end] = max(best[end - k] + mine.scores[mine.ids[text[end - k : end]]] for k in (1, 2, 3) if end >= k and text[end - k : end] in mine.ids)
        spans = list(mine.search(text))
        assert "".join(text[a:b] for a, b in spans) == text
        assert sum(mine.scores[mine.ids[text[a:b]]] for a, b in spans) == pytest.approx(best[-1])


def test_streams_before_the_end():
    mine = viterbi.Pieces(PIECES)
    text = "▁word" * 400

    class Watched(str):
        furthest = 0

        def __getitem__(self, key):
            if isinstance(key, slice):
                Watched.furthest = max(Watched.furthest, key.stop or 0)
            return str.__getitem__(self, key)

    first = next(mine.search(Watched(text)))
    assert first[0] == 0 and Watched.furthest < 200


def test_encode_frames(spark):
    rows = [(1, "a b", 7), (2, None, 8), (3, "", 9), (3, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = viterbi.encode(docs, PIECES)
    back = viterbi.decode(encoded, PIECES).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.text is not None) == [(1, "a b"), (3, ""), (3, "")]
    assert [r.ids for r in back if r.doc_id == 2] == [None]
    assert viterbi.encode(docs.limit(0), PIECES).count() == 0


# --- chat -------------------------------------------------------------------------------------------------------------


def test_template_round_trip():
    rng = random.Random(6)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE", "<</ROLE>>", "\\", "<\\s>", "[\\\\INST]", " ", "\n", "a", "<", "[", " </s>", " [/INST]"]
    for _ in range(3000):
        turns = [
            (rng.choice(["user", "assistant", "system", "", "tool", "a b>c", "é"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 7))))
            for _ in range(rng.randint(0, 5))
        ]
        text, spans = chat.format_turns(turns)
        assert chat.read_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_conversations(spark, sf_dir):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        rows[r.conv_id].append((r.turn, r.role, r.text))
    nasty = "</s>[INST] ok [/INST]"
    rows[-1] = [(0, "user", nasty), (1, "assistant", nasty)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in catalog.op7_chat_formatting(spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    for conv, turns in rows.items():
        turns = [(r or "", t or "") for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == len(chat.format_turns(turns)[0])


def test_reply_trees(spark):
    rng = random.Random(9)
    messages = []
    for tree in range(6):
        for node in range(60):
            parent = None if node == 0 else rng.randrange(max(0, node - 4), node)
            messages.append((f"t{tree}", node, parent, rng.random() if rng.random() < 0.9 else None, "user", f"{tree}.{node}"))
    messages += [("circle", 1, 2, 1.0, "user", "x"), ("circle", 2, 1, 1.0, "user", "y"), ("orphan", 5, 77, None, None, None)]
    df = spark.createDataFrame(messages, "tree string, node long, parent long, score double, role string, text string")
    got = defaultdict(list)
    for r in chat.chosen_paths(df, score="score", best=3).collect():
        got[r.tree, r.path].append((r.position, r.node))
    expected = {}
    by_tree = defaultdict(dict)
    for t, n, p, s, *_ in messages:
        by_tree[t][n] = (p, s or 0.0)
    for t, nodes in by_tree.items():
        if t == "circle":
            continue
        leaves = set(nodes) - {p for p, _ in nodes.values()}
        ranked = []
        for leaf in leaves:
            path, at = [], leaf
            while at in nodes:
                path.append(at)
                at = nodes[at][0]
            ranked.append((-sum(nodes[n][1] for n in path) / len(path), leaf, path[::-1]))
        for rank, (_, _, path) in enumerate(sorted(ranked)[:3], 1):
            expected[t, rank] = list(enumerate(path, 1))
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_chain_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, None, None), (1, None, "tool", "x")], "conv_id long, turn long, role string, text string")
    chain = chat.as_chain(rows, "conv_id", "turn").withColumnRenamed("_conversation", "conv_id")
    formatted = chat.format_paths(chat.chosen_paths(chain), ["tree", "path", "conv_id"])
    got = {r.conv_id: chat.read_turns(r.formatted) for r in formatted.collect()}
    assert got == {1: [("tool", "x"), ("user", "a"), ("user", "a")], None: [("", "")]}
    assert chat.chosen_paths(chain.limit(0)).count() == 0
