"""Token files: ids against the tokenizer itself, places and checksums against a plain loop, and the files' metadata."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import token_files
from newsloom.llm.catalog import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def expected(rows, plain):
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, text), in order."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*plain(text), 1]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


TEXTS = [
    "Plain words, with stops. And (brackets).", "It's we'll THEY'RE don't 'quoted' rock'n'roll", "", "   ", "\n\n\t\r\n", "a",
    "ÄÖÜ ß straße ÉCOLE naïve ª º µ", "é ́x İ İstanbul ΣΑΣ Σ. ÆØ Ÿ", "3.14, 1,000.50 x2 2x v1.2.3.", "....,,, ., ,. a., b.,c",
    "<|endoftext|> in a text <|startoftext|>", "emoji 👍🏽 and 漢字 かな 한국어", "nbsp joined wide​zero\x1cfs\x85nel\x0bvt\x0cff",
    "x" * 3000, "_under_ #tag @me a-b_c/d\\e", "'", "'s", "s' 's", ".", ",", "word.\nNext,\tlast", "\x00\x01 control \x7f",
]


def test_words_have_the_ids_of_the_whole_text(plain):
    encoder = token_files.WordEncoder(PATH)
    rng = random.Random(5)
    pool = [w for t in TEXTS for w in t.split(" ")]
    mixed = [rng.choice([" ", "\n", "  "]).join(rng.choices(pool, k=12)) for _ in range(300)]
    for text in TEXTS + mixed + TEXTS:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain(text), text


def test_long_texts_are_encoded_in_pieces(plain, monkeypatch):
    monkeypatch.setattr(token_files, "PIECE", 50)
    monkeypatch.setattr(token_files, "CACHE_WORDS", 20)
    encoder = token_files.WordEncoder(PATH)
    text = " ".join(["Some words, and MORE.", "y" * 80, "\n", "don't  stop"] * 20)
    assert "".join(token_files.pieces(text)) == text
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain(text)


@pytest.mark.parametrize("cuts", [[0], [1, 2], [0, 5, 5, 300], [4096, 8192, 9000]])
def test_shares_add_up_to_the_checksum_of_the_whole(cuts):
    data = random.Random(1).randbytes(10_000)
    bounds = [0, *cuts, len(data)]
    total = 0
    for a, b in zip(bounds, bounds[1:]):
        total ^= token_files.crc_share(zlib.crc32(data[a:b]), len(data) - b)
    assert total == zlib.crc32(data)


def test_places_and_checksums_of_all_documents(spark, plain, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op11_token_files"](spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert sorted(map(tuple, got.collect())) == expected(rows, plain)


def test_nulls_repeated_rows_long_texts_and_other_columns(spark, plain, tmp_path):
    long = "The same long text, again and again. " * 3000  # several rows
    rows = [(7, long), (3, "b"), (None, "no id"), (3, "b"), (5, None), (4, ""), (7, "short"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, ids string, part int, at int")
    path = str(tmp_path / "files")
    token_files.write(docs, path, PATH, parts=3)
    stored = token_files.read(spark, path)
    assert stored.agg(F.max("n")).first()[0] == token_files.ROW_IDS
    got = [tuple(r) for r in token_files.documents(stored).collect()]
    # Equal ids may stand in any order; every other place is fixed, and no two documents overlap.
    assert sorted((str(i), n, c) for i, _, n, c in got) == sorted((str(i), n, c) for i, _, n, c in expected(rows, plain))
    at = 0
    for doc_id, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    ids_in_order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert ids_in_order == [None, None, 3, 3, 4, 5, 7, 7]
    found = {r["doc_id"]: r["ids"] for r in token_files.lookup(stored, [5, 4, 99]).collect()}
    assert found == {4: [1], 5: [1]}
    both = sorted(len(r["ids"]) for r in token_files.lookup(stored, [7]).collect())
    assert both == sorted([len(plain(long)) + 1, len(plain("short")) + 1])


def test_an_empty_table_gives_no_documents(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH, parts=2)
    assert token_files.documents(token_files.read(spark, path)).collect() == []


def test_files_have_stripes_run_lengths_indexes_and_bloom_filters(spark, tmp_path):
    docs = spark.range(6000).select((F.col("id") * 10).alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.sha1((F.col("id") * 100 + i).cast("string"))), " ").alias("text"))
    path = str(tmp_path / "files")
    token_files.write(docs, path, PATH, parts=1, stripe_bytes=1 << 19)
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    orc = jvm.org.apache.orc.OrcFile
    file = next(p for p in (tmp_path / "files").iterdir() if p.name.endswith(".orc"))
    reader = orc.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), orc.readerOptions(conf))
    stripes = list(reader.getStripes())
    assert len(stripes) > 2 and reader.getRowIndexStride() == token_files.STRIDE
    rows = reader.rows()
    footer = rows.readStripeFooter(stripes[0])
    streams = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
    names = ["struct", "part", "number", "doc_id", "at", "left", "n", "ids", "item"]
    assert {(c, "BLOOM_FILTER_UTF8") for c in (names.index("doc_id"),)} == {x for x in streams if "BLOOM" in x[1]}
    assert {(i, "ROW_INDEX") for i in range(len(names))} <= streams
    assert {footer.getColumns(i).getKind().toString() for i in range(1, len(names))} == {"DIRECT_V2"}  # integer run lengths
    rows.close()
    reader.close()
    stored = token_files.read(spark, path)
    plan = token_files.lookup(stored, [1230])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1230)]" in plan or "In(doc_id" in plan
    assert token_files.lookup(stored, [1230]).count() == 1 and token_files.lookup(stored, [1231]).count() == 0
    # Stripes are read in parallel: splits smaller than the file, each row once.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        split = token_files.read(spark, path)
        assert split.rdd.getNumPartitions() > 2
        assert token_files.documents(split).agg(F.count("*"), F.sum("n_tokens")).first() == token_files.documents(stored).agg(F.count("*"), F.sum("n_tokens")).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
