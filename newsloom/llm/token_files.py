"""Token ids of documents as ORC files that are read by stripes and pruned by their metadata.

Documents are ranged by id, encoded where they land and written in ascending order of their ids. A row holds up to
``ROW_IDS`` ids of one document, so no row, batch or buffer grows with the longest text:

    part      number of the range, in ascending order of ids
    number    number of the document within its part
    doc_id    id of the document
    at        ids of the part before this row
    left      ids of the document after this row
    n, ids    the ids of this row

All integers are run-length encoded by the format (ids of one document stay together in one column); every ``stride`` rows
have an entry in the row index, and a Bloom filter on ``doc_id``. Scans are cut at stripes and need no neighbour: places in
the stream and checksums of whole documents follow from each row alone and are added up.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.packing import _byte_letters
from newsloom.llm.shared import map_arrow

END_ID = 1
#: Ids of one row, at most: what the format's readers and writers hold is a batch of rows.
ROW_IDS = 4096
#: Rows between two entries of the row index (the format's least), and bytes of a stripe.
STRIDE, STRIPE = 1000, 16 << 20
#: Entries of a worker's cache of encoded words; it is emptied when full.
CACHE_WORDS = 400_000
#: Characters of a long text that are cut into words at a time.
PIECE = 1 << 20


# --- encoding ---------------------------------------------------------------------------------------------------------


class _Known(dict):
    """Ids of the words met so far; a new word is encoded when it is asked for."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self._encode(word)
        return ids


class WordEncoder:
    """Ids of texts by a tokenizer file that drops white space, each as little-endian unsigned 32-bit integers.

    Where the file's rules drop white space and cut there, a text's ids are those of its words one after the other; each
    distinct word is encoded once. Files with other rules, and texts with the strings of special tokens, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._words = _Known(self._word)
        with open(path, encoding="utf-8") as source:
            content = json.load(source)
        self._special = [t["content"] for t in content.get("added_tokens") or []]
        self._cuts = self._drops_spaces(content) and not self._joins_words()
        names = [n.get("type") for n in (content.get("normalizer") or {}).get("normalizers", [])]
        self._merge = self._merger(content) if self._cuts and names == ["NFC", "Replace", "Lowercase"] else None
        if self._merge:
            self._parts = regex.compile(content["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    @staticmethod
    def _drops_spaces(content: dict) -> bool:
        """Whether words are cut out by a pattern of which no part can hold white space."""
        steps = (content.get("pre_tokenizer") or {}).get("pretokenizers", [])
        first = steps[0] if steps else {}
        pattern = (first.get("pattern") or {}).get("Regex", "")
        cut = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
        return bool(cut) and not content.get("post_processor") and r"[^\s\p{L}\p{N}]+" in pattern and r"\s+" not in pattern

    def _joins_words(self) -> bool:
        """Whether a sample of words together has other ids than one by one."""
        words = ["A", "b-c's", "d.", "(e)", "'ll", "é", "12", "́x", "ß,"]
        apart = [i for w in words for i in self._tokenizer.encode(w, add_special_tokens=False).ids]
        return any(self._tokenizer.encode(s.join(words), add_special_tokens=False).ids != apart for s in (" ", "\n", " \n "))

    def _merger(self, content: dict) -> Callable[[bytes], list[int]] | None:
        """Merges by rank for words of letters, if the file is a byte-level BPE with word ends where a pair's rank is its id.

        A word's end is a byte that no text holds; with the last byte of a word it merges first.
        """
        model = content["model"]
        suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model.get("merges", [])]
        if model.get("type") != "BPE" or not suffix or None in merged or merged != sorted(merged):
            return None
        import tiktoken

        letters, ranks = _byte_letters(), {}
        for piece, i in vocab.items():
            if piece not in self._special:
                ended = piece.endswith(suffix) and piece != suffix
                ranks[bytes(letters[c] for c in (piece[: -len(suffix)] if ended else piece)) + (b"\xff" if ended else b"")] = i
        if any(bytes([b]) not in ranks for b in range(255)) or ranks.get(b"a\xff", merged[0]) >= merged[0]:
            return None
        ranks[b"\xff"] = ranks.get(b"\xff", max(ranks.values()) + 1)
        return tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _plain(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a word that isn't known yet. Capitals, and a full stop or comma after a letter, don't make it a new one."""
        if not word:
            return b""
        if word[-1] in ".," and word[-2:-1].isalpha():
            return self._words[word[:-1]] + self._words[word[-1]]
        if not self._merge or not word.isprintable() or max(word) > "\u00ff":
            return self._plain(word)
        # Letters up to U+00FF are composed already, and have one small letter each.
        low = word.lower()
        if low != word:
            return self._words[low]
        ids = [i for part in ([low] if low.isalpha() else self._parts.findall(low)) for i in self._merge(part.encode() + b"\xff")]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self._cuts or any(s in text for s in self._special):
            return self._plain(text)
        return b"".join(map(self._piece, pieces(text)))

    def _piece(self, text: str) -> bytes:
        if len(self._words) > CACHE_WORDS:
            self._words.clear()
        return b"".join(map(self._words.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``PIECE`` characters, cut at spaces; a longer word stays whole."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.find(" ", at + PIECE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    """One encoder for each worker and file; its cache serves all tasks of the worker and is bounded."""
    return WordEncoder(path)


# --- checksums --------------------------------------------------------------------------------------------------------

#: The public CRC-32 polynomial, lowest power in the highest bit.
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(maxsize=4096)
def _power(n_bytes: int) -> int:
    """x to the power of the bits in ``n_bytes`` bytes."""
    out, square, n = 1 << 31, 1 << 30, 8 * n_bytes
    while n:
        if n & 1:
            out = _times(out, square)
        square, n = _times(square, square), n >> 1
    return out


def crc_share(crc: int, bytes_after: int) -> int:
    """What a piece with this checksum adds to that of the whole: the exclusive or of all shares is the whole's CRC-32."""
    return _times(_power(bytes_after), crc) if bytes_after else crc


# --- files ------------------------------------------------------------------------------------------------------------


def schema(id_type: T.DataType) -> T.StructType:
    fields = [
        ("part", T.IntegerType()), ("number", T.LongType()), ("doc_id", id_type), ("at", T.LongType()),
        ("left", T.LongType()), ("n", T.IntegerType()), ("ids", T.ArrayType(T.IntegerType())),
    ]
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def encode_rows(docs: DataFrame, tokenizer_path: str, end_id: int, id_column: str, text_column: str, parts: int | None) -> DataFrame:
    """The files' rows, ranged and sorted by id.

    Rows of equal ids are ordered by their texts' hash and text, and may be split over parts.
    """
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    read = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    order = ["doc_id", "hash"]
    ranged = read.repartitionByRange(parts, *order) if parts else read.repartitionByRange(*order)
    kind = schema(read.schema["doc_id"].dataType)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, at = TaskContext.get().partitionId(), 0, 0
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            rows, first, n, left, held = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text) + end
                total = len(ids) // 4
                for begin in range(0, total, ROW_IDS):
                    rows.append(i)
                    first.append(number + i)
                    n.append(min(ROW_IDS, total - begin))
                    left.append(total - begin - n[-1])
                    held.append(ids[4 * begin : 4 * (begin + ROW_IDS)])
            number += batch.num_rows
            places = at + np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            at = int(places[-1])
            values = pa.array(np.frombuffer(b"".join(held), dtype="<i4"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            for lo in range(0, len(rows), 1000):
                hi = min(lo + 1000, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(hi - lo, part), pa.int32()),
                        pa.array(first[lo:hi], pa.int64()),
                        batch.column(0).take(pa.array(rows[lo:hi])),
                        pa.array(places[lo:hi], pa.int64()),
                        pa.array(left[lo:hi], pa.int64()),
                        pa.array(n[lo:hi], pa.int32()),
                        pa.ListArray.from_arrays(offsets[lo : hi + 1], values),
                    ],
                    kind.names,
                )

    return map_arrow(ranged.sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text"), run, kind)


def write(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text",
    parts: int | None = None, stride: int = STRIDE, stripe_bytes: int = STRIPE, bloom_fpp: float = 0.01,
) -> None:
    """Encode all texts and write them to ``path``, documents in ascending order of their ids (null first).

    Every document ends with ``end_id``. A null text counts as empty and gives that id alone; long texts take several rows;
    repeated rows and ids are documents of their own; an empty table gives files without rows. Other columns are not read,
    whatever their names.
    """
    rows = encode_rows(docs, tokenizer_path, end_id, id_column, text_column, parts)
    (
        rows.write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .option("orc.row.index.stride", str(stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.rows.between.memory.checks", str(STRIDE))
        .orc(path)
    )


def read(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """The files' rows. Filters on ``doc_id`` skip stripes and row groups by their least and greatest ids and Bloom filters."""
    return spark.read.schema(schema(id_type or T.LongType())).orc(path)


def part_starts(rows: DataFrame) -> DataFrame:
    """(part, part_start): the ids of all parts before; one row for each file, from two narrow columns."""
    totals = rows.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    before = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    return totals.select("part", before.alias("part_start"))


def documents(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document: its place in the stream of all ids, and their checksum.

    Rows of a document may come from different stripes and tasks; each gives its share of the checksum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.asarray(lists.offsets)
            data = memoryview(np.ascontiguousarray(np.asarray(lists.values), dtype="<i4")).cast("B")
            left = batch.column("left").to_pylist()
            shares = [crc_share(zlib.crc32(data[4 * a : 4 * b]), 4 * after) for a, b, after in zip(bounds, bounds[1:], left)]
            share = pa.array(np.array(shares, dtype=np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*map(batch.column, names[:-1]), share], names)

    names = ["part", "number", "doc_id", "at", "n", "share"]
    kinds = {f.name: f.dataType for f in rows.schema}
    out = T.StructType([T.StructField(c, T.LongType() if c == "share" else kinds[c]) for c in names])
    shares = map_arrow(rows.select("part", "number", "doc_id", "at", "n", "left", "ids"), run, out)
    whole = shares.groupBy("part", "number").agg(
        F.min("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.bit_xor("share").alias("ids_crc32")
    )
    placed = whole.join(part_starts(rows), "part")
    return placed.select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def lookup(rows: DataFrame, ids: list) -> DataFrame:
    """(doc_id, ids) of the documents with the given ids, their rows put together; other stripes and row groups aren't read."""
    found = rows.where(F.col("doc_id").isin(ids))
    parts = F.array_sort(F.collect_list(F.struct("at", "ids")))
    whole = found.groupBy("part", "number").agg(F.min("doc_id").alias("doc_id"), parts.alias("rows"))
    return whole.select("doc_id", F.flatten(F.transform("rows", lambda r: r["ids"])).alias("ids"))
