"""Packing of tokenised documents into training windows by Karmarkar-Karp multiway differencing.

Every task packs the documents of its own partition, so nothing is shuffled and a lost task is simply run again. A
document is cut at multiples of the window; full pieces are windows of their own. The remaining pieces are gathered
into groups of about ``GROUP_WINDOWS`` windows, and each group is dealt out by differencing: partial partitions are
merged, the fullest slot of one with the emptiest of the other, until one partition of near-equal windows is left. When
a window exceeds the capacity the window count rises and the group is dealt out anew.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.shared import free_name, map_arrow

CAPACITY = 2048
#: Windows that are dealt out together: more means less padding and more work per piece.
GROUP_WINDOWS = 96
#: Remainders are cut at multiples of this many tokens, so that a window is made of several pieces.
PIECE_TOKENS = 512
#: Entries of a worker's cache of encoded words; it is emptied when full.
CACHE_WORDS = 250_000


#: How byte-level tokenizers cut a text before merging (fixed value of that public format).
BYTE_LEVEL_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes are themselves, the rest follow 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordCachedTokenizer:
    """Ids of texts by a tokenizer file, each as little-endian unsigned 32-bit integers.

    A byte-level tokenizer cuts a text at every space between characters that aren't white space. The words between
    such spaces are encoded once, many at a time, and then looked up. Texts with other runs of white space, with
    special tokens, and all texts of other kinds of tokenizers are encoded as they are.
    """

    #: A space before white space or the end, where the tokenizer may not cut.
    _RUN = re.compile(r" (?:\s|\Z)")
    _EDGE = re.compile(r"\A\s|\s\Z|\A\Z")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as source:
            content = json.load(source)
        self._special = [t["content"] for t in content.get("added_tokens", [])]
        self._merger = self._byte_level(content)

    def _byte_level(self, content: dict):
        """An encoder that merges by rank, if the file is of the kind where a pair's rank is the id it gives."""
        kind, model = content.get("pre_tokenizer") or {}, content["model"]
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
        if model.get("type", "BPE") != "BPE" or not plain or content.get("normalizer"):
            return None
        import tiktoken

        letters, vocab = _byte_letters(), model["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            return None
        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in self._special}
        self._spaced = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self._spaced[[i for word, i in ranks.items() if word[:1] == b" "]] = True
        return tiktoken.Encoding("words", pat_str=BYTE_LEVEL_CUT, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        if self._merger is None or any(s in text for s in self._special):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self._merger.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def _learn(self, missing: list[str]) -> None:
        """Encode words, each after a space, in one go: a new word begins where a token begins with a space."""
        edge = [w for w in missing if self._EDGE.search(w)]
        self._words.update((w, self._plain(" " + w)) for w in edge)
        rest = list(set(missing).difference(edge)) if edge else missing
        if rest:
            ids = self._merger.encode_to_numpy(" " + " ".join(rest), disallowed_special=()).astype("<u4")
            cuts = (4 * np.append(np.flatnonzero(self._spaced[ids]), len(ids))).tolist()
            data = ids.tobytes()
            self._words.update(zip(rest, [data[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))

    def forget(self) -> None:
        """Empty the cache: workers outlive the tasks that fill it."""
        self._words.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self._words
        if len(known) > CACHE_WORDS:
            known.clear()
        whole = self._merger is None
        cut = [
            None if whole or self._RUN.search(t) or any(s in t for s in self._special) else t.split(" ") for t in texts
        ]
        missing = {w for ws in cut if ws for w in ws if w not in known}
        if missing:
            self._learn(list(missing))
        out = []
        for text, ws in zip(texts, cut):
            if ws is None:
                out.append(self._plain(text))
            else:
                head = self._plain(ws[0]) if ws[0] else b""
                out.append(head + b"".join(map(known.__getitem__, ws[1:])))
        return out


_TOKENIZERS: dict[str, WordCachedTokenizer] = {}


def tokenizer(path: str) -> WordCachedTokenizer:
    """One tokenizer per worker and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordCachedTokenizer(path)
    return _TOKENIZERS[path]


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0..k-1) of each piece, by multiway differencing; ties go to the earlier piece.

    A partial partition is a row of k slot sums in ascending order. The two with the widest spread are merged until one
    is left. Slots are nodes of a forest that is walked back at the end.
    """
    n = len(sizes)
    if n == 0 or k == 1:
        return np.zeros(n, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    nodes = [np.zeros(k, dtype=np.int64) for _ in range(n)]
    sums = [np.zeros(k, dtype=np.int64) for _ in range(n)]
    heap = []
    for at, piece in enumerate(order):
        nodes[at][-1] = piece + 1
        sums[at][-1] = sizes[piece]
        heap.append((-int(sizes[piece]), at))
    heapq.heapify(heap)
    merges, free = [], n + 1
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        left, right = nodes[a], nodes[b][::-1]
        total = sums[a] + sums[b][::-1]
        new = np.arange(free, free + k)
        merges.append((free, left, right))
        free += k
        rank = np.argsort(total, kind="stable")
        nodes[a], sums[a] = new[rank], total[rank]
        nodes[b] = sums[b] = None
        heapq.heappush(heap, (-int(sums[a][-1] - sums[a][0]), a))
    last = heap[0][1]
    window = np.zeros(free, dtype=np.int64)
    window[nodes[last]] = np.arange(k)
    for first, left, right in reversed(merges):
        window[left] = window[first : first + k]
        window[right] = window[first : first + k]
    return window[1 : n + 1]


def deal_out(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece, no window above the capacity; the window count rises until all fit."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        window = differencing(sizes, k)
        over = int(np.bincount(window, weights=sizes, minlength=k).max()) - capacity if len(sizes) else 0
        if over <= 0:
            return window
        k += max(1, k * over // (4 * capacity))


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class _Packer:
    """Packs the pieces of one task."""

    def __init__(self, task: int, capacity: int, piece: int, group: int) -> None:
        self.capacity, self.piece, self.group = capacity, piece, group
        self.next_id = task << 36
        self.rows: list[tuple] = []
        self.pieces: list[tuple] = []
        self.waiting = 0

    def add(self, doc: object, ids: bytes) -> None:
        n = len(ids) // 4
        full = n - n % self.capacity
        for start in range(0, full, self.capacity):
            self.rows.append((doc, start, self.capacity, ids[4 * start : 4 * (start + self.capacity)], n, self.next_id, 0))
            self.next_id += 1
        for start in range(full, n, self.piece):
            length = min(self.piece, n - start)
            self.pieces.append((doc, start, length, ids[4 * start : 4 * (start + length)], n))
            self.waiting += length
        if self.waiting >= self.group * self.capacity:
            self.flush()

    def flush(self) -> None:
        sizes = np.array([p[2] for p in self.pieces], dtype=np.int64)
        window = deal_out(sizes, self.capacity)
        filled: dict[int, int] = {}
        for piece, w in zip(self.pieces, window.tolist()):
            at = filled.get(w, 0)
            self.rows.append((*piece, self.next_id + w, at))
            filled[w] = at + piece[2]
        self.next_id += int(window.max()) + 1 if len(window) else 0
        self.pieces, self.waiting = [], 0


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 1,
    capacity: int = CAPACITY,
    piece_tokens: int = PIECE_TOKENS,
    group_windows: int = GROUP_WINDOWS,
) -> DataFrame:
    """Pack every document into windows of at most ``capacity`` tokens.

    Returns one row per piece: the id column, ``start`` (tokens of the document before the piece), ``length``, ``ids``
    (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` within that sequence.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur. A null id stays null.
    Other columns are left out, whatever their names; an id called like a column of the result gets an underscore behind its
    name. Long texts are cut into pieces and packed whole. An empty table gives an empty result.
    """
    kind = docs.schema[id_column].dataType
    fields = T._parse_datatype_string(SCHEMA).fields
    named = free_name(id_column, [f.name for f in fields])
    schema = T.StructType([T.StructField(named, kind)] + fields)
    arrow = pa.schema(
        [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tokenizer(tokenizer_path)
        packer = _Packer(TaskContext.get().partitionId(), capacity, piece_tokens, group_windows)

        def out(id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*packer.rows))
            packer.rows = []
            types = [id_type, *arrow.types]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [named, *arrow.names])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    packer.add(doc, ids + end)
                if len(packer.rows) >= 1000:
                    yield out(id_type)
        packer.flush()
        if packer.rows:
            yield out(id_type)
        encoder.forget()

    return map_arrow(docs.select(F.col(id_column), F.col(text_column).cast("string")), run, schema)
